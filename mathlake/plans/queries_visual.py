"""Queries about rasters, visual scores, and choices by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialise
from ..operators import select, validate, visual
from ..sources import corpus
from ..sources.corpus import table
from . import pipeline
from .queries import CAND, FORM, WRAPPED, _keyed, path_engine, query, settings

# ---- rasters -----------------------------------------------------------------------------------------------------

#: Pairs of vectors as grey values: of six pairs one lacks its second raster, one has a shorter one, one two empty ones.
PAIRS = """r as (select vec_id, list_transform(embedding, lambda x: cast(floor((x + 1) * 127) as int)) as v from embeddings),
 p as (select a.vec_id, case when a.vec_id % 6 = 5 then cast([] as int[]) else a.v end as a, case a.vec_id % 6 when 3 then null when 4 then b.v[1:40] when 5 then cast([] as int[]) else b.v end as b from r a join r b on b.vec_id = a.vec_id + 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "embeddings").select("vec_id", corpus.grey("embedding").alias("a"))
    both = r.join(r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    kind, none = F.col("vec_id") % 6, F.array().cast("array<int>")
    second = F.when(kind == 4, F.slice("b", 1, 40)).when(kind == 5, none).when(kind != 3, F.col("b"))
    return both.select("vec_id", F.when(kind == 5, none).otherwise(F.col("a")).alias("a"), second.alias("b"))


@query("with " + PAIRS + " select vec_id, case when len(a) = len(b) and len(a) > 0 then round(1 - list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / (255.0 * len(a)), 6) end as visual_score from p")
def raster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("vec_id", F.round(visual.similarity(F.col("a"), F.col("b")), 6).alias("visual_score"))


@query("with " + PAIRS + ", d as (select vec_id, unnest(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) as value from p where len(a) = len(b)) select vec_id, cast(value as int) as value, count(*) as n from d group by 1, 2")
def difference_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visual.difference_histogram(_pairs(spark, sf_dir), ["vec_id"])


#: Rasters of three shapes on a canvas of 12 x 6, so that each is shrunk; of seven pairs one has no preview, one a raster
#: with another number of pixels than its size says.
SHAPED = """with e as (select vec_id, list_transform(embedding, lambda x: cast(floor((x + 1) * 127) as int)) as v from embeddings),
 r as (select vec_id, 0 as side, case vec_id % 3 when 0 then 64 when 1 then 8 else 5 end as w, case vec_id % 3 when 0 then 1 when 1 then 8 else 4 end as h, v from e
 union all select vec_id - 1, 1, case vec_id % 2 when 0 then 16 else 7 end, case vec_id % 2 when 0 then 4 else 9 end, v from e where vec_id > (select min(vec_id) from e)),
 ok as (select * from r where not (side = 1 and vec_id % 7 in (5, 6))),
 t as (select *, w <= 12 and h <= 6 as fits, 2.0 >= w / h as tall, w / h as shape from ok),
 c as (select *, floor(6 * shape) as wl, ceil(6 * shape) as wh, floor(12 / shape) as hl, ceil(12 / shape) as hh from t),
 z as (select vec_id, side, w, h, v, case when fits then w when tall then cast(greatest(case when abs(shape - wh / 6) < abs(shape - wl / 6) then wh else wl end, 1) as int) else 12 end as nw,
  case when fits then h when tall then 6 else cast(greatest(case when abs(shape - 12 / hh) < case when hl = 0 then 0 else abs(shape - 12 / hl) end then hh else hl end, 1) as int) end as nh from c),
 x as (select vec_id, side, nw, nh, w, h, v[i + 1] as p, i % w as x, i // w as y from z, unnest(range(w * h)) as u(i)),
 m as (select vec_id, side, nw, nh, cast(ceil((x + 1) * nw / w) as int) - 1 + (12 - nw) // 2 as cx, cast(ceil((y + 1) * nh / h) as int) - 1 + (6 - nh) // 2 as cy, (2 * sum(p) + count(*)) // (2 * count(*)) as p from x group by 1, 2, 3, 4, 5, 6),
 d as (select vec_id, cx, cy, abs(coalesce(max(p) filter (where side = 0), 255) - coalesce(max(p) filter (where side = 1), 255)) as d from m group by 1, 2, 3),
 s as (select vec_id, round(1 - sum(d) / (255.0 * 72), 4) as score from d group by 1)
 select a.vec_id, case when a.vec_id % 7 not in (5, 6) and b.vec_id is not null then score end as visual_score from r a left join r b on b.vec_id = a.vec_id and b.side = 1 left join s on s.vec_id = a.vec_id where a.side = 0"""


@query(SHAPED)
def visual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", corpus.grey("embedding").alias("v"))
    kind = F.col("vec_id") % 3
    width, height = F.when(kind == 0, 64).when(kind == 1, 8).otherwise(5), F.when(kind == 0, 1).when(kind == 1, 8).otherwise(4)
    rasters = e.select("vec_id", width.alias("width"), height.alias("height"), F.slice("v", F.lit(1), width * height).alias("pixels"))
    even, before = F.col("vec_id") % 2 == 0, F.col("vec_id") - 1
    wide, high = F.when(even, 16).otherwise(7), F.when(even, 4).otherwise(9)
    pixels = F.slice("v", F.lit(1), wide * high - F.when(before % 7 == 6, 1).otherwise(0))
    # A preview belongs to a text; here each candidate has a text of its own.
    previews = e.select(before.cast("string").alias("latex_hash"), wide.alias("width"), high.alias("height"), pixels.alias("pixels")).filter("latex_hash % 7 <> 5")
    rows = e.select("vec_id", F.lit("valid").alias("validation_status"), F.lit(None).cast("double").alias("visual_score"), F.col("vec_id").cast("string").alias("latex_hash"))
    return visual.score_candidates(rows, rasters, previews, ["vec_id"], (12, 6)).select("vec_id", "visual_score")


# ---- whole runs --------------------------------------------------------------------------------------------------

MERGED_RUN = r"select doc_id, concat(substr(replace(text, chr(10), ' '), 1, 40), ' \(v_{1}\) mid', chr(10), chr(10), '\[', chr(10), 'v_{2}', chr(10), '\]', chr(10), chr(10), 'See ![fig](media/photo', doc_id % 7, '.png) and \(v_{3}\)', chr(10), substr(replace(text, chr(10), ' '), 41, 40), substr(text, 81)) as merged from documents"


def _drawn(text: Column) -> list[Column]:
    """A stand-in for a renderer: a column of pixels a letter, four rows high."""
    line = F.transform(F.split(text, "(?!^)"), lambda c: (F.ascii(c) * 37 % 256).cast("int"))
    return [F.size(line).alias("width"), F.lit(4).alias("height"), F.flatten(F.array_repeat(line, 4)).alias("pixels")]


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two engines read x_{n} and v_{n}; the images show v_{n}, so the one that the priority list puts last looks right."""
    docs = corpus.docs_md(spark, sf_dir)
    engines = {"pix2tex": path_engine, "texteller": lambda rows: path_engine(rows).str.replace("x_", "v_")}
    shown = F.concat(F.lit("v_{"), F.regexp_extract("png_path", r"(\d+)\.png", 1).cast("int").cast("string"), F.lit("}"))
    rasters = lambda formulas: formulas.select("doc_id", "id", shown.alias("t")).select("doc_id", "id", *_drawn(F.col("t")))
    renderer = lambda texts: texts.select("latex_hash", *_drawn(F.col("latex")))
    return pipeline.full(docs, engines, settings(), rasters=rasters, renderer=renderer)


@query(MERGED_RUN)
def full_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["merged"].select("doc_id", "merged")


#: Letters differ by 32 pixels of 74 grey values between v_{n} and x_{n}: 4 pixels of the letter alone.
@query("with e as (select unnest(['pix2tex', 'texteller']) as source), f as (select unnest(['f0001', 'f0002', 'f0003']) as id) select doc_id, id, e.source, case e.source when 'texteller' then 1.0 else round(1 - 4 * abs(ascii('x') * 37 % 256 - ascii('v') * 37 % 256) / (255.0 * 160 * 80), 4) end as visual_score from documents, e, f")
def full_visual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["candidates"].select("doc_id", "id", "source", "visual_score")


# ---- choices by hand ---------------------------------------------------------------------------------------------


@query("with " + FORM + CAND + "k as (select *, concat(source, ':', variant, ':', idx) as ck from c), a as (select formula_id, max(ck) as asked from k group by 1) select f.formula_id, case when a.asked is null then f.selected_latex else nullif(k.latex, '') end as selected_latex, coalesce(k.source, f.selected_source) as selected_source, coalesce(k.ck, f.selected_candidate_key) as selected_candidate_key, coalesce(k.validation_status, f.validation_status) as validation_status from f left join a on f.formula_id = a.formula_id left join k on k.formula_id = a.formula_id and k.ck = a.asked")
def select_without_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices by key of candidates some of which have no LaTeX: a chosen one is taken whole."""
    have = _keyed(corpus.candidates(spark, sf_dir)).withColumn("latex", F.when(F.col("latex") != "", F.col("latex")))
    asked = have.groupBy("formula_id").agg(F.max("candidate_key").alias("candidate_key"))
    return select.choose(corpus.formulas(spark, sf_dir), have, asked, ["formula_id"]).select("formula_id", "selected_latex", "selected_source", "selected_candidate_key", "validation_status")


TYPED = r"t as (select o_orderkey as formula_id, case o_orderkey % 4 when 0 then concat('m_{', o_orderkey, '}') when 1 then concat('m_{', o_orderkey) when 2 then '' else concat('a $$ ', o_orderkey) end as latex from orders)"


@query("with " + CAND + TYPED + ", n as (select formula_id, max(idx) as i from c group by 1) select t.formula_id, latex as selected_latex, 'manual' as selected_source, 'manual:manual:1' as selected_candidate_key, coalesce(i, 0) + 1 as idx, case when latex = '' or " + WRAPPED.format("latex") + " or t.formula_id % 4 = 1 then 'invalid' else 'valid' end as validation_status, case when latex = '' then 'empty candidate' when " + WRAPPED.format("latex") + " then 'embedded math wrappers in candidate' when t.formula_id % 4 = 1 then '! Missing } inserted.' end as validation_error from t left join n using (formula_id)")
def compiled_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual LaTeX for every formula: added, compiled, selected. One in four is right, the others fail each in its way."""
    kind, name = F.col("formula_id") % 4, F.col("formula_id").cast("string")
    typed = F.when(kind == 0, F.concat(F.lit(" m_{"), name, F.lit("}"))).when(kind == 1, F.concat(F.lit("m_{"), name)).when(kind == 2, " ").otherwise(F.concat(F.lit("a $$ "), name))
    forms = corpus.formulas(spark, sf_dir).withColumn("validation_error", F.lit(None).cast("string"))
    manual = forms.select("formula_id", typed.alias("latex"))
    # Written once, as several steps read them: numbering moves every row.
    have = materialise(_keyed(corpus.candidates(spark, sf_dir)), "candidates")
    chosen, both = validate.compile_and_choose(forms, have, manual, ["formula_id"])
    place = both.filter("source = 'manual'").select("formula_id", F.col("candidate_key").alias("selected_candidate_key"), "idx")
    return chosen.join(place, ["formula_id", "selected_candidate_key"]).select("formula_id", "selected_latex", "selected_source", "selected_candidate_key", "idx", "validation_status", "validation_error")
