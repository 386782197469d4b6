"""One registered query per operator over whole driver tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import gates, latex, logs, paths, text
from ..operators import audit, external, extract, merge, ocr, select, validate
from ..sources import brackets, corpus, markdown, tables
from ..sources.corpus import table
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITY = config.DEFAULTS["candidate_selection"]["priority"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def settings(strategy: str = "visual_best") -> dict:
    out = deepcopy(config.DEFAULTS)
    out["candidate_selection"]["strategy"] = strategy
    return out


# ---- selection ---------------------------------------------------------------------------------------------------

CAND = f"c as (select {corpus.CANDIDATES} from lineitem), "
FORM = f"f as (select {corpus.FORMULAS} from orders), "
GOOD = "ok as (select *, case source when 'pix2tex' then 0 when 'texteller' then 1 when 'ollama_qwen' then 2 else 999 end as rnk, concat(source, ':', variant, ':', idx) as k from c where validation_status = 'valid' and latex <> ''), "
WON = (
    CAND + GOOD + "r as (select *, max(visual_score) over (partition by formula_id) as top, row_number() over (partition by formula_id order by visual_score is null, -visual_score, rnk, idx) as rv, row_number() over (partition by formula_id order by rnk, idx) as rp from ok), "
    "w as (select formula_id, source, k, latex, case when coalesce(top, -1) >= 0.7 then 'visual' else 'priority' end as how from r where case when coalesce(top, -1) >= 0.7 then rv = 1 else rp = 1 end) "
)


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("formula_id"), *(none.alias(c) for c in ("selected_latex", "selected_source", "selected_candidate_key", "validation_status")))


def _selected(df: DataFrame) -> DataFrame:
    return df.select("formula_id", "selected_latex", "selected_source", "selected_candidate_key", "validation_status", "chosen_by")


FRESH = "select o_orderkey as formula_id, w.latex as selected_latex, w.source as selected_source, w.k as selected_candidate_key, case when w.k is null then 'invalid' else 'valid' end as validation_status, coalesce(how, 'none') as chosen_by from orders left join w on o_orderkey = w.formula_id"


@query("with " + WON + FRESH)
def select_visual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(select.select_candidates(_fresh(spark, sf_dir), corpus.candidates(spark, sf_dir), settings(), ["formula_id"]))


@query("with " + CAND + GOOD + "r as (select *, row_number() over (partition by formula_id order by rnk, idx) as rp from ok), w as (select formula_id, source, k, latex, 'priority' as how from r where rp = 1) " + FRESH)
def select_priority_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(select.select_candidates(_fresh(spark, sf_dir), corpus.candidates(spark, sf_dir), settings("priority"), ["formula_id"]))


@query("with " + FORM + WON + ", s as (select f.*, f.selected_source = 'manual' and f.selected_latex <> '' as keep, w.k, w.source, w.latex, w.how from f left join w using (formula_id)) select formula_id, case when keep then selected_latex when k is not null then latex else nullif(selected_latex, '') end as selected_latex, case when keep then selected_source when k is not null then source when selected_latex <> '' then selected_source end as selected_source, case when keep or k is null then selected_candidate_key else k end as selected_candidate_key, case when keep then validation_status when k is not null then 'valid' else 'invalid' end as validation_status, case when keep then 'manual' when k is not null then how else 'none' end as chosen_by from s")
def select_sticky_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(select.select_candidates(corpus.formulas(spark, sf_dir), corpus.candidates(spark, sf_dir), settings(), ["formula_id"]))


@query("with " + CAND + GOOD + "b as (select formula_id, 1 as phase, row_number() over (partition by formula_id order by idx) as ord, source, 'empty' as reason from c where latex = ''), t as (select *, max(visual_score) over (partition by formula_id) as top from ok where visual_score is not null), l as (select formula_id, 2 as phase, row_number() over (partition by formula_id order by -visual_score, rnk, idx) as ord, source, concat('visual_score below threshold: ', cast(visual_score as varchar)) as reason from t where top < 0.7) select * from b union all select * from l")
def selection_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rejections(corpus.candidates(spark, sf_dir), settings(), ["formula_id"])


@query("with " + FORM + "b as (select *, selected_latex <> '' and validation_status <> 'valid' as bad from f) select formula_id, case when not bad then selected_latex end as selected_latex, case when not bad then selected_source end as selected_source, case when bad then 'invalid' else validation_status end as validation_status, case when bad then 'selected candidate invalid; falling back to TODO PNG' end as fallback_reason from b")
def invalid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.drop_invalid_selections(corpus.formulas(spark, sf_dir)).select("formula_id", "selected_latex", "selected_source", "validation_status", "fallback_reason")


@query("with " + CAND + "m as (select formula_id, max(idx) as i from c group by 1) select formula_id, i + 1 as idx, 'manual' as source, concat('m_', formula_id) as latex, 'pending' as validation_status, 'manual:manual:1' as candidate_key from m")
def manual_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = corpus.candidates(spark, sf_dir)
    new = have.select("formula_id").distinct().withColumn("latex", F.concat(F.lit(" m_"), F.col("formula_id").cast("string"), F.lit(" ")))
    return select.add_manual(have, new, ["formula_id"]).filter("source = 'manual'").select("formula_id", "idx", "source", "latex", "validation_status", "candidate_key")


@query("with " + FORM + "e as (select l_orderkey as formula_id, arg_max(concat('edit_', l_partkey), row(l_shipdate, concat('edit_', l_partkey))) as t from lineitem group by 1) select f.formula_id, coalesce(t, selected_latex) as selected_latex, selected_source from f left join e using (formula_id)")
def latest_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("formula_id"), F.col("l_shipdate").alias("edited_at"), F.concat(F.lit("edit_"), F.col("l_partkey").cast("string")).alias("selected_latex"))
    return select.apply_overrides(corpus.formulas(spark, sf_dir), edits, ["formula_id"]).select("formula_id", "selected_latex", "selected_source")


# ---- audit and counts --------------------------------------------------------------------------------------------

IDS = "coalesce(array_to_string(list_sort(list(formula_id) filter (where trim(selected_latex) = '')), ','), '') as unresolved_ids"


def _keyed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("candidate_key", latex.candidate_key(F.lit(None), F.col("source"), F.col("variant"), F.col("idx")))


def _joined(c: str = "unresolved_ids"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query("with " + FORM + CAND + "k as (select *, concat(source, ':', variant, ':', idx) as ck from c), s as (select formula_id, count(*) as n from c where latex_hash <> 'now' group by 1), j as (select f.*, coalesce(s.n, 0) as st, k.validation_status as cs, k.preview_png as pv, k.ck from f left join k on f.formula_id = k.formula_id and f.selected_candidate_key = k.ck left join s on f.formula_id = s.formula_id), "
       "a as (select doc_id, count(*) as total_formulas, count(*) filter (where validation_status = 'valid' and selected_latex <> '') as selected_valid_formulas, count(*) filter (where selected_source = 'manual') as manual_formulas, count(*) filter (where selected_latex = '') as unresolved_todo_formulas, " + IDS + ", sum(st) as stale_candidates, count(*) filter (where selected_latex <> '' and pv is null) as selected_without_preview, count(*) filter (where selected_latex <> '' and ck is not null and cs <> 'valid') as selected_failing from j group by 1) "
       "select *, case when unresolved_todo_formulas + stale_candidates + selected_failing > 0 then 'failed' else 'ok' end as status from a")  # fmt: skip
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _keyed(corpus.candidates(spark, sf_dir))
    old = audit.stale_candidates(have, ["formula_id"], F.lit("now"))
    out = audit.audit(corpus.formulas(spark, sf_dir), have, old)
    return out.withColumn("unresolved_ids", _joined())


@query("with " + FORM + "g as (select doc_id, count(*) as formula_total, count(*) filter (where selected_latex <> '') as formula_selected, count(*) filter (where selected_latex = '') as formula_unresolved, " + IDS + " from f group by 1) select * from g")
def formula_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.formula_summary(corpus.formulas(spark, sf_dir)).withColumn("unresolved_ids", _joined())


@query("with " + FORM + "n as (select l_orderkey, count(*) as n from lineitem group by 1) select doc_id, count(*) as formulas, cast(sum(coalesce(n, 0)) as bigint) as candidates, count(*) filter (where selected_latex <> '') as selected from f left join n on formula_id = l_orderkey group by 1")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("formula_id")).agg(F.count("*").alias("n"))
    rows = corpus.formulas(spark, sf_dir).join(n, "formula_id", "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("formulas"), F.sum(F.coalesce("n", F.lit(0))).alias("candidates"), F.count_if(F.col("selected_latex") != "").alias("selected"))


@query("with " + CAND + "x as (select formula_id, idx, 'latex_hash mismatch' as reason from c where latex_hash <> 'now') select * from x")
def stale_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stale_candidates(corpus.candidates(spark, sf_dir), ["formula_id"], F.lit("now"))


@query("with " + FORM + CAND + "s as (select f.*, k.visual_score as v from f left join c k on f.formula_id = k.formula_id and f.selected_candidate_key = concat(k.source, ':', k.variant, ':', k.idx)) select 'invalid' as filter, formula_id from s where validation_status <> 'valid' union all select 'no selected latex', formula_id from s where selected_latex = '' union all select 'manual', formula_id from s where selected_source = 'manual' union all select 'low visual score', formula_id from s where coalesce(nullif(v, 0), 1) < 0.7 union all select 'search', formula_id from s where contains(lower(concat(formula_id, ' ', selected_latex, ' []')), '77')")
def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _keyed(corpus.candidates(spark, sf_dir)).select("formula_id", F.col("candidate_key").alias("selected_candidate_key"), "visual_score")
    rows = corpus.formulas(spark, sf_dir).join(have, ["formula_id", "selected_candidate_key"], "left")
    out = None
    for name in ("invalid", "no selected latex", "manual", "low visual score", "search"):
        one = audit.review(rows, query="77") if name == "search" else audit.review(rows, name, score=F.col("visual_score"))
        one = one.select(F.lit(name).alias("filter"), "formula_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("with " + FORM + CAND + "n as (select formula_id, count(*) as n from c group by 1) select f.formula_id, case when f.validation_status in ('valid', 'invalid') then f.validation_status else 'pending' end as row_class, selected_latex, k.preview_png as selected_preview, coalesce(n, 0) as n_candidates from f left join c k on f.formula_id = k.formula_id and f.selected_candidate_key = concat(k.source, ':', k.variant, ':', k.idx) left join n on f.formula_id = n.formula_id")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report_rows(corpus.formulas(spark, sf_dir), _keyed(corpus.candidates(spark, sf_dir)), ["formula_id"])


@query("select page_id, (length(html) - length(replace(html, '<p', ''))) // 2 as tag_p, (length(html) - length(replace(html, '<div', ''))) // 4 as tag_div, (length(html) - length(replace(html, '</', ''))) // 2 as tag_close from pages")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(audit.tag_count(F.col("html"), t).alias(c) for t, c in (("<p", "tag_p"), ("<div", "tag_div"), ("</", "tag_close"))))


@query("select user_id, arg_max(event_type, row(ts, event_id)) as status, max(ts) as started_at, arg_max(value, row(ts, event_id)) as elapsed_seconds, count(*) as n_attempts from events group by 1")
def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("started_at"), "event_id", F.col("event_type").alias("status"), F.col("value").alias("elapsed_seconds"))
    return ocr.latest_attempts(rows, ["user_id"]).drop("event_id")


# ---- planning ----------------------------------------------------------------------------------------------------

ASKED = settings()
ASKED["ocr"]["engines"] = ["pix2tex", "texteller", "ollama_qwen", "nougat"]
ASKED["ollama"]["enabled"] = True


PLANNED = "p as (select * from (values (0, 'pix2tex', 'will_run', null), (1, 'texteller', 'disabled', null), (2, 'ollama_qwen', 'unavailable', 'no server'), (3, 'nougat', 'unknown', 'unknown OCR engine')) as t(position, engine, status, reason)), n as (select source as engine, count(*) as n, count(distinct formula_id) as f from c where trim(latex) <> '' and validation_status <> 'error' group by 1) "


def _planned(spark: SparkSession) -> DataFrame:
    return ocr.engine_plan(spark, ASKED, {"ollama_qwen": (False, "no server")})


@query("with " + CAND + PLANNED + "select position, engine, status, reason, coalesce(n, 0) as usable, coalesce(f, 0) as formulas from p left join n using (engine)")
def engine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan with what each engine has left in the candidates."""
    return ocr.with_candidates(_planned(spark), corpus.candidates(spark, sf_dir), ["formula_id"])


@query("with " + CAND + PLANNED + "select place, w.engine, warning, coalesce(n, 0) as usable, coalesce(f, 0) as formulas from (values (1, 'texteller', 'priority lists the disabled engine texteller; its existing candidates can still be selected'), (2, 'ollama_qwen', 'priority lists the unavailable engine ollama_qwen: no server')) as w(place, engine, warning) left join n using (engine)")
def priority_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with the candidates that can still be selected."""
    return ocr.with_candidates(ocr.priority_warnings(_planned(spark), PRIORITY), corpus.candidates(spark, sf_dir), ["formula_id"])


TODO = "e as (select unnest(['pix2tex', 'texteller', 'ollama_qwen']) as source), t as (select o_orderkey as formula_id, o_custkey as doc_id, source from orders, e), todo as (select t.* from t where not exists (select 1 from c where c.formula_id = t.formula_id and c.source = t.source and trim(c.latex) <> '' and c.validation_status <> 'error')) "


def _todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("formula_id"), F.col("o_custkey").alias("doc_id"))
    return ocr.pending(ocr.tasks(forms, PRIORITY[:3]), corpus.candidates(spark, sf_dir), ["formula_id"])


@query("with " + CAND + TODO + "select formula_id, doc_id, source, 'original' as variant from todo")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _todo(spark, sf_dir).select("formula_id", "doc_id", "source", "variant")


@query("with " + CAND + TODO + "select doc_id, source, array_to_string(list_sort(list(formula_id)), ',') as ids from todo group by 1, 2")
def ocr_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.ocr_plan(_todo(spark, sf_dir)).withColumn("ids", _joined("ids"))


@query("with " + CAND + TODO + "select doc_id, count(distinct formula_id) as pending from todo group by 1")
def pending_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _todo(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("formula_id").alias("pending"))


@query("with " + CAND + "u as (select formula_id, source, count(*) as n from c where trim(latex) <> '' and validation_status <> 'error' group by 1, 2) select * from u")
def usable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.candidates(spark, sf_dir).filter(gates.usable(F.col("latex"), F.col("validation_status"))).groupBy("formula_id", "source").agg(F.count("*").alias("n"))


@query("select p_partkey as seq, printf('f%04d', p_partkey) as id from part where printf('f%04d', p_partkey) between 'f0002' and 'f1500' order by p_partkey limit 100")
def id_range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.format_string("f%04d", "p_partkey").alias("id"))
    return select.id_range(rows, first="f0002", last="f1500", limit=100)


@query("select o_custkey as doc_id, o_orderkey as formula_id, printf('f%04d', row_number() over (partition by o_custkey order by o_orderkey)) as id from orders")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("formula_id"))
    return rows.withColumn("id", F.format_string("f%04d", F.row_number().over(select.Window.partitionBy("doc_id").orderBy("formula_id"))))


def _rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("formula_id"), F.lit(1).cast("long").alias("idx"), F.lit("pix2tex").alias("source"), F.lit("new").alias("latex"))


@query("with " + CAND + "n as (select o_orderkey as formula_id, cast(1 as bigint) as idx, 'pix2tex' as source, 'new' as latex from orders where o_orderstatus = 'F') select formula_id, idx, source, latex from c where not exists (select 1 from n where n.formula_id = c.formula_id and n.source = c.source) union all select * from n")
def purge_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.purge_source(corpus.candidates(spark, sf_dir), _rerun(spark, sf_dir), ["formula_id"]).select("formula_id", "idx", "source", "latex")


@query("with " + CAND + "n as (select o_orderkey as formula_id, cast(1 as bigint) as idx, 'pix2tex' as source, 'new' as latex from orders where o_orderstatus = 'F') select formula_id, source, count(*) as n, count(validation_status) as judged from (select formula_id, source, validation_status from c union all select formula_id, source, null from n) group by 1, 2")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpus.candidates(spark, sf_dir).unionByName(_rerun(spark, sf_dir), allowMissingColumns=True)
    return both.groupBy("formula_id", "source").agg(F.count("*").alias("n"), F.count("validation_status").alias("judged"))


# ---- strings -----------------------------------------------------------------------------------------------------

RAW = f"r as (select p_partkey as cand_id, p_size, {corpus.OCR_RAW} as raw from part), "
#: The cleaned texts of the twelve kinds of raw response, as the rules give them.
CLEAN = r"case cand_id % 12 when 0 then concat('x_', p_size) when 1 then concat('a - ', p_size, ' < z') when 2 then concat('\frac{a}{', p_size, '}') when 3 then concat('x + ', p_size) when 4 then concat('\alpha\beta \leq ', p_size, ' \in S') when 5 then '' when 6 then concat('\frac{a}{', p_size) when 7 then concat('[a,', p_size, ')') when 8 then '' when 9 then concat('y = ', p_size) when 10 then concat('a\\[2pt] b_', p_size) else '\(s\)htarrow A^{}' end"
CLEANED = RAW + f"k as (select *, {CLEAN} as clean from r) "


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.clean_latex(corpus.ocr_raw(spark, sf_dir), "raw", "clean")


@query("with " + CLEANED + "select cand_id, clean, cand_id % 12 = 3 as lost_leading_sign from k")
def clean_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("cand_id", "clean", text.lost_leading_sign(F.col("raw"), F.col("clean")).alias("lost_leading_sign"))


@query("with " + RAW + r"x as (select cand_id, trim(raw, ' ' || chr(10)) as s from r) select cand_id, case when regexp_matches(s, '(?is)```(?:latex|tex|math)?\s*(.*?)```') then trim(regexp_extract(s, '(?is)```(?:latex|tex|math)?\s*(.*?)```', 1), ' ' || chr(10)) else s end as body from x")
def strip_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", text.strip_fence(F.col("raw")).alias("body"))


def _nested(expression: str) -> str:
    for k, v in text.UNICODE_MATH.items():
        expression = f"replace({expression}, '{k}', '{v}')"
    return expression


@query("with " + RAW + f"x as (select cand_id, {_nested('raw')} as ascii from r) select * from x")
def unicode_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", text.unicode_math(F.col("raw")).alias("ascii"))


@query("with " + RAW + r"""l as (select cand_id, list_transform(list_filter(list_transform(string_split(raw, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: trim(regexp_replace(trim(regexp_replace(x, '^[-*#>]+\s*', '')), '^(?:latex|tex|answer|formula|result|output)\s*[:：]\s*', '', 'i'))) as ls from r)
 select cand_id, trim(array_to_string(list_filter(ls, lambda x: not regexp_matches(lower(x), 'i cannot|i can''t|cannot determine|sorry|не могу|невозможно распознать') and not (not regexp_matches(x, '[\\_^={}\[\]()+\-*/<>]|\d') and greatest(len(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]{3,}')) - len(regexp_extract_all(x, '\\[A-Za-z]+')), 0) >= 2)), chr(10)), ' ' || chr(10)) as kept from l""")
def explanatory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", text.drop_explanations(F.col("raw")).alias("kept"))


REPAIRED = r"x as (select cand_id, unnest(case cand_id % 12 when 10 then [concat('a\2pt] b_', p_size)] when 11 then ['shtarrow A', '\(s\)\rightarrow A', 's\rightarrow A'] else [] end) as repaired, generate_subscripts(case cand_id % 12 when 10 then ['a'] when 11 then ['a', 'b', 'c'] else [] end, 1) as p from k) "


@query("with " + CLEANED + ", " + REPAIRED + "select cand_id, cast(p as int) as repair_pos, repaired from x")
def repair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.repairs(corpus.ocr_raw(spark, sf_dir), ["cand_id"], "raw")


@query("with " + CLEANED + ", " + REPAIRED + "select cand_id, cast(2 + p as bigint) as idx, 'pix2tex_repair' as source, repaired as latex, 'pix2tex:original:1' as repair_of from x")
def dedupe_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.ocr_raw(spark, sf_dir).select("cand_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("idx"), F.lit("pix2tex").alias("source"), F.lit("original").alias("variant"), F.col("raw").alias("latex"), F.lit(None).cast("string").alias("repair_of"))
    return validate.with_repairs(rows, ["cand_id"]).filter("repair_of is not null").select("cand_id", "idx", "source", "latex", "repair_of")


@query("with " + CLEANED + "select cand_id, sha256(clean) as latex_hash from k")
def latex_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("cand_id", latex.latex_hash(F.col("clean")).alias("latex_hash"))


@query("select p_partkey as cand_id, concat('candidate_', regexp_replace(p_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '_', p_size, '_', substr(sha256(p_name), 1, 12)) as stem from part")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), latex.artifact_name(F.col("p_name"), F.col("p_size"), latex.latex_hash(F.col("p_name"))).alias("stem"))


@query("select p_partkey as cand_id, case when p_size % 2 = 0 then concat('\\[', chr(10), p_name, chr(10), '\\]') else concat('Текст до \\( ', p_name, ' \\) текст после.') end as body from part".replace("\\\\", "\\"))
def wrap_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("p_size") % 2 == 0, "display").otherwise("inline")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), latex.validation_body(F.col("p_name"), shown).alias("body"))


TODO_IMG = "concat('![](formulas/png/', id, '.png)', chr(10), '<!-- TODO_FORMULA_', id, ': formula OCR/validation failed; PNG preview kept instead of WMF/EMF. -->')"
PARTS = "q as (select p_partkey as cand_id, printf('f%04d', p_partkey) as id, case when p_size % 3 = 0 then null else p_name end as sel, case when p_size % 2 = 0 then 'display' else 'inline' end as shown from part) "


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), F.format_string("f%04d", "p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("sel"), F.when(F.col("p_size") % 2 == 0, "display").otherwise("inline").alias("shown"))


@query("with " + PARTS + r"select cand_id, case when sel is null then " + TODO_IMG + r" when shown = 'display' then concat('\[', chr(10), sel, chr(10), '\]') else concat('\(', sel, '\)') end as text from q")
def merge_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    png = F.concat(F.lit("formulas\\png\\"), "id", F.lit(".png"))
    return _parts(spark, sf_dir).select("cand_id", latex.merge_text(F.col("sel"), F.col("shown"), png, F.col("id"), config.DEFAULTS["merge"]).alias("text"))


@query("with " + PARTS + "select cand_id, " + TODO_IMG + " as text from q")
def todo_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("cand_id", latex.todo_image(F.concat(F.lit("formulas/png/"), "id", F.lit(".png")), F.col("id")).alias("text"))


@query("select p_partkey as cand_id, case p_size % 4 when 0 then 'display' when 1 then 'inline' when 2 then case when p_partkey % 2 = 0 then 'display' else 'inline' end else case when p_partkey % 2 = 0 then 'display' else 'inline' end end as display_type from part")
def display_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    manual = F.when(size == 0, " display ").when(size == 1, "inline").when(size == 2, "block")
    auto = F.when(F.col("p_partkey") % 2 == 0, F.lit("display")).otherwise(F.lit("other"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_id"), latex.effective_display(manual, auto).alias("display_type"))


@query("with " + CAND + "x as (select formula_id, idx, case when idx % 3 = 0 then concat('own:', idx) else concat(source, ':', variant, ':', idx) end as candidate_key from c) select * from x")
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("own:"), F.col("idx").cast("string")))
    return corpus.candidates(spark, sf_dir).select("formula_id", "idx", latex.candidate_key(own, F.col("source"), F.col("variant"), F.col("idx")).alias("candidate_key"))


# ---- gates -------------------------------------------------------------------------------------------------------

REFUSED = "regexp_matches(lower(raw), 'i cannot|i can''t|cannot determine|sorry|не могу|невозможно распознать')"
WRAPPED = r"regexp_matches({0}, '\\[()\[\]]|\$\$|(^|[^\\])\$($|[^$])')"
OPEN = r"regexp_replace(regexp_replace({0}, '(?s)\\.', '', 'g'), '[^][(){{}}]', '', 'g')"


def _pairs_gone(expression: str) -> str:
    for _ in range(6):
        expression = f"replace(replace(replace({expression}, '()', ''), '[]', ''), '{{}}', '')"
    return expression + " = ''"


@query("with " + RAW + f"x as (select cand_id, {REFUSED} as refuses from r) select * from x")
def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", text.refuses(F.col("raw")).alias("refuses"))


@query("with " + RAW + f"x as (select cand_id, {WRAPPED.format('raw')} as embedded from r) select * from x")
def wrapper_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", gates.embedded_wrappers(F.col("raw")).alias("embedded"))


@query("with " + RAW + f"x as (select cand_id, {_pairs_gone(OPEN.format('raw'))} as balanced from r) select * from x")
def balance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ocr_raw(spark, sf_dir).select("cand_id", gates.balanced(F.col("raw")).alias("balanced"))


@query("with " + CLEANED + f"select cand_id, case when clean = '' then 'empty' when {REFUSED.replace('raw', 'clean')} then 'model refusal' when {WRAPPED.format('clean')} then 'embedded math wrappers' when not ({_pairs_gone(OPEN.format('clean'))}) then 'unbalanced braces/brackets' end as reason from k")
def gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("cand_id", gates.gate_reason(F.col("clean"), config.DEFAULTS["candidate_selection"]).alias("reason"))


@query("with " + CLEANED + "select cand_id, case when trim(raw) = '' then 'empty raw response from pix2tex' when clean = '' then 'empty LaTeX after cleaning; inspect raw OCR response' end as reason from k")
def empty_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir).select("cand_id", gates.empty_reason(F.col("raw"), F.col("clean"), F.lit("pix2tex")).alias("reason"))


@query(r"select p_partkey as cand_id, case p_partkey % 5 when 0 then concat('x^2 + y_', p_size) when 1 then concat('\frac{a}{', p_size, '}') when 2 then 'w = 1' else '' end as latex from part")
def cli_stdout_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, "part", "p_partkey as cand_id", f"{corpus.CLI_OUT} as out").select("cand_id", logs.latex_of_output(F.col("out")).alias("latex"))


@query(r"select p_partkey as cand_id, case p_partkey % 4 when 0 then concat('! Missing $ inserted.', chr(10), '! Emergency stop.') when 1 then concat('Undefined control sequence \foo', p_size) when 2 then concat('plain output ', p_size) else 'xelatex failed' end as error from part")
def latex_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.derived(spark, sf_dir, "part", "p_partkey as cand_id", f"{corpus.TEX_LOG} as log").select("cand_id", logs.latex_error(F.col("log"), F.lit(""), F.lit("")).alias("error"))


# ---- documents ---------------------------------------------------------------------------------------------------

IMAGES = r"""p as (select doc_id, substr(replace(text, chr(10), ' '), 1, 40) as a, substr(replace(text, chr(10), ' '), 41, 40) as z,
 concat('![](media/image', doc_id, '.wmf)') as o1, concat('![alt](media\Eq', doc_id, '.EMF){width=1in}') as o2, concat('![fig](media/photo', doc_id % 7, '.png)') as o3, concat('![](<media/sp ace', doc_id, '.wmf>)') as o4 from documents),
 s as (select *, length(a) + 1 as s1 from p), s2 as (select *, s1 + length(o1) + 6 as p2 from s), s3 as (select *, p2 + length(o2) + 6 as p3 from s2), s4 as (select *, p3 + length(o3) + 5 as p4 from s3),
 i as (select doc_id, 1 as k, '' as alt, concat('media/image', doc_id, '.wmf') as dest, '' as attrs, o1 as original, s1 as st from s4 union all select doc_id, 2, 'alt', concat('media\Eq', doc_id, '.EMF'), '{width=1in}', o2, p2 from s4
 union all select doc_id, 3, 'fig', concat('media/photo', doc_id % 7, '.png'), '', o3, p3 from s4 union all select doc_id, 4, '', concat('media/sp ace', doc_id, '.wmf'), '', o4, p4 from s4) """


@query("with " + IMAGES + "select doc_id, alt, dest, attrs, original, cast(st as int) as start, cast(st + length(original) as int) as \"end\" from i")
def image_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.images(corpus.docs_md(spark, sf_dir))


def _formulas(spark: SparkSession, sf_dir: str, docs=corpus.docs_md) -> DataFrame:
    return extract.formulas_of(docs(spark, sf_dir), config.DEFAULTS["images"]["formula_extensions"])


@query("with " + IMAGES + "select doc_id, printf('f%04d', case k when 4 then 3 else k end) as id, dest, cast(st as int) as start from i where k <> 3")
def formula_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("doc_id", "id", "dest", "start")


@query("with " + IMAGES + "select doc_id, printf('f%04d', case k when 4 then 3 else k end) as id, case k when 2 then 'display' else 'inline' end as display_type_auto from i where k <> 3")
def display_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir).select("doc_id", "id", "display_type_auto")


#: Cleaned fragments in pattern order; the single-dollar pattern finds the double-dollar formula once more.
FRAGS = "g as (select doc_id, unnest([concat('a_', doc_id), concat('b+', doc_id % 5), concat('c=', doc_id), 'd_1', concat('b+', doc_id % 5)]) as latex, unnest([1, 2, 3, 4, 5]) as pattern_no, unnest([1, 2, 3, 4, 5]) as pos from documents) "


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fragments(corpus.derived(spark, sf_dir, "documents", "doc_id", f"{corpus.DOCS_TEX} as tex"), ["doc_id"])


@query("with " + FRAGS + "select doc_id, pos, pattern_no, latex from g")
def tex_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fragments(spark, sf_dir).select("doc_id", "pos", "pattern_no", "latex")


@query("with " + FRAGS + "select doc_id, printf('f%04d', pos) as id, latex, 'docx2tex' as source from g where pos <= 3")
def fragment_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.zip_fragments(_formulas(spark, sf_dir).select("doc_id", "seq", "id"), _fragments(spark, sf_dir), ["doc_id"]).select("doc_id", "id", "latex", "source")


@query("with " + IMAGES + r"select doc_id, dest, lower(replace(dest, '\', '/')) as path, split_part(lower(replace(dest, '\', '/')), '/', 2) as base from i")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.images(corpus.docs_md(spark, sf_dir)).select("doc_id", "dest", paths.normalise(F.col("dest")).alias("path"), paths.basename(F.col("dest")).alias("base"))


@query("with " + IMAGES + "select doc_id, printf('f%04d', case k when 4 then 3 else k end) as id, cast(st as int) as image_start from i where k <> 3")
def path_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Formulas know their files under an absolute path; images name them relatively.
    known = _formulas(spark, sf_dir).withColumn("dest", F.concat(F.lit("/work/"), F.translate("dest", "\\", "/")))
    return merge.match(markdown.images(corpus.docs_md(spark, sf_dir)), known, ["doc_id"]).select("doc_id", "id", "image_start")


@query("with f as (select o_custkey as doc_id, o_orderkey as id, o_orderkey % 97 as st from orders), c as (select c_custkey as doc_id, c_custkey % 89 as at from customer) select c.doc_id, arg_min(f.id, row(2 * abs(f.st - c.at), f.id)) as id from c join f using (doc_id) group by 1")
def nearest_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).alias("st"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 89).alias("at"))
    d = merge.distance(F.col("at"), F.col("at") + 5, F.col("st"), F.col("st") + 5)
    return c.join(f, "doc_id").groupBy("doc_id").agg(F.min_by("id", F.struct(d, "id")).alias("id"))


@query("with s as (select o_custkey as doc_id, o_orderkey as id, o_orderkey % 997 as a, o_orderkey % 997 + 40 as b from orders), l as (select *, lag(id) over w as pi, lag(b) over w as pb from s window w as (partition by doc_id order by a, b, id)) select doc_id, 'overlapping replacements' as reason, concat(pi, ',', id) as formula_ids from l where a < pb")
def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey") % 997
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), at.alias("start"), (at + 40).alias("end"))
    return merge.span_problems(spans, ["doc_id"]).select("doc_id", "reason", _joined("formula_ids"))


def _chosen(spark: SparkSession, sf_dir: str, docs=corpus.docs_md) -> DataFrame:
    latex_ = F.when(F.col("seq") == 1, F.concat(F.lit("x_"), F.col("doc_id").cast("string"))).when(F.col("seq") == 3, "y^2")
    return _formulas(spark, sf_dir, docs).withColumn("selected_latex", latex_)


def _merged(spark: SparkSession, sf_dir: str, broken: bool = False, docs=corpus.docs_md) -> tuple[DataFrame, DataFrame]:
    forms = _chosen(spark, sf_dir, docs)
    if broken:  # one formula in seven belongs to a file that no text names
        lost = (F.col("seq") == 2) & (F.col("doc_id") % 7 == 0)
        forms = forms.withColumn("dest", F.when(lost, "elsewhere/none.emf").otherwise(F.col("dest"))).withColumn("original_match", F.when(lost, "![](elsewhere/none.emf)").otherwise(F.col("original_match")))
    out = latex.merge_text(F.col("selected_latex"), F.col("display_type_auto"), F.col("png_path"), F.col("id"), config.DEFAULTS["merge"])
    return merge.merge(docs(spark, sf_dir), forms, out, config.DEFAULTS["images"]["formula_extensions"], ["doc_id"], strict=False)


@query(r"select doc_id, concat(substr(replace(text, chr(10), ' '), 1, 40), ' \(x_', doc_id, '\) mid', chr(10), chr(10), '![](formulas/png/f0002.png)', chr(10), '<!-- TODO_FORMULA_f0002: formula OCR/validation failed; PNG preview kept instead of WMF/EMF. -->', chr(10), chr(10), 'See ![fig](media/photo', doc_id % 7, '.png) and \(y^2\)', chr(10), substr(replace(text, chr(10), ' '), 41, 40), substr(text, 81)) as merged from documents")
def merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("doc_id", "merged")


@query("with " + IMAGES + "select doc_id, 'forbidden reference' as reason, dest, printf('f%04d', case k when 4 then 3 else k end) as ids from i where k <> 3 union all select doc_id, 'selected formula original_match remains', dest, printf('f%04d', case k when 4 then 3 else k end) from i where k in (1, 4)")
def forbidden_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.forbidden_refs(corpus.docs_md(spark, sf_dir), _chosen(spark, sf_dir), config.DEFAULTS["images"]["formula_extensions"], ["doc_id"], "markdown")
    return rows.select("doc_id", "reason", "dest", F.array_join("formula_ids", ",").alias("ids"))


@query("select doc_id, 'formula image match not found during merge' as reason, 'f0002' as ids from documents where doc_id % 7 = 0")
def merge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, broken=True)[1].select("doc_id", "reason", F.array_join("formula_ids", ",").alias("ids"))

# ---- whole documents: positions behind long texts, newlines kept -------------------------------------------------

WHOLE = f"""p as (select doc_id, text, {corpus.CUT} as cut,
 concat('![](media/image', doc_id, '.wmf)') as o1, concat('![alt](media\\Eq', doc_id, '.EMF){{width=1in}}') as o2, concat('![fig](media/photo', doc_id % 7, '.png)') as o3, concat('![](<media/sp ace', doc_id, '.wmf>)') as o4 from documents),
 s2 as (select *, cut + 1 as s1, length(text) + length(o1) + 7 as p2 from p), s3 as (select *, p2 + length(o2) + 6 as p3 from s2), s4 as (select *, p3 + length(o3) + 5 as p4 from s3),
 i as (select doc_id, 1 as k, '' as alt, concat('media/image', doc_id, '.wmf') as dest, '' as attrs, o1 as original, s1 as st from s4 union all select doc_id, 2, 'alt', concat('media\\Eq', doc_id, '.EMF'), '{{width=1in}}', o2, p2 from s4
 union all select doc_id, 3, 'fig', concat('media/photo', doc_id % 7, '.png'), '', o3, p3 from s4 union all select doc_id, 4, '', concat('media/sp ace', doc_id, '.wmf'), '', o4, p4 from s4) """


@query("with " + WHOLE + "select doc_id, alt, dest, attrs, original, cast(st as int) as start, cast(st + length(original) as int) as \"end\" from i")
def image_parse_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.images(corpus.docs_whole(spark, sf_dir))


NESTED = f"""p as (select doc_id, text, {corpus.CUT} as cut, concat('![a', chr(92), ']](media/eq (', doc_id, ')/f(x).wmf) {{w={{1}}}}') as o1, concat('![b ![c](<a (', doc_id, '>c.emf>)') as o2, concat('![d](e ![f', doc_id, ')') as o3 from documents),
 i as (select doc_id, concat('a', chr(92), ']') as alt, concat('media/eq (', doc_id, ')/f(x).wmf') as dest, '{{w={{1}}}}' as attrs, o1 as original, cut + 1 as st from p
 union all select doc_id, 'b ![c', concat('a (', doc_id, '>c.emf'), '', o2, length(text) + length(o1) + 6 from p union all select doc_id, 'd', concat('e ![f', doc_id), '', o3, length(text) + length(o1) + length(o2) + 12 from p) """


@query("with " + NESTED + "select doc_id, alt, dest, attrs, original, cast(st as int) as start, cast(st + length(original) as int) as \"end\" from i")
def image_parse_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of whole texts by bracket depths, without Python."""
    return brackets.images_balanced(corpus.docs_nested(spark, sf_dir), ["doc_id"])


@query("with " + WHOLE + "select doc_id, printf('f%04d', case k when 4 then 3 else k end) as id, dest, cast(st as int) as start, case k when 2 then 'display' else 'inline' end as display_type_auto from i where k <> 3")
def formula_images_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formulas(spark, sf_dir, corpus.docs_whole).select("doc_id", "id", "dest", "start", "display_type_auto")


@query("with " + WHOLE + "select doc_id, printf('f%04d', case k when 4 then 3 else k end) as id, cast(st as int) as image_start from i where k <> 3")
def path_match_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _formulas(spark, sf_dir, corpus.docs_whole).withColumn("dest", F.concat(F.lit("/work/"), F.translate("dest", "\\", "/")))
    return merge.match(markdown.images(corpus.docs_whole(spark, sf_dir)), known, ["doc_id"]).select("doc_id", "id", "image_start")


@query("with " + WHOLE + r"select doc_id, concat(substr(text, 1, cut), ' \(x_', doc_id, '\) mid', substr(text, cut + 1), chr(10), chr(10), '![](formulas/png/f0002.png)', chr(10), '<!-- TODO_FORMULA_f0002: formula OCR/validation failed; PNG preview kept instead of WMF/EMF. -->', chr(10), chr(10), 'See ', o3, ' and \(y^2\)', chr(10)) as merged from p")
def merge_text_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, docs=corpus.docs_whole)[0].select("doc_id", "merged")


# ---- engines -----------------------------------------------------------------------------------------------------


def stub_engine(rows):
    """A deterministic engine: the raw text is in the image column."""
    return rows["png_path"]


@query("with " + CLEANED + "select cand_id, 'pix2tex' as source, clean as latex, case when clean = '' then 'error' else 'pending' end as validation_status from k")
def stub_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.ocr_raw(spark, sf_dir).select("cand_id", F.col("raw").alias("png_path"))
    out = ocr.run_engines(ocr.tasks(rows, ["pix2tex"]), {"pix2tex": stub_engine}, ["cand_id"])
    return out.select("cand_id", "source", "latex", "validation_status")


@query("with " + CLEANED + f"select cand_id, case when clean = '' or {WRAPPED.format('clean')} or cand_id % 12 = 6 then 'invalid' else 'valid' end as validation_status, case when clean = '' then 'empty candidate' when {WRAPPED.format('clean')} then 'embedded math wrappers in candidate' when cand_id % 12 = 6 then '! Missing }} inserted.' end as validation_error, sha256(clean) as latex_hash from k".replace("}}", "}"))
def stub_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = corpus.ocr_raw(spark, sf_dir).select("cand_id", F.lit(1).alias("idx"), F.col("raw").alias("latex"), F.lit("pending").alias("validation_status"), none.alias("latex_hash"))
    out, _ = validate.validate(rows, ["cand_id"])
    return out.select("cand_id", "validation_status", "validation_error", "latex_hash")


@query(r"with n as (select doc_id, 3 as formula_total from documents) select doc_id, formula_total, formula_total as formula_selected, 0 as formula_unresolved from n")
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipeline.full(corpus.docs_md(spark, sf_dir), {"pix2tex": path_engine}, settings())
    return out["summary"].select("doc_id", "formula_total", "formula_selected", "formula_unresolved")


def path_engine(rows):
    """A deterministic engine for whole runs: a formula made of the raster's name."""
    return rows["png_path"].str.extract(r"(\d+)\.png")[0].map(lambda n: rf"\( x_{{{int(n)}}} \)")


MERGED_RUN = r"select doc_id, concat(substr(replace(text, chr(10), ' '), 1, 40), ' \({0}1}}\) mid', chr(10), chr(10), '\[', chr(10), '{0}2}}', chr(10), '\]', chr(10), chr(10), 'See ![fig](media/photo', doc_id % 7, '.png) and \({0}3}}\)', chr(10), substr(replace(text, chr(10), ' '), 41, 40), substr(text, 81)) as merged from documents"


@query(MERGED_RUN.replace("{0}", "x_{").replace("}}", "}"))
def full_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.full(corpus.docs_md(spark, sf_dir), {"pix2tex": path_engine}, settings())["merged"].select("doc_id", "merged")


@query(r"with n as (select p_partkey as cand_id, p_size, p_partkey % 3 as k, p_partkey % 2 as e from part) select cand_id, case e when 0 then 'pix2tex' else 'ollama_qwen' end as source, case when k = 0 and e = 0 then '' when k = 2 then null else concat('x_', p_size) end as latex, k = 0 and e = 1 as retried, case when k = 2 then 'error' when k = 0 and e = 0 then 'error' else 'pending' end as validation_status from n")
def retried_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image in three is a small copy that gives nothing, one makes the engine fail; one of two engines asks again."""
    part = table(spark, sf_dir, "part")
    kind, whole = F.col("p_partkey") % 3, F.concat(F.lit("x_"), F.col("p_size").cast("string"))
    image = F.when(kind == 0, "small").when(kind == 2, "broken").otherwise(whole)
    source = F.when(F.col("p_partkey") % 2 == 0, "pix2tex").otherwise("ollama_qwen")
    work = part.select(F.col("p_partkey").alias("cand_id"), source.alias("source"), F.lit("original").alias("variant"), image.alias("png_path"), F.when(kind == 2, "broken").otherwise(whole).alias("original_png"))
    out = ocr.run_with_originals(work, {"pix2tex": small_engine, "ollama_qwen": small_engine}, ["cand_id"], ["ollama_qwen"])
    return out.select("cand_id", "source", F.when(F.col("raw").isNotNull(), F.col("latex")).alias("latex"), "retried", "validation_status")


def small_engine(rows):
    """A deterministic engine: nothing for small images, a failure for a batch with a broken one."""
    if (rows["png_path"] == "broken").any():
        raise RuntimeError("broken image")
    return rows["png_path"].where(rows["png_path"] != "small", "")


@query("with " + FORM + CAND + "k as (select *, concat(source, ':', variant, ':', idx) as ck from c), a as (select formula_id, case when formula_id % 5 = 0 then 'none:none:9' else min(ck) end as asked from k group by 1), j as (select a.formula_id, a.asked, k.* exclude (formula_id) from a left join k on k.formula_id = a.formula_id and k.ck = a.asked) select f.formula_id, case when j.ck is null then f.selected_latex else j.latex end as selected_latex, coalesce(j.source, f.selected_source) as selected_source, coalesce(j.ck, f.selected_candidate_key) as selected_candidate_key, coalesce(j.validation_status, f.validation_status) as validation_status, case when j.asked is not null and j.ck is null then concat('candidate not found: ', j.asked) end as choice_error from f left join j on f.formula_id = j.formula_id")
def select_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _keyed(corpus.candidates(spark, sf_dir))
    asked = have.groupBy("formula_id").agg(F.min("candidate_key").alias("k")).select("formula_id", F.when(F.col("formula_id") % 5 == 0, "none:none:9").otherwise(F.col("k")).alias("candidate_key"))
    return select.choose(corpus.formulas(spark, sf_dir), have, asked, ["formula_id"]).drop("doc_id")


@query("select c_custkey as id, case c_custkey % 4 when 0 then true else false end as current from customer")
def artifact_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four compiles one is current, one has other TeX, one has no log and one is not there."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), latex.validation_document(F.col("c_name"), config.DEFAULTS).alias("document"), (F.col("c_custkey") % 4).alias("k"))
    old = rows.filter("k <> 3").select("id", F.when(F.col("k") == 1, F.concat("document", F.lit(" "))).otherwise(F.col("document")).alias("tex"), F.lit(True).alias("has_pdf"), (F.col("k") != 2).alias("has_log"))
    return validate.artifact_currency(rows, old, ["id"])


@query("select n_nationkey as id, case n_nationkey % 3 when 0 then 0 when 1 then 127 else 3 end as returncode, case n_nationkey % 3 when 0 then n_name else '' end as stdout, false as timed_out from nation")
def command_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_nationkey") % 3
    argv = F.when(kind == 0, F.array(F.lit("printf"), F.lit("%s"), F.col("n_name"))).when(kind == 1, F.array(F.lit("no-such-program"))).otherwise(F.array(F.lit("sh"), F.lit("-c"), F.lit("exit 3")))
    return external.run_commands(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), argv.alias("argv")), ["id"]).drop("stderr")


@query("with p as (select p_partkey as id, p_name, p_size % 4 as k from part) select id, case k when 0 then 'skipped' when 1 then 'missing' when 2 then 'converted' else 'failed' end as status, case k when 2 then 'second' end as tool, case k when 0 then 'old' when 2 then upper(p_name) end as result, case k when 3 then 'first: no; second: no' end as error from p")
def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of tools behind documents to Markdown, rasters and previews: the second one serves some."""
    kind = F.col("p_size") % 4
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(kind == 3, "?").when(kind != 1, F.col("p_name")).alias("source"), F.when(kind == 0, "old").alias("have"))
    return external.convert(rows, ["id"], "source", {"first": no_tool, "second": upper_tool}, "have")


def no_tool(value: str) -> str:
    raise RuntimeError("no")


def upper_tool(value: str) -> str:
    return no_tool(value) if value == "?" else value.upper()


RASTERS = "with r as (select vec_id, list_transform(embedding, lambda x: cast(floor((x + 1) * 127) as int)) as v from embeddings), m as (select *, cast(floor(list_sum(v) / len(v) + 0.5) as int) as mean from r), "


@query(RASTERS + "x as (select vec_id, unnest(['original', 'padded', 'grayscale_contrast', 'binarized']) as variant, unnest([v, v, list_transform(v, lambda p: cast(greatest(0, least(255, mean + 2 * (p - mean))) as int)), list_transform(v, lambda p: case when p > 153 then 255 else 0 end)]) as w from m) select vec_id, variant, cast(len(w) + case variant when 'original' then 0 else 6 end as int) as width, case variant when 'original' then 1 else 7 end as height, cast(255 * len(w) - list_sum(w) as bigint) as ink from x")
def raster_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("width"), F.lit(1).alias("height"), corpus.grey("embedding").alias("pixels"))
    out = external.raster_variants(rows, ["vec_id"], ["original", "padded", "grayscale_contrast", "binarized"], padding=3)
    ink = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, p: a + (F.lit(255) - p))
    return out.select("vec_id", "variant", "width", "height", ink.alias("ink"))


@query("select doc_id, case when doc_id % 7 = 0 then 'refused' else 'converted' end as status, case when doc_id % 7 = 0 then '1 forbidden references remain' end as error from documents")
def build_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, issues = _merged(spark, sf_dir, broken=True)
    left = merge.forbidden_refs(merged, _chosen(spark, sf_dir), config.DEFAULTS["images"]["formula_extensions"], ["doc_id"])
    left = left.filter("reason = 'forbidden reference'")
    return external.build(merged.select("doc_id", "merged"), left, ["doc_id"], "merged", {"tex": wrap_tool}).select("doc_id", "status", "error")


def wrap_tool(value: str) -> str:
    return "\\begin{document}\n" + value + "\n\\end{document}\n"


@query("with s as (select o_custkey as doc_id, o_orderkey as id, o_orderkey % 50 - 5 as a, o_orderkey % 50 - 5 + o_orderkey % 7 - 2 as b from orders) select doc_id, 'invalid replacement range' as reason, cast(id as varchar) as formula_ids from s where a < 0 or b < a")
def invalid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("o_orderkey") % 50 - 5
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), start.alias("start"), (start + F.col("o_orderkey") % 7 - 2).alias("end"))
    return merge.span_problems(spans, ["doc_id"]).filter("reason = 'invalid replacement range'").select("doc_id", "reason", _joined("formula_ids"))


@query("with d as (select doc_id, text, length(text) // 2 as mid, substr(text, length(text) // 2 + 1, 40) as original from documents where text is not null), s as (select *, case doc_id % 3 when 0 then mid when 1 then strpos(text, original) - 1 end as st from d) select doc_id, 'f0001' as id, cast(st as int) as start, cast(st + length(original) as int) as \"end\" from s where st is not null and length(original) > 0")
def fallback_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas without an image: found where they were, found elsewhere by their text, or not found."""
    at, kind = F.floor(F.length("text") / 2).cast("int"), F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("markdown"))
    original = F.substring("text", at + 1, F.lit(40))
    forms = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.lit("f0001").alias("id"), F.when(kind == 2, F.lit("\u0001 nowhere \u0001")).otherwise(original).alias("original_match"), F.when(kind == 0, at).otherwise(F.lit(-1)).alias("start"), F.when(kind == 0, at + F.length(original)).otherwise(F.lit(-1)).alias("end"))
    return merge.fall_back(docs, forms.filter("length(original_match) > 0"), forms.filter("false"), ["doc_id"])


@query("with " + CAND + "x as (select concat('w', o_custkey) as workdir, printf('f%04d', o_orderkey) as id, row_number() over (partition by o_orderkey order by c.idx) as idx, c.source, c.latex, c.visual_score from c join orders on formula_id = o_orderkey) select workdir, id, cast(idx as int) as idx, source, latex, visual_score from x")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas and candidates nested into one document a folder, written as JSON text, read and taken apart again."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("workdir"), F.format_string("f%04d", "o_orderkey").alias("id"), F.col("o_orderkey").alias("formula_id"))
    have = corpus.candidates(spark, sf_dir).join(orders, "formula_id")
    nested = tables.assemble_manifests(tables.blank(orders.withColumn("seq", F.col("formula_id")), tables.FORMULA, ["workdir", "seq", "id"]), tables.blank(have, tables.CANDIDATE, ["workdir", "id", "idx"]))
    text_ = nested.select("workdir", F.to_json(F.struct("formulas")).alias("j"))
    back = text_.select("workdir", F.from_json("j", f"formulas array<{tables.FORMULA}>").getField("formulas").alias("formulas"))
    return tables.explode_manifests(back)[1].select("workdir", "id", "idx", "source", "latex", "visual_score")
