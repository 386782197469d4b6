"""Text, manifests and archives as tables, and versioned writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archives import members

CANDIDATE = "struct<source:string,variant:string,raw:string,latex:string,score:double,validation_status:string,validation_error:string,artifacts:map<string,string>,latex_hash:string,candidate_key:string,repair_of:string,visual_score:double>"
FORMULA = f"struct<id:string,original_match:string,alt:string,markdown_path:string,image_path:string,png_path:string,display_type_auto:string,display_type_manual:string,position:struct<start:int,end:int>,candidates:array<{CANDIDATE}>,selected_latex:string,selected_source:string,selected_candidate_key:string,validation_status:string,validation_error:string>"
MANIFEST = f"version int, markdown string, workdir string, formulas array<{FORMULA}>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path, text. Whole texts, as spans cross lines; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest file; keys that are absent are null."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def explode_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The formulas (workdir, seq, ...) and candidates (workdir, id, idx, ...) of manifests."""
    f = manifests.select("workdir", F.posexplode("formulas").alias("p", "f"))
    names = [c.name for c in f.schema["f"].dataType.fields if c.name != "candidates"]
    formulas = f.select("workdir", (F.col("p") + 1).alias("seq"), *(F.col(f"f.{c}") for c in names))
    c = f.select("workdir", F.col("f.id").alias("id"), F.posexplode("f.candidates").alias("q", "c"))
    return formulas, c.select("workdir", "id", (F.col("q") + 1).alias("idx"), "c.*")


def blank(rows: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """rows with the keys and all fields of a manifest's part (FORMULA or CANDIDATE); those that rows lack are null."""
    have = [f for f in T.StructType.fromDDL(f"x {part}")["x"].dataType.fields if f.name not in keys and f.name != "candidates"]
    return rows.select(*keys, *(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in have))


def _in_order(items: Column, place: str) -> Column:
    """All items by their place alone: their maps cannot be compared."""
    return F.array_sort(F.collect_list(items), lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0))


def assemble_manifests(formulas: DataFrame, candidates: DataFrame) -> DataFrame:
    """The inverse: one row a workdir with its formulas in order, each with its candidates in order.

    Formulas and candidates are dealt out once, by workdir, and meet by grouping: neither lists nor rows move again.
    """
    inner = [f.name for f in T.StructType.fromDDL(f"c {CANDIDATE}")["c"].dataType.fields]
    names = [f.name for f in T.StructType.fromDDL(f"f {FORMULA}")["f"].dataType.fields]
    ids, none = ["workdir", "id"], F.lit(None)
    own = formulas.select(*ids, F.struct("seq", *(n for n in names if n not in ("id", "candidates"))).alias("f"), none.alias("c"))
    theirs = candidates.filter("workdir is not null and id is not null").select(*ids, none.alias("f"), F.struct("idx", F.struct(*inner).alias("c")).alias("c"))
    met = own.unionByName(theirs).repartition("workdir").groupBy(*ids).agg(F.collect_list("f").alias("fs"), _in_order(F.col("c"), "idx").alias("l"))
    rows = met.select(*ids, F.explode("fs").alias("x"), F.transform("l", lambda c: c["c"]).alias("candidates"))
    item = F.struct(*(F.col(n) if n in ("id", "candidates") else F.col(f"x.{n}") for n in names))
    lists = rows.groupBy("workdir").agg(_in_order(F.struct(F.col("x.seq").alias("seq"), item.alias("f")), "seq").alias("l"))
    return lists.select("workdir", F.transform("l", lambda x: x["f"]).alias("formulas"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """One row a member of every zip archive: path, name, and the tag counts of its XML; no other member is opened."""
    xml = F.make_valid_utf8(F.coalesce(F.col("content"), F.lit("").cast("binary")).cast("string"))
    count = lambda tag: F.floor((F.length(xml) - F.length(F.replace(xml, F.lit(tag), F.lit("")))) / len(tag)).cast("long")
    return members(spark, path, "word/*.xml").select("path", "name", count("<m:oMath").alias("omath"), count("<m:oMathPara").alias("omath_para"))


def inspect_archives(members: DataFrame) -> DataFrame:
    """Counters of each archive: media by extension, embedded objects, formula tags (the paragraph tag counts twice)."""
    name = F.lower("name")
    media = name.startswith("word/media/")
    kinds = [media & name.endswith(f".{e}") for e in ("wmf", "emf", "png")]
    other = media & ~(kinds[0] | kinds[1] | kinds[2])
    ole = name.startswith("word/embeddings/oleobject") & name.endswith(".bin")
    counts = dict(zip(("media_wmf", "media_emf", "media_png", "media_other", "ole_embeddings"), (*kinds, other, ole), strict=True))
    return members.groupBy("path").agg(*(F.count_if(c).alias(k) for k, c in counts.items()), F.sum("omath").alias("omml_oMath"), F.sum("omath_para").alias("omml_oMathPara"))


def write_version(df: DataFrame, root: str) -> str:
    """Writes a new version beside the others and then names it in the pointer: a reader sees the old one or the new one."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/versions/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return version


def read_version(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{root}/current").first()["version"]
    return spark.read.parquet(f"{root}/versions/{version}")


def create_if_absent(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes a table unless it exists; an existing one is returned as it is unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
