"""Where references lead: each path against a listing of the files that exist, in one ranked join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import collapse
from ..functions.text import strip

#: How a reference was resolved, by rank: nothing looks for absolute paths, and what is nowhere belongs beside its text.
PLACES = ["markdown", "workdir"]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modified of every file under a folder of any store; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "").alias("path"), "length", F.col("modificationTime").alias("modified"))


def written(ref: Column) -> Column:
    """A reference without blanks and quotes around it."""
    return F.regexp_replace(F.regexp_replace(strip(ref), r'\A"+|"+\z', ""), r"\A'+|'+\z", "")


def resolve(refs: DataFrame, files: DataFrame, keys: list[str], ref: str = "dest", markdown_dir: str | Column = "/work", workdir: str | Column = "/work") -> DataFrame:
    """refs with resolved, its path, and found_in: absolute, markdown, workdir or nowhere.

    A relative reference is looked for beside its text and then in the working folder; where neither has it, its path is
    the one beside the text. keys tell the rows of refs apart. References that are absolute or null take no part in the
    join, and each file stands on its other side once.
    """
    folders = [F.lit(d) if isinstance(d, str) else d for d in (markdown_dir, workdir)]
    path = written(F.col(ref))
    asked = [collapse(F.concat(F.regexp_replace(d, r"/+\z", ""), F.lit("/"), path)) for d in folders]
    rows = refs.withColumn("__raw", path).withColumn("__asked", F.when(path.startswith("/"), F.array().cast("array<string>")).otherwise(F.array(*asked)))
    looked = rows.select(*keys, F.posexplode("__asked").alias("__rank", "path"))
    there = looked.join(files.select("path").distinct(), "path", "left_semi")
    best = there.groupBy(*keys).agg(F.min(F.struct("__rank", "path")).alias("__found"))
    out = rows.join(best, keys, "left")
    place = F.when(F.col("__raw").startswith("/"), "absolute").when(F.col("__found").isNotNull(), F.get(F.array(*map(F.lit, PLACES)), F.col("__found.__rank"))).when(F.col("__raw").isNotNull(), "nowhere")
    resolved = F.when(F.col("__raw").startswith("/"), F.col("__raw")).otherwise(F.coalesce(F.col("__found.path"), F.get("__asked", 0)))
    return out.select(*refs.columns, resolved.alias("resolved"), place.alias("found_in"))
