"""How filters interact: what each removes, by every order in which they can be applied.

Every document has a mask of the filters that it fails. Masks are counted by part first, so what follows has at most
2^filters cells a part, whatever the corpus: the cells are unpivoted against the steps of all orders, a running bit-or
over the steps before tells what failed earlier, conditional sums make the counts, and a window by filter sums what it
removes in all orders.

The five filters: A, too few words; B, too few different words; C, too many capitals; D, a symbol; E, a text that a
smaller doc_id has too, anywhere in the table. A to D follow from the text, so equal texts share them and E costs one
grouping by digest, not a join back to the rows.

Defined cases: null text is empty; null lang is the part ''; a row without a doc_id has no label, fails no E and makes
none fail; rows that repeat doc_id and text do not fail E by each other; a doc_id with several label rows is good or toxic
if one of them says so; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD
from .exact import digest

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOL = 200, 50, 3, r"[#$%&*|]"
FILTERS = ["A", "B", "C", "D", "E"]
#: Bit of the filter that needs the other rows.
COPY = 1 << 4


def text_mask(words: Column, text: Column) -> Column:
    """The bits of A to D for a text and its words."""
    n, capitals = F.size(words).cast("long"), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.length(text), F.rlike(text, F.lit(SYMBOL))]
    out = F.lit(0)
    for k, failed in enumerate(tests):
        out = out + F.when(failed, 1 << k).otherwise(0)
    return out


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the numbers of rows, good rows and toxic rows with them."""
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = read.select("doc_id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rows = split.select("doc_id", "part", digest(F.col("text")).alias("digest"), text_mask(F.col("words"), F.col("text")).alias("mask"))
    # Repeated rows are one before anything is dealt by doc_id, and what is dealt has no texts.
    rows = rows.groupBy("digest", "mask", "part", "doc_id").agg(F.count("*").alias("n"))
    told = labels.groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "bad"))))
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "bad")]
    rows = rows.join(told, "doc_id", "left").select("doc_id", "digest", "mask", "part", "n", *flags)
    first = F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id")
    groups = rows.groupBy("digest", "mask", "part", "good", "bad").agg(F.sum("n").alias("n"), F.min("doc_id").alias("first_id"), first.alias("n_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_none"))
    # Groups of one text: at most four a part. Of the one with its smallest doc_id, the rows with that doc_id stay.
    smallest = F.min("first_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("n_pass", F.coalesce("n_none", F.lit(0)) + F.when(F.col("first_id") == smallest, F.col("n_first")).otherwise(0))
    both = F.explode(F.array(F.struct("mask", F.col("n_pass").alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - F.col("n_pass")).alias("n"))))
    parts = groups.select("part", "good", "bad", both.alias("c")).filter("c.n > 0")
    return parts.groupBy("part", "c.mask").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("n_good"), F.sum(F.col("c.n") * F.col("bad")).alias("n_bad"))


def order_steps(spark: SparkSession, filters: list[str]) -> DataFrame:
    """filter_order, step, filter of every order of the filters: a table whose size depends on their number alone."""
    rows = [("".join(order), k, name) for order in permutations(filters) for k, name in enumerate(order, 1)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string")


def interactions(counted: DataFrame, filters: list[str]) -> DataFrame:
    """part, filter_order, step and the counts there, of cells (part, mask, n, n_good, n_bad) whose bits follow filters."""
    steps = F.broadcast(order_steps(counted.sparkSession, filters))
    tests = F.explode(F.array(*(F.struct(F.lit(name).alias("filter"), F.col("mask").bitwiseAND(F.lit(1 << k)).alias("bit"), F.lit(1 << k).alias("own")) for k, name in enumerate(filters))))
    long = counted.select("*", tests.alias("t")).select("part", "mask", "n", "n_good", "n_bad", "t.*").join(steps, "filter")
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, fresh = F.col("bit") != 0, F.col("earlier") == 0
    total = lambda test, c="n": F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & fresh).alias("kept"),
        total(fails & fresh).alias("removed"),
        total(fails & ~fresh).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & fresh, "n_good").alias("good_lost"),
        total(fails & fresh, "n_bad").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over documents (doc_id, lang, text) with labels (doc_id, quality, toxic)."""
    return interactions(cells(docs, labels), FILTERS)
