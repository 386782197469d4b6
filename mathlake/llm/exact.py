"""Exact duplicates by a persistent index of digests.

The index is two tables, bucketed and sorted by digest: `seen` has each digest of each batch with its number of rows,
`kept` has each digest once, with the document that stays. A new batch is grouped by digest (one shuffle, hot texts summed
before it) and written to `seen`; its digests that the index lacks are a sort-merge anti-join of that batch with `kept`,
bucket by bucket without another shuffle, and are appended to `kept`. So no batch reads texts of earlier ones, and a text
that a batch keeps stays kept whatever comes later; within a batch the row with the largest doc_id stays.

Each batch is a partition that is overwritten as a whole: a batch that failed half way is ingested again under its name.

Defined cases: null text is empty text; a row without a doc_id stays only where no row of its text has one; of rows that
repeat both doc_id and text one is kept; texts of any length are hashed whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import place
from .common import materialise, shared_dir

#: A digest is dealt by broadcast if it has more than a share 1 / (HOT * buckets) of the rows: fewer than HOT * buckets do.
HOT = 4


def digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def hashed(docs: DataFrame, batch: Column) -> DataFrame:
    """doc_id, row, digest, batch of every document, written once, in folders by batch; row tells repeated doc_ids apart."""
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), batch.cast("string").alias("batch"))
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "digests", "batch")


class DigestIndex:
    """The index at a path. Opens the one that is there, with its number of buckets, or makes one with as many buckets as
    the session shuffles into, unless told otherwise.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        meta = f"{self.path}/meta"
        at, fs = place(spark, meta)
        if not fs.exists(at):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(n, id_type)], "buckets int, id_type string").coalesce(1).write.mode("overwrite").json(meta)
        self.buckets, self.id_type = spark.read.schema("buckets int, id_type string").json(meta).first()
        name = hashlib.md5(self.path.encode()).hexdigest()
        self.names = {}
        for table, columns in (("seen", f"digest binary, keep_id {self.id_type}, keep_row bigint, n bigint"), ("kept", f"digest binary, keep_id {self.id_type}, keep_row bigint")):
            self.names[table] = f"digests_{name}_{table}"
            spark.sql(f"create table if not exists {self.names[table]} ({columns}, batch string) using parquet partitioned by (batch) clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}/{table}'")
            if fs.exists(place(spark, f"{self.path}/{table}")[0]):
                spark.catalog.recoverPartitions(self.names[table])  # those that other sessions wrote

    def read(self, table: str) -> DataFrame:
        self.spark.catalog.refreshTable(self.names[table])
        return self.spark.table(self.names[table])

    def _write(self, df: DataFrame, table: str, batch: str) -> None:
        rows = df.withColumn("batch", F.lit(batch)).select("digest", *(["keep_id", "keep_row", "n"] if table == "seen" else ["keep_id", "keep_row"]), "batch")
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.insertInto(self.names[table], overwrite=True)
        finally:
            self.spark.conf.set(mode, before)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Adds one batch of hashed rows (doc_id, row, digest)."""
        last = F.max(F.struct("doc_id", (-F.col("row")).alias("back")))  # null doc_ids come first, so any other is larger
        groups = rows.groupBy("digest").agg(last.alias("last"), F.count("*").alias("n"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            groups = groups.repartition(self.buckets, "digest")
        self._write(groups.select("digest", F.col("last.doc_id").alias("keep_id"), (-F.col("last.back")).alias("keep_row"), "n"), "seen", batch)
        new = self.read("seen").filter(F.col("batch") == batch)
        known = self.read("kept").filter(F.col("batch") != batch).select("digest")
        self._write(new.join(known.hint("merge"), "digest", "left_anti"), "kept", batch)

    def state(self) -> DataFrame:
        """digest, keep_id, keep_row, batch and the number of rows of every digest; joined bucket by bucket."""
        n = self.read("seen").groupBy("digest").agg(F.sum("n").alias("n"))
        return self.read("kept").join(n.hint("merge"), "digest")

    def resolve(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of hashed rows whose batches were added.

        Texts with very many copies are matched where their rows are read: there can be fewer than HOT * buckets of them.
        """
        state = self.state().withColumnRenamed("batch", "of")
        hot = materialise(state.filter(F.col("n") > rows.count() // (HOT * self.buckets)), "hot-digests")
        near = rows.join(F.broadcast(hot), "digest")
        far = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(state.hint("merge"), "digest")
        kept = (F.col("of") == F.col("batch")) & (F.col("row") == F.col("keep_row"))
        return near.unionByName(far).select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def ingest(self, docs: DataFrame, batch: str) -> DataFrame:
        """Adds a batch of documents (doc_id, text); its rows as resolve() gives them, group sizes up to now."""
        rows = hashed(docs, F.lit(batch))
        self.add(rows, batch)
        return self.resolve(rows)


def last_of_each(docs: DataFrame, parts: int = 3) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest doc_id stays.

    The documents go through a new index in batches of falling doc_id, so what a batch keeps no later one outdoes.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    batch = F.lit(0)
    if isinstance(kind, T.IntegralType):
        low, high = (None if x is None else float(x) for x in docs.select(F.min("doc_id"), F.max("doc_id")).first())
        if low is not None:
            step = F.floor((F.col("doc_id").cast("double") - low) * parts / (high - low + 1))
            batch = F.when(F.col("doc_id").isNull(), parts - 1).otherwise(parts - 1 - F.least(step, F.lit(parts - 1)))  # rows without a doc_id come last
    rows = hashed(docs, batch)
    root = f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
    index = DigestIndex(spark, root, kind.simpleString())
    at, fs = place(spark, root)
    fs.deleteOnExit(at)
    for k in range(parts if isinstance(kind, T.IntegralType) else 1):
        index.add(rows.filter(F.col("batch") == str(k)), str(k))
    return index.resolve(rows)
