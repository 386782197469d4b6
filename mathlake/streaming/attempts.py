"""A running log of recognition attempts: files of attempts in, per-window status counts and a latest-state table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import place
from ..operators.ocr import latest_attempts

#: Ranges of keys that a table of latest attempts is split into.
RANGES = 64


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def status_counts(attempts: DataFrame, at: str = "ts", status: str = "event_type", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Attempts per window and status; windows close once the watermark has passed them, so the state is bounded."""
    seen = attempts.withWatermark(at, late)
    return seen.groupBy(F.window(at, window), status).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), status, "n")


def versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, int]:
    """Which batch wrote each range of the table last: what the last whole batch says, or the last one before another."""
    at, fs = place(spark, f"{root}/versions")
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if fs.exists(place(spark, f"{s.getPath()}/_SUCCESS")[0])] if fs.exists(at) else []
    last = max((b for b in done if before is None or b < before), default=None)
    return {} if last is None else dict(map(tuple, spark.read.schema("range int, batch long").json(f"{root}/versions/{last}").collect()))


def current(spark: SparkSession, root: str, schema: StructType | str, ranges: dict[int, int] | None = None) -> DataFrame:
    """The table as the last whole batch left it, or those ranges of it."""
    kept = versions(spark, root) if ranges is None else ranges
    paths = [f"{root}/data/{batch}/range={r}" for r, batch in kept.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_latest(attempts: DataFrame, root: str, keys: list[str], checkpoint: str, ranges: int = RANGES):
    """Keeps the latest attempt of each key and how many there were, as keyed state of the query, in a table at root.

    The state is Spark's own, dealt by key: a batch reads and writes its own keys there (set the RocksDB state store for
    more keys than memory holds). What a batch changed replaces those keys in the ranges of the table that they fall
    into; other ranges are not read or written. A batch that runs again writes the same ranges under the same number, and
    readers see a batch once all of it is there. Ranges that no reader of the last two batches can ask for are deleted.
    """

    def put(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        schema = changed.schema
        rows = changed.withColumn("range", F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")).persist()
        touched = [r[0] for r in rows.select("range").distinct().collect()]  # at most as many as there are ranges
        old = versions(spark, root, batch)
        kept = current(spark, root, schema, {r: b for r, b in old.items() if r in touched}).join(rows.select(*keys), keys, "left_anti")
        both = rows.unionByName(kept.withColumn("range", F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")))
        both.repartition(max(1, len(touched)), "range").write.partitionBy("range").mode("overwrite").parquet(f"{root}/data/{batch}")
        rows.unpersist()
        new = old | dict.fromkeys(touched, batch)
        spark.createDataFrame(list(new.items()), "range int, batch long").coalesce(1).write.mode("overwrite").json(f"{root}/versions/{batch}")
        for r in touched:
            before = versions(spark, root, old[r]) if r in old and old[r] else {}
            if r in before:
                path, fs = place(spark, f"{root}/data/{before[r]}/range={r}")
                fs.delete(path, True)

    return latest_attempts(attempts, keys).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
