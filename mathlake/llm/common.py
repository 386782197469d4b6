"""What the operators of this subpackage share: shared folder, code shipping, ranks, word splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import discard, materialise, shared_dir, ship, tidied  # noqa: F401  the operators take them from here

#: Word separators of the contracts: space and U+0009 to U+000D. bytes.split() cuts at exactly these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Words whose hashes a task keeps.
MEMO = 200_000


class WordHashes(dict):
    """word -> its 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learns(doc_id: str | Column, mod: int, held: int = 2) -> Column:
    """False for the rows whose crc32(doc_id as text) leaves the remainder `held`; rows without a doc_id learn."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod != held, F.lit(True))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int = 256) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, in `buckets` independent pieces a key.

    A key that holds a third of all rows is numbered by many tasks: each (key, hash bucket) gets its rows' numbers from
    a window of its own, and starts where the counts of the key's earlier buckets end. df is read twice, so it must be
    cheap or materialised; it must hold no column __bucket or __base.
    """
    cut = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    ranked = cut.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    return ranked.join(base, [*keys, "__bucket"]).withColumn(out, F.col(out) + F.col("__base")).drop("__bucket", "__base")


#: Bits of a key bitmap: a fixed 8 MB, whatever the number of keys. The fuller it is, the more rows are only maybe marked.
BITMAP = 1 << 26


def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP))


def key_bitmap(df: DataFrame, keys: list[str]) -> bytes:
    """One bit for each slot that a key of df falls in."""
    slots = df.select((_slot(keys) + 1).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = bytearray(BITMAP // 8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = r["bits"]
    return bytes(out)


def marked(df: DataFrame, keys: list[str], bits: bytes, inside: bool) -> DataFrame:
    """The rows of df that may have a key of the bitmap, or those that have none: two parts of df, told apart where read."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            hit = (marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
            yield rest.filter(pa.array(hit == inside, pa.bool_()))

    return df.withColumn("__slot", _slot(keys)).mapInArrow(tidied(run), df.schema)
