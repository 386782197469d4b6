"""Sharding by jump consistent hashing, with DataFrame functions only.

No ring table: a key's shard comes from the key and the number of shards alone. The published generator
(state * 2862933555777941757 + 1 modulo 2^64) is kept as two 32-bit halves, so no product overflows a long and the
result is the same with ANSI arithmetic on or off. Adding a shard moves only the rows that land in it.

Defined cases: integer keys hash as they are, other keys by xxhash64 of their text, null keys as 0; null text has size 1
and the crc32 of no bytes; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

#: Fixed value of the published generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _times_32(x: Column, factor: int) -> tuple[Column, Column]:
    """The product of two numbers below 2^32: its upper and lower 32 bits."""
    high, low = F.shiftright(x, 16) * F.lit(factor), x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)
    low = low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftright(high, 16) + F.shiftright(low, 32), low.bitwiseAND(F.lit(LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long key, from 0; each step of the fold is one jump."""
    top, bottom = MULTIPLIER >> 32, MULTIPLIER & LOW

    def step(s: Column, _: Column) -> Column:
        carry, low = _times_32(s["lo"], bottom)
        low = low + F.lit(1)
        high = carry + _times_32(s["hi"], bottom)[1] + _times_32(s["lo"], top)[1] + F.shiftright(low, 32)
        high, low = high.bitwiseAND(F.lit(LOW)), low.bitwiseAND(F.lit(LOW))
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(s["j"] >= shards, s).otherwise(F.struct(high.alias("hi"), low.alias("lo"), s["j"].alias("b"), jump.alias("j")))

    begin = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(LOW)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    # j grows with every jump, so as many steps as shards always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), begin, step, lambda s: s["b"].cast("int"))


def shard_key(df: DataFrame, column: str) -> Column:
    col = F.col(column)
    kind = dict(df.dtypes)[column]
    return F.coalesce(col.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(col.isNotNull(), F.xxhash64(col.cast("string"))), F.lit(0).cast("long"))


def with_shard(df: DataFrame, shards: int, column: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard of each row; no shuffle."""
    return df.withColumn(out, jump_hash(shard_key(df, column), shards))


def layout(docs: DataFrame, shards: int = 16, column: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each document goes: its shard, its slot there (gapless from 0), and its shard once one more is added."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(column, (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = with_shard(rows, shards, column)
    ranked = gapless_rank(rows, ["shard"], [column, "text_crc32"], "slot")
    return with_shard(ranked, shards + 1, column, "grown_shard").select(column, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, column: str = "doc_id") -> None:
    """Writes the documents themselves, one folder a shard."""
    with_shard(docs, shards, column).write.partitionBy("shard").parquet(path)
