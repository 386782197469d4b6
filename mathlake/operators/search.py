"""Searching formulas by any part of what is known of them, candidates included: trigram postings, then the texts.

Postings are a table to be written once and searched often: for each block of 64 texts and each gram that one of them has, a
bit a text. A query reads the postings of its own grams and the blocks' keys; the few texts that have all are looked at whole.
Grams are of three bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship

#: Texts that share a row of postings, a bit each.
BLOCK = 64
#: The gram of the row that holds a block's keys.
KEYS = -1


def texts(formulas: DataFrame, candidates: DataFrame, keys: list[str], key: str = "formula_id") -> DataFrame:
    """keys, text: a formula's id, its selected LaTeX and its candidates as JSON in their order, in lower case."""
    fields = [c for c in candidates.columns if c not in keys]
    lists = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"]))).alias("__c"))
    rows = formulas.join(lists, keys, "left")
    parts = F.concat_ws(" ", F.col(key).cast("string"), F.coalesce("selected_latex", F.lit("")), F.coalesce(F.to_json("__c"), F.lit("[]")))
    return rows.select(*keys, F.lower(parts).alias("text"))


def grams(text: bytes) -> set[int]:
    """The different pieces of three bytes of a text, as numbers."""
    return {int.from_bytes(text[k : k + 3], "big") for k in range(len(text) - 2)}


def block_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of up to 64 texts that lie one after another, and for each the bits of the texts that have it."""
    at = np.arange(len(data) - 2 if len(data) > 2 else 0)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    inside = at + 3 <= (bounds[1:] - bounds[0])[row]
    b = data.astype(np.uint32)
    code = (b[: len(at)] << 16 | b[1 : len(at) + 1] << 8 | b[2 : len(at) + 2]) << 6 | row.astype(np.uint32)
    both = np.sort(code[inside])
    gram = (both >> 6).astype(np.int32)
    first = np.flatnonzero(np.diff(gram, prepend=KEYS))
    bits = np.left_shift(np.uint64(1), (both & 63).astype(np.uint64))
    return gram[first], (np.bitwise_or.reduceat(bits, first) if len(first) else bits).view(np.int64)


def postings(known: DataFrame, keys: list[str]) -> DataFrame:
    """gram, block, bits of texts (keys, text), and for each block one row (KEYS, block, members) with its keys in order."""
    ship(known.sparkSession)
    schema = "gram int, block long, bits long, members array<struct<" + ", ".join(f"`{k}`: {t}" for k, t in known.select(*keys).dtypes) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.slice(k, BLOCK)
                text = pa.concat_arrays([part.column(0).fill_null("").cast(pa.large_string())])
                bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
                gram, bits = block_grams(data, bounds)
                n = len(gram)
                members = pa.StructArray.from_arrays(part.columns[1:], names=keys)
                ends = np.zeros(n + 2, np.int32)
                ends[-1] = len(part)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([True] * n + [False] * 2)), members)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(gram, np.int32(KEYS))), pa.array(np.full(n + 1, block)), pa.array(np.append(bits, np.int64(-1))), lists], ["gram", "block", "bits", "members"])
                block += 1

    return known.select("text", *keys).mapInArrow(run, schema)


def search(posted: DataFrame, known: DataFrame, keys: list[str], query: str) -> DataFrame:
    """The keys whose text holds the query, whatever its case. A query of fewer than three bytes reads all texts."""
    wanted = query.lower()
    asked = sorted(grams(wanted.encode()))
    rows = known
    if asked:
        blocks = posted.filter(F.col("gram").isin(KEYS, *asked)).groupBy("block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"), F.first("members", ignorenulls=True).alias("members"))
        members = blocks.filter((F.col("n") == len(asked) + 1) & (F.col("bits") != 0)).select("bits", F.posexplode("members").alias("p", "m"))
        hits = members.filter(F.getbit("bits", F.col("p")) == 1).select("m.*")
        rows = known.join(hits, keys, "left_semi")
    return rows.filter(F.contains("text", F.lit(wanted))).select(*keys)
