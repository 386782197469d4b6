"""Token ids as directly addressable codes.

A segment holds the ids of whole documents. Ids are split into chunks of 8 bits, lowest first. Level 0 has the lowest
chunk of every id; an id with more chunks sets its bit in the level's continuation bitmap, and its next chunk stands in
the following level at the rank of that bit. A rank directory (ones before every 512 bits) makes each rank one lookup and
one count over at most 64 bytes, so any token is read with one step a level and nothing is decoded around it.

A store is a folder of Parquet files, one row a segment, in ascending doc_id order by (shard, segment): any store that
Spark reads can hold it. The files are not compressed, so that codes are addressed as they lie there. `lookup` reads single
tokens of many documents: statistics of first_id and last_id prune what it reads of the index columns, only segments
that are asked for give their codes, and those are addressed by ranks, never decoded.

Defined cases: null text is an empty document with the end id alone; rows with equal doc_id are documents of their own,
ordered by their text's hash, and may be many, as ranges split them by that hash; null doc_ids come first; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, ship, tidied
from .tokens import default_tokenizer, encoder

MAGIC, BLOCK = b"DAC1", 512
SEGMENT_TOKENS = 1 << 20
SEGMENTS = "shard int, segment int, n_tokens long, first_id {kind}, last_id {kind}, doc_ids array<{kind}>, doc_lengths array<long>, codes binary"


def encode(ids: np.ndarray) -> bytes:
    """The codes of a segment: magic, number of levels, each level's number of ids, then the levels."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while True:
        low, more = rest.astype(np.uint8), rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        levels.append((len(rest), low.tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    return b"".join([MAGIC, struct.pack("<I", len(levels)), *(struct.pack("<Q", x[0]) for x in levels), *(b for x in levels for b in x[1:])])


class Codes:
    """A segment's codes, read in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,), at, self.levels = struct.unpack_from("<I", data, 4), 8, []
        sizes = struct.unpack_from(f"<{n}Q", data, 8)
        at += 8 * n
        for size in sizes:
            bits, blocks = -(-size // 8), -(-size // BLOCK)
            self.levels.append((np.frombuffer(data, np.uint8, size, at), np.frombuffer(data, np.uint8, bits, at + size), np.frombuffer(data, "<u4", blocks, at + size + bits)))
            at += size + bits + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """One id, by one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            first = block * BLOCK // 8
            i = int(ranks[block]) + int(np.bitwise_count(bits[first : i >> 3]).sum()) + (int(bits[i >> 3]) & (1 << (i & 7)) - 1).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = None
        for low, bits, _ in reversed(self.levels):
            here = low.astype(np.uint32)
            if out is not None:
                here[np.unpackbits(bits, count=len(low), bitorder="little").view(bool)] |= out << np.uint32(8)
            out = here
        return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes whole texts and writes the store at `path`, ranges of doc_id side by side."""
    ship(docs.sparkSession)
    tokenizer, kind = tokenizer or default_tokenizer(), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, shard, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, held, total = [], [], 0

        def out() -> pa.RecordBatch:
            lengths = pa.array([[len(x) for x in held]], pa.list_(pa.int64()))
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(names))
            columns = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([total], pa.int64()), names[0], names[-1], doc_ids, lengths, pa.array([encode(np.concatenate(held))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "n_tokens", "first_id", "last_id", "doc_ids", "doc_lengths", "codes"])

        for batch in batches:
            for i, ids in enumerate(to_ids.stream(batch.column(1), end_id)):
                held.append(ids)
                names.append(batch.column(0).slice(i, 1))
                total += len(held[-1])
                if total >= segment_tokens:
                    yield out()
                    names, held, total, segment = [], [], 0, segment + 1
        if held:
            yield out()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    (
        rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(tidied(run), SEGMENTS.format(kind=kind))
        .write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(path)
    )


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row a document from the store: doc_id, start, n_tokens, ids_crc32, and with keep_ids its ids (unsigned 32-bit)."""
    ship(spark)
    stored = spark.read.parquet(path).select("shard", "segment", "n_tokens", "doc_ids", "doc_lengths", "codes")
    kind = dict(stored.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, segment, _, doc_ids, lengths, codes = (c.slice(i, 1) for c in batch.columns)
                ids = Codes(codes[0].as_py()).all().astype("<u4", copy=False)
                lengths = lengths.flatten().to_numpy()
                ends = np.cumsum(lengths)
                parts = [ids[a:b].tobytes() for a, b in zip(ends - lengths, ends, strict=True)]
                n = len(parts)
                columns = [pa.array(np.repeat(x.to_numpy(), n)) for x in (shard, segment)]
                columns += [doc_ids.flatten(), pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"shard int, segment int, doc_id {kind}, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    # One row a shard meets in the outer window, so its size follows the number of files, not of documents.
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("segment_start"))
    starts = starts.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    rows = stored.mapInArrow(tidied(run), schema).join(starts, ["shard", "segment"])
    return rows.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, at and token of every different (doc_id, at) of wanted: the token at place `at`, from 0, of that document.

    Places outside a document, unknown and null doc_ids give no row; a doc_id that several documents share gives one each.
    """
    ship(spark)
    stored = spark.read.parquet(path)
    kind = dict(stored.dtypes)["first_id"]
    wanted = wanted.select("doc_id", F.col("at").cast("long").alias("at")).distinct()
    bounds = wanted.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    index = stored.filter((F.col("last_id") >= F.lit(bounds["a"])) & (F.col("first_id").isNull() | (F.col("first_id") <= F.lit(bounds["b"])))).select("shard", "segment", "doc_ids", "doc_lengths")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, segment, doc_ids, lengths = (c.slice(i, 1) for c in batch.columns)
                n = lengths.flatten().to_numpy()
                columns = [*(pa.array(np.repeat(x.to_numpy(), len(n))) for x in (shard, segment)), doc_ids.flatten(), pa.array(np.cumsum(n) - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "inside", "n"])

    def read_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, asked = Codes(batch.column(0)[i].as_py()), batch.column(1).slice(i, 1).flatten()
                tokens = pa.array([codes[k] for k in asked.field(2).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([asked.field(0), asked.field(1), tokens], ["doc_id", "at", "token"])

    found = index.mapInArrow(tidied(places), f"shard int, segment int, doc_id {kind}, inside long, n long").join(wanted, "doc_id").filter("at >= 0 and at < n")
    asked = found.groupBy("shard", "segment").agg(F.collect_list(F.struct("doc_id", "at", (F.col("inside") + F.col("at")).alias("k"))).alias("asked"))
    codes = stored.select("shard", "segment", "codes").join(asked, ["shard", "segment"])
    return codes.select("codes", "asked").mapInArrow(tidied(read_codes), f"doc_id {kind}, at long, token long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store into the shared folder and reads it back."""
    path = f"{shared_dir(docs.sparkSession)}/dac-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
