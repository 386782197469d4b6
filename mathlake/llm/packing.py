"""Packing by best-fit decreasing.

Overlong documents are cut into full windows first. What is left is packed by best-fit decreasing over the whole corpus:
pieces of one length are alike, so the plan is made from the histogram of lengths (at most `capacity` rows, whatever the
corpus holds). A segment tree indexed by remaining capacity finds the tightest open window; windows filled alike are one
run of sequence ids. The plan has at most a few rows per length and is the only thing broadcast; each piece then finds
its place from its rank among the pieces of its length.

Defined cases: null text is an empty document and holds the end id alone; documents with equal ids or equal rows are
packed each on its own; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship, tidied
from .tokens import MOST_WORDS, TOGETHER, default_tokenizer, encoder

CAPACITY = 4096
END_ID = 2
#: Rows of piece counts that are sent to all tasks at most (about 24 MB); beyond it they are joined.
SMALL = 1 << 20


class TightestTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while windows with that capacity are open."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, at: int, open_: bool) -> None:
        i = at + self.size
        self.any[i] = open_
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least `least`."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:  # up until an open subtree lies to the right, then down its left edge
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing on counts. Rows (length, first rank, first sequence, pieces a sequence, offset), sorted.

    The pieces of a length with ranks from `first rank` up to the next row's go `pieces a sequence` to each sequence
    from `first sequence` on, side by side from `offset` on.
    """
    tree, runs, rows, sequences = TightestTree(capacity), {}, [], 0

    def leave(base: int, n: int, room: int) -> None:
        if room > 0 and n:
            runs.setdefault(room, []).append((base, n))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"no window of {capacity} holds a piece of {length}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, base, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                base, n = runs[room].pop()
                if not runs[room]:
                    tree.put(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, base, each, capacity - room))
                leave(base, full, room - each * length)
                left, rank, base, n = left - full * each, rank + full * each, base + full, n - full
            if n and 0 < left < each:  # the last pieces of this length share one window
                rows.append((length, rank, base, left, capacity - room))
                leave(base, 1, room - left * length)
                left, base, n = 0, base + 1, n - 1
            if n:
                leave(base, n, room)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, memo: tuple[int, int] = (MOST_WORDS, TOGETHER)) -> DataFrame:
    """Tokenizes whole texts and cuts each into full windows and a rest: one row a piece, with its ids or their crc32.

    task and local number the pieces of each length within a task.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, task, met = encoder(tokenizer, *memo), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            row, start, length, total, crc, local, data = [], [], [], [], [], [], []
            for i, ids in enumerate(to_ids.stream(batch.column(1), end_id)):
                ids = ids.astype("<u4", copy=False)
                for a in range(0, len(ids), capacity):
                    piece = ids[a : a + capacity].tobytes()
                    n = len(piece) // 4
                    row.append(i), start.append(a), length.append(n), total.append(len(ids)), crc.append(zlib.crc32(piece)), local.append(met[n])
                    met[n] += 1
                    if keep_ids:
                        data.append(piece)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total, crc, np.full(len(row), task), local))]
            names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "task", "local"]
            if keep_ids:
                columns.append(pa.array(data, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long, task long, local long" + ", ids binary" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, memo: tuple[int, int] = (MOST_WORDS, TOGETHER), small: int = SMALL) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids its ids.

    ids are little-endian unsigned 32-bit integers. Sequences are filled from offset 0 without gaps; what lies beyond a
    sequence's last piece is padding.
    """
    pieces = materialise(cut(docs, tokenizer or default_tokenizer(), capacity, end_id, keep_ids, memo), "pieces")
    counts = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_windows(histogram, capacity))
    # A piece's rank among those of its length: its number in its task after those of earlier tasks. The numbers are a
    # row a task and length; where they are few they go to the pieces, so that these and their ids are not shuffled.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= small:
        base = F.broadcast(base)
    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("local") + F.col("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows, n = plan.value, length.to_numpy()
        at = np.searchsorted((rows[:, 0] << 44) + rows[:, 1], (n << 44) + rank.to_numpy(), "right") - 1
        _, first, base, each, offset = rows[at].T
        i = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": base + i // each, "offset": offset + i % each * n})

    # Only two numbers a piece reach Python; its ids do not.
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    return ranked.withColumn("__at", place("length", "rank")).select(*names, "__at.sequence_id", "__at.offset")
