"""Benchmark decontamination: short test items found inside long documents by containment of five-word shingles.

A document is a hit for an item when it holds at least 0.8 of the item's distinct shingles (A-Z lower-cased, words between
ASCII white space). Items are partitioned by their number of shingles; every item of a partition is indexed under its
min-wise sketch, the shingles with the smallest hashes. The sketch length follows from the partition's largest size: an
item with q shingles of which at least 0.8 q lie in a document misses fewer than the sketch holds, so at least one sketch
entry lies in the document whatever the document's length. Search therefore has recall 1; candidates are verified by the
exact shingles themselves.

The stated test set is taken in blocks of at most BLOCK items, each block one pass over all documents, so what is shipped
to the tasks is bounded however long the test set is.

Defined cases: items of one to four words are one shingle of all their words; items without words, null items and null
texts match nothing; repeated item rows count once; repeated documents are matched each on its own; empty tables give no
rows; other columns are kept by `drop_contaminated` and ignored by `contaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ship, tidied

WIDTH, THRESHOLD = 5, 0.8
BLOCK = 20_000
BITS = 22
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH)], np.uint64)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += word_hashes[k : k + n] * _POWERS[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def shingles(words: list[bytes], width: int) -> list[bytes]:
    return [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


def held(want: np.ndarray, sorted_: np.ndarray) -> int:
    """How many of the wanted hashes are among the sorted ones."""
    return int((sorted_[np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)] == want).sum())


class Index:
    """The items of one block: sketches by partition, and the exact shingles for verification."""

    def __init__(self, items: list[tuple], threshold: float = THRESHOLD):
        self.items, hashes, owners = [], [], []
        memo = WordHashes()
        for item_id, text in items:
            words = (text or "").encode("utf-8", "replace").lower().split()
            if not words:
                continue
            width = min(WIDTH, len(words))
            exact = set(shingles(words, width))
            hashed = np.unique(shingle_hashes(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), width))
            need = math.ceil(threshold * len(exact) - 1e-9)
            largest = (1 << len(exact).bit_length()) - 1  # of the item's size partition
            sketch = hashed[: largest - math.ceil(threshold * largest - 1e-9) + 1]
            hashes.append(sketch), owners.append(np.full(len(sketch), len(self.items)))
            self.items.append((item_id, width, exact, hashed, need))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.widths = sorted({x[1] for x in self.items})
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def search(self, text: bytes, memo: WordHashes) -> list[tuple[int, int, int]]:
        """(item number, its shingles, those the text holds) of every hit."""
        words = text.lower().split()
        if not words or not self.items:
            return []
        hashed = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        out = []
        for width in self.widths:
            mine = shingle_hashes(hashed, width)
            some = mine[self.maybe[(mine >> np.uint64(64 - BITS)).astype(np.int64)]]
            if not len(some):
                continue
            some, sorted_ = np.unique(some), np.unique(mine)
            low, high = np.searchsorted(self.hashes, some, "left"), np.searchsorted(self.hashes, some, "right")
            candidates = sorted({int(o) for a, b in zip(low, high, strict=True) for o in self.owners[a:b]})
            exact = None
            for c in candidates:
                _, its_width, want, want_hashes, need = self.items[c]
                if its_width != width or held(want_hashes, sorted_) < min(need, len(want_hashes)):
                    continue
                exact = exact if exact is not None else set(shingles(words, width))
                if (shared := len(want & exact)) >= need:
                    out.append((c, len(want), shared))
        return out


def index_of(shared: Broadcast, threshold: float) -> Index:
    """The index of a block, built once a worker process."""
    if getattr(shared, "_index", None) is None:
        shared._index = Index(shared.value, threshold)
    return shared._index


def blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple]]:
    """The test set in blocks of about `size` items, each small enough to be shipped to every task."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    n = max(1, math.ceil(items.count() / size))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for every pair: doc_id, item_id, n_shingles, n_shared, containment."""
    ship(docs.sparkSession)
    id_kind = dict(items.dtypes)["item_id"]
    id_arrow = items.select("item_id").limit(0).toArrow().schema.field(0).type
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = None
    for rows in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, memo = index_of(shared, threshold), WordHashes()
            for batch in batches:
                row, hit = [], []
                for i, text in enumerate(batch.column(1).cast(pa.binary())):
                    for h in index.search(text.as_py() or b"", memo):
                        row.append(i), hit.append(h)
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array([index.items[h[0]][0] for h in hit], id_arrow)]
                columns += [pa.array([h[k] for h in hit], pa.int64()) for k in (1, 2)] + [pa.array([h[2] / h[1] for h in hit], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        part = texts.mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {id_kind}, n_shingles long, n_shared long, containment double")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """docs without those that hold an item; each block of items is one narrow filter, no shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index("text")
    for rows in blocks(items, block):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, memo = index_of(shared, threshold), WordHashes()
            for batch in batches:
                clean = [not index.search(t.as_py() or b"", memo) for t in batch.column(place).cast(pa.binary())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(tidied(run), docs.schema)
    return docs
