"""Exact removal of repeated byte strings by longest-previous-factor arrays over suffix order.

A byte goes when a string of WIDTH bytes over it also starts anywhere else, in the same document or another one. The same
machinery over words instead of bytes tells the documents that share a passage of WORDS words or more with another document;
these passages are not removed (over 50 short words may have fewer than WIDTH bytes).

Buckets. A suffix array of a whole corpus fits no task, so suffixes are dealt into buckets that no pair of equal strings
can straddle: a start's bucket is the least hash of the grams inside its string, a function of that string alone.
Neighbouring starts mostly share it, so a document is a few runs of starts per kilobyte, each with the span its strings
cover. Runs alone in their bucket are done. A span that occurs twice as a whole is repeated as a whole; one of its copies
stays in its bucket as a partner for the others.

Longest previous factors. What is left of a bucket goes to one task, which sorts its suffixes (prefix doubling, ties by
position), takes the common prefixes of neighbours, and finds the previous and the next smaller position in suffix order of
every start. The longer of the two common prefixes is its longest previous factor, capped at the width: a start that
reaches the width is a later copy, and the position it was found at is an earlier one. The named method keeps the
earlier ones; here both go, as strings are judged on the input.

Hot buckets. A bucket over BUCKET bytes is cut into parts. A part finds its own repeats as above and hands on each string
once, as stretches of consecutive starts, marked where still unresolved. Stretches are dealt into buckets again by another
hash and longer grams, which leave strings with rare bytes alone in their bucket; so a group of copies shrinks to one copy
a part and its edits drop out. After LEVELS such rounds, strings that are left meet by their hashes, a row a string.

Text moves once, and only of documents with a shared bucket: a bitmap of fixed size tells the others, whose texts
are hashed where they are read.

Defined cases: null text is empty; texts under the width stay whole; repeated rows are copies of each other; rows that
share a doc_id but not the text are documents of their own, and those that share both are one where passages are told; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, key_bitmap, marked, materialise, ship, tidied

WIDTH, GRAM = 400, 200
WORDS, WORD_GRAM = 51, 24
BUCKET, LEVELS = 1 << 20, 6
CHUNK = 1 << 20
BASE = 0x5851F42D4C957F2D
MIX = np.uint64(0x9FB21C651E98DF25)
ITEM = "bucket long, open boolean, key long, crc long, first long, n long, span binary"
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def base_of(level: int) -> int:
    """An odd multiplier for each round of dealing."""
    return (BASE + 2 * level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF | 1


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte value, and the powers of the base and of its inverse modulo 2^64."""
    have = _tables.get(base)
    if have is None or len(have[1]) < n:
        n = max(n, 1 << 16, 2 * len(have[1]) if have else 0)
        inverse = pow(base, -1, 1 << 64)
        values = np.frombuffer(hashlib.shake_256(str(base).encode()).digest(2048), np.uint64).copy()
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _tables[base] = (values, np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def gram_hashes(data: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """A mixed 64-bit hash of every run of `width` symbols: bytes, or words as their hashes."""
    n = len(data)
    values, up, down = _powers(n, base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values[data] if data.dtype == np.uint8 else data) * up[:n], out=sums[1:])
    h = (sums[width:] - sums[: n - width + 1]) * down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, width: int, gram: int, base: int = BASE) -> Iterator[tuple[int, int, int, bool]]:
    """(first start, starts, bucket, whether the bucket's gram occurs twice in the run) of every run of starts."""
    for at in range(0, len(data) - width + 1, CHUNK):
        part = data[at : at + CHUNK + width - 1]
        h = gram_hashes(part, gram, base)
        least, size, span = h, 1, width - gram + 1
        while 2 * size <= span:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        least = np.minimum(least[: len(h) - span + 1], least[span - size :])
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        firsts = np.concatenate([[0], cuts]).tolist()
        for a, b, value in zip(firsts, [*firsts[1:], len(least)], least[firsts].tolist(), strict=True):
            yield at + a, b - a, value, int(np.count_nonzero(h[a : b + span - 1] == value)) > 1


class Suffixes:
    """Ranks of all suffixes by their first symbols, by prefix doubling up to `width`; equal prefixes have equal ranks."""

    def __init__(self, data: np.ndarray, width: int):
        self.n, self.width = len(data), width
        if data.dtype == np.uint8:
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            self.first, have = np.zeros(self.n, np.uint64), 8
            for k in range(8):
                self.first |= padded[k : k + self.n].astype(np.uint64) << np.uint64(56 - 8 * k)
        else:
            self.first, have = None, 1
        rank = np.unique(data if self.first is None else self.first, return_inverse=True)[1].astype(np.int32)
        self.levels = [(have, rank)]
        while 2 * have <= width:
            rank, have = self._join(rank, have), 2 * have
            self.levels.append((have, rank))
        self.rank = self._join(rank, width - have) if have < width else rank

    def _join(self, rank: np.ndarray, step: int) -> np.ndarray:
        later = np.zeros(self.n, np.int64)
        later[: self.n - step] = rank[step:]
        later[: self.n - step] += 1
        key = rank * (int(later.max()) + 1) + later
        order = np.argsort(key, kind="stable")
        out = np.empty(self.n, np.int32)
        out[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes a[i] and b[i], capped at the width."""
        out = np.zeros(len(a), np.int64)
        steps = [(size, lambda i, r=r: r[i]) for size, r in reversed(self.levels)]
        if self.first is not None:
            steps += [(size, lambda i, s=size: self.first[i] >> np.uint64(64 - 8 * s)) for size in (4, 2, 1)]
        for size, of in steps:
            fits = np.flatnonzero(out + size <= self.width)
            x, y = a[fits] + out[fits], b[fits] + out[fits]
            inside = np.maximum(x, y) < self.n
            fits, x, y = fits[inside], x[inside], y[inside]
            out[fits[of(x) == of(y)]] += size
        return out


def nearest_smaller(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it with a smaller position (-1: none), and their common prefix.

    Every place points at one before it such that all between are greater; pointers that are not there yet jump along
    the pointer of where they are, all at once.
    """
    n = len(position)
    bound, at, least = np.append(position, -1), np.arange(-1, n - 1), common.copy()
    least[:1] = 0
    open_ = np.arange(n)
    while len(open_ := open_[bound[at[open_]] > position[open_]]):
        via = at[open_]
        least[open_] = np.minimum(least[open_], least[via])
        at[open_] = at[via]
    return at, least


def longest_previous(suffixes: Suffixes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each start (ascending): its longest previous factor, capped at the width, and the number of the start it is found at."""
    order = np.argsort(suffixes.rank[starts], kind="stable")
    n = len(order)
    common = np.zeros(n, np.int64)
    common[1:] = suffixes.common(starts[order[:-1]], starts[order[1:]])
    before, left = nearest_smaller(order, common)
    after, right = nearest_smaller(order[::-1], np.concatenate([[0], common[:0:-1]]))
    after, right = n - 1 - after[::-1], right[::-1]
    found = np.where(left >= right, before, np.where(after < n, after, -1))
    factor, source = np.empty(n, np.int64), np.empty(n, np.int64)
    factor[order] = np.maximum(left, right)
    source[order] = np.where(found >= 0, order[found], -1)
    return factor, source


def shared_by(rank: np.ndarray, document: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each start whether its string is another document's too; `others` marks strings that two documents have already."""
    order = np.lexsort((document, rank))
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    last = np.append(first[1:], len(order)) - 1
    many = (document[order][first] != document[order][last]) | np.maximum.reduceat(others[order].astype(np.int8), first).astype(bool)
    out = np.empty(len(rank), bool)
    out[order] = np.repeat(many, last - first + 1)
    return out


def judge(spans: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all starts of the spans: span number, offset, whether an earlier start has its string, whether any other has, and the string's rank."""
    lengths = np.fromiter(map(len, spans), np.int64, len(spans))
    counts = lengths - width + 1
    owner = np.repeat(np.arange(len(spans)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + offset
    suffixes = Suffixes(np.concatenate(spans), width)
    factor, source = longest_previous(suffixes, starts)
    later = factor >= width
    both = later.copy()
    both[source[later]] = True
    return owner, offset, later, both, suffixes.rank[starts]


def stretches(owner: np.ndarray, offset: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first offset, number and kind of every stretch of consecutive starts of one kind."""
    if not len(owner):
        return owner, offset, offset, kind
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (kind[1:] != kind[:-1])]))
    return owner[first], offset[first], np.diff(np.append(first, len(owner))), kind[first]


def removed(text: bytes, cuts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs removed, and what is left, for sorted intervals."""
    merged: list[list[int]] = []
    for a, b in cuts:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(text[at:a])
        at = b
    return sum(b - a for a, b in merged), len(merged), b"".join([*left, text[at:]])


def is_words() -> Column:
    return F.col("bucket").bitwiseAND(F.lit(1).cast("long")) == 1


class Shape:
    """Widths and grams of the two kinds of symbols; a bucket's lowest bit is its kind (1: words)."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM, words: int = WORDS, word_gram: int = WORD_GRAM):
        self.width, self.gram = (width, words), (gram, word_gram)

    def of(self) -> Column:
        return F.when(is_words(), self.width[1]).otherwise(self.width[0])

    def symbols(self, span: bytes, kind: int) -> np.ndarray:
        return np.frombuffer(span, (np.uint8, np.uint64)[kind])

    def runs(self, span: bytes, kind: int, level: int = 0) -> Iterator[tuple[int, int, int, bool, bytes]]:
        """first, starts, bucket, twice and the span of every run; later levels have longer grams."""
        width, size = self.width[kind], (1, 8)[kind]
        gram = self.gram[kind] if not level else max(self.gram[kind], width * 3 // 4)
        for a, n, b, twice in runs(self.symbols(span, kind), width, gram, base_of(level)):
            yield a, n, b & ~1 | kind, twice, span[a * size : (a + n + width - 1) * size]


def word_symbols(text: bytes, memo: WordHashes) -> bytes:
    words = text.split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)).tobytes()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64("doc_id", body).alias("key"), F.crc32(body).cast("long").alias("crc"), body.alias("body"))


def _runs_of(keyed: DataFrame, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            held, row = [], []

            def out(batch: pa.RecordBatch) -> pa.RecordBatch:
                table = np.array(held, np.uint64).reshape(-1, 6)
                at = pa.array(row, pa.int64())
                bucket, s1, s2, first, n = (pa.array(table[:, k].view(np.int64)) for k in range(5))
                return pa.RecordBatch.from_arrays([bucket, s1, s2, pa.array(table[:, 5] > 0), batch.column(0).take(at), batch.column(1).take(at), first, n], ["bucket", "s1", "s2", "twice", "key", "crc", "first", "n"])

            for i, body in enumerate(batch.column(2)):
                text = body.as_py()
                for kind in (0, 1):
                    if len(text) < (shape.width[0], 2 * shape.width[1] - 1)[kind]:
                        continue
                    for a, n, b, twice, span in shape.runs(word_symbols(text, memo) if kind else text, kind):
                        d = xxhash.xxh3_128_intdigest(span)
                        row.append(i)
                        held.append((b, d >> 64, d & 0xFFFFFFFFFFFFFFFF, a, n, twice))
                if len(held) > 20_000:
                    yield out(batch)
                    held, row = [], []
            if held:
                yield out(batch)

    return keyed.select("key", "crc", "body").mapInArrow(tidied(run), "bucket long, s1 long, s2 long, twice boolean, key long, crc long, first long, n long")


def _again(items: DataFrame, shape: Shape, level: int) -> DataFrame:
    """Stretches of a hot bucket dealt into buckets of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, (bucket, span) in enumerate(zip(batch.column(0).to_pylist(), batch.column(6), strict=True)):
                kind = bucket & 1
                for a, n, b, twice, part in shape.runs(span.as_py(), kind, level):
                    d = xxhash.xxh3_128_intdigest(part)
                    mixed = xxhash.xxh64_intdigest(b.to_bytes(8, "little") + bucket.to_bytes(8, "little", signed=True)) & ~1 | kind
                    row.append(i), found.append((mixed, d >> 64, d & 0xFFFFFFFFFFFFFFFF, twice, a, n, part))
            at, (bucket, s1, s2, twice, first, n, span) = pa.array(row, pa.int64()), zip(*found, strict=True) if found else [[]] * 7
            first = pa.array(batch.column(4).take(at).to_numpy() + np.array(first, np.int64))
            columns = [_signed(bucket), batch.column(1).take(at), batch.column(2).take(at), batch.column(3).take(at), first, pa.array(n, pa.int64()), pa.array(span, pa.binary()), _signed(s1), _signed(s2), pa.array(twice, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "open", "key", "crc", "first", "n", "span", "s1", "s2", "twice"])

    return items.select("bucket", "open", "key", "crc", "first", "n", "span").mapInArrow(tidied(run), ITEM + ", s1 long, s2 long, twice boolean")


def _cut(texts: DataFrame, wanted: DataFrame, shape: Shape) -> DataFrame:
    """The spans that are wanted of each document, as items with their part."""
    names = ["part", "bucket", "hot", "open", "first", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            lists = batch.column(3)
            items = lists.flatten()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            bucket, first, n = (items.field(k).to_numpy() for k in (1, 4, 5))
            kinds, spans, last = bucket & 1, [], (None, None)
            for i in np.lexsort((kinds, row)).tolist():
                kind = int(kinds[i])
                if last != (row[i], kind):
                    text, last = batch.column(2)[int(row[i])].as_py(), (row[i], kind)
                    text = word_symbols(text, memo) if kind else text
                size = (1, 8)[kind]
                spans.append((i, text[first[i] * size : (first[i] + n[i] + shape.width[kind] - 1) * size]))
            at = pa.array([i for i, _ in spans], pa.int64())
            owner = pa.array(row).take(at)
            columns = [*(items.field(k).take(at) for k in range(4)), batch.column(0).take(owner), batch.column(1).take(owner), *(items.field(k).take(at) for k in (4, 5)), pa.array([s for _, s in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names[:4], "key", "crc", *names[4:], "span"])

    asked = wanted.groupBy("key", "crc").agg(F.collect_list(F.struct(*names)).alias("w"))
    joined = texts.join(asked, ["key", "crc"]).select("key", "crc", "body", "w")
    return joined.mapInArrow(tidied(run), "part long, bucket long, hot boolean, open boolean, key long, crc long, first long, n long, span binary")


def _locals(items: DataFrame, shape: Shape, hot: bool) -> DataFrame:
    """Longest previous factors over each bucket, or part of a hot one: intervals (no span), and of a hot part its strings."""

    def settle(held: list[tuple], kind: int) -> list[tuple]:
        size, width = (1, 8)[kind], shape.width[kind]
        owner, offset, later, both, rank = judge([shape.symbols(h[7], kind) for h in held], width)
        asked = np.array([h[2] for h in held], bool)[owner]
        if kind:
            both = shared_by(rank, np.array([h[3] for h in held])[owner], ~asked)
        out, met = [], asked & both
        for o, a, n, _ in zip(*(x.tolist() for x in stretches(owner[met], offset[met], met[met])), strict=True):
            _, bucket, _, key, crc, first, _, _ = held[o]
            out.append((bucket, True, key, crc, first + a, n + width - 1, None))
        if hot:
            kept = ~later
            for o, a, n, open_ in zip(*(x.tolist() for x in stretches(owner[kept], offset[kept], (asked & ~both)[kept])), strict=True):
                _, bucket, _, key, crc, first, _, span = held[o]
                out.append((bucket, open_, key, crc, first + a, n, span[a * size : (a + n + width - 1) * size]))
        return out

    def flush(held: list[tuple]) -> pa.RecordBatch:
        out = []
        for kind in (0, 1):
            if mine := [h for h in held if h[1] & 1 == kind]:
                out += settle(mine, kind)
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bucket", "open", "key", "crc", "first", "n", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0] and (hot or size >= BUCKET // 2):
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield flush(held)

    dealt = items.repartition("part").sortWithinPartitions("part")
    return dealt.select("part", "bucket", "open", "key", "crc", "first", "n", "span").mapInArrow(tidied(run), ITEM)


def _strings(items: DataFrame, shape: Shape) -> DataFrame:
    """The last resort for strings that every round left in a hot bucket: a row each, with two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (bucket, n, span) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), batch.column(6), strict=True)):
                data, width = shape.symbols(span.as_py(), bucket & 1), shape.width[bucket & 1]
                same = [batch.column(k).take(pa.array(np.full(n, i))) for k in range(4)]
                first = pa.array(batch.column(4)[i].as_py() + np.arange(n))
                hashes = [pa.array(gram_hashes(data, width, base_of(-k)).view(np.int64)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*same, first, *hashes], ["bucket", "open", "key", "crc", "first", "h1", "h2"])

    return items.select("bucket", "open", "key", "crc", "first", "n", "span").mapInArrow(tidied(run), "bucket long, open boolean, key long, crc long, first long, h1 long, h2 long")


def _counts(open_: str | None = None) -> list[Column]:
    """What tells whether a group of spans or strings repeats: their number, their documents, and partners among them."""
    return [F.count("*").alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"), (F.min(open_) if open_ else F.lit(True)).alias("all_open")]


def _many() -> Column:
    """Bytes repeat anywhere; words in another document, for which a partner stands."""
    return F.when(is_words(), (F.col("lo") != F.col("hi")) | ~F.col("all_open")).otherwise(F.col("c") > 1)


def _parts(spans: DataFrame, size: Column, bucket: int) -> DataFrame:
    """Distinct spans with the part they go to; buckets without an open span are done."""
    loads = spans.groupBy("bucket").agg(F.sum(size).alias("load"), F.max("open").alias("any")).filter("any").select("bucket", "load")
    split = F.when(F.col("load") > bucket, F.pmod(F.xxhash64("s1", "s2"), F.ceil(F.col("load") / bucket))).otherwise(0)
    return spans.join(loads, "bucket").withColumn("part", F.xxhash64("bucket", split)).withColumn("hot", F.col("load") > bucket)


def find(docs: DataFrame, shape: Shape, bucket: int = BUCKET, levels: int = LEVELS) -> tuple[DataFrame, bytes]:
    """Intervals (bucket, key, crc, first, n) of repeated strings, and the bitmap of the documents that may have some."""
    ship(docs.sparkSession)
    keyed = _keyed(docs)
    found = materialise(_runs_of(keyed, shape), "lpf-runs")
    shared = found.groupBy("bucket").agg(*_counts(), F.max("twice").alias("t")).filter(_many() | (F.col("t") & ~is_words())).select("bucket")
    kept = materialise(found.join(shared, "bucket"), "lpf-shared")
    discard(found)
    bits = key_bitmap(kept, ["key", "crc"])

    # A row a distinct span: whether it is repeated, and where it occurs first.
    covered = (F.col("n") + shape.of() - 1).alias("n")
    spans = kept.groupBy("bucket", "s1", "s2").agg(*_counts(), F.min(F.struct("key", "crc", "first", "n")).alias("at"))
    whole = kept.join(spans.filter(_many()).select("bucket", "s1", "s2"), ["bucket", "s1", "s2"]).select("bucket", "key", "crc", "first", covered)
    spans = spans.select("bucket", "s1", "s2", (~_many()).alias("open"), "at.*")
    width = F.when(is_words(), 8).otherwise(1)
    wanted = _parts(spans, (F.col("n") + shape.of() - 1) * width, bucket)
    texts = marked(keyed, ["key", "crc"], bits, True).dropDuplicates(["key", "crc"]).select("key", "crc", "body")
    items = materialise(_cut(texts, wanted, shape), "lpf-spans")
    plain = lambda df: df.filter("span is null").select("bucket", "key", "crc", "first", "n")
    intervals = whole.unionByName(plain(_locals(items.filter("not hot"), shape, False)))
    hot = items.filter("hot")
    for level in range(1, levels + 1):
        if hot.isEmpty():
            break
        settled = materialise(_locals(hot, shape, True), "lpf-hot")
        intervals = intervals.unionByName(plain(settled))
        again = materialise(_again(settled.filter("span is not null"), shape, level), "lpf-again")
        shared = again.groupBy("bucket").agg(*_counts("open"), F.max("twice").alias("t"), F.max("open").alias("o")).filter(F.col("o") & (_many() | (F.col("t") & ~is_words()))).select("bucket")
        again = again.join(shared, "bucket")
        spans = again.groupBy("bucket", "s1", "s2").agg(*_counts("open"), F.max("open").alias("o"), F.min(F.struct("key", "crc", "first", "n")).alias("at"), F.first("span").alias("span"))
        twice = spans.filter(F.col("o") & _many()).select("bucket", "s1", "s2")
        intervals = intervals.unionByName(again.filter("open").join(twice, ["bucket", "s1", "s2"]).select("bucket", "key", "crc", "first", covered))
        spans = spans.select("bucket", "s1", "s2", (F.col("o") & ~_many()).alias("open"), "at.*", "span")
        items = materialise(_parts(spans, F.octet_length("span"), bucket), "lpf-items")
        intervals = intervals.unionByName(plain(_locals(items.filter("not hot"), shape, False)))
        hot = items.filter("hot")
    else:
        if not hot.isEmpty():
            strings = materialise(_strings(hot, shape), "lpf-strings")
            twice = strings.groupBy("bucket", "h1", "h2").agg(*_counts("open"), F.max("open").alias("o")).filter(F.col("o") & _many()).select("bucket", "h1", "h2")
            late = strings.filter("open").join(twice, ["bucket", "h1", "h2"])
            intervals = intervals.unionByName(late.select("bucket", "key", "crc", "first", shape.of().cast("long").alias("n")))
    return intervals, bits


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket: int = BUCKET, keep_text: bool = False, words: int = WORDS, word_gram: int = WORD_GRAM, levels: int = LEVELS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage, and with keep_text what is left (binary).

    shares_passage: whether a passage of at least `words` words is another document's too.
    """
    intervals, bits = find(docs, Shape(width, gram, words, word_gram), bucket, levels)
    kind = F.when(is_words(), 1).otherwise(0)
    cuts = intervals.groupBy("key", "crc").agg(F.array_sort(F.collect_set(F.struct(kind.alias("kind"), "first", "n"))).alias("cuts"))
    keyed = _keyed(docs)
    texts = marked(keyed, ["key", "crc"], bits, True).join(cuts, ["key", "crc"], "left")
    id_kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = [], batch.column(2).fill_null([])
            items, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            of, first, n = (items.field(k).to_numpy() for k in range(3))
            for body, (a, b) in zip(batch.column(1), pairwise(bounds.tolist()), strict=True):
                text, split = body.as_py(), a + int(np.searchsorted(of[a:b], 1))
                m, k, left = removed(text, list(zip(first[a:split].tolist(), (first[a:split] + n[a:split]).tolist(), strict=True)))
                out.append((len(text), m, k, hashlib.sha256(left).hexdigest(), split < b, left))
            kinds = [*[pa.int64()] * 3, pa.string(), pa.bool_(), *[pa.binary()] * keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", *["text"] * keep_text])

    schema = f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean" + ", text binary" * keep_text
    touched = texts.select("doc_id", "body", "cuts").mapInArrow(tidied(run), schema)
    zero = F.lit(0).cast("long")
    free = marked(keyed, ["key", "crc"], bits, False).select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"), F.lit(False).alias("shares_passage"), *([F.col("body").alias("text")] if keep_text else []))
    return touched.unionByName(free)
