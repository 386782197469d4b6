"""Periodic runs of words: found by block matching, and collapsed to their first period.

A run of smallest period q and length L >= max(least, 2 q) repeats L - q >= max(q, least - q) words at distance q, so it
holds an aligned block of b words that stands q words later again, b the largest power of two with 2 b - 1 <=
max(q, least - q). Scale by scale, the aligned blocks are the integer-sequence keys of one Aho-Corasick automaton, which
is run across the whole document; occurrences at a distance that belongs to the scale are seeds, and each seed grows word
by word in both directions to the whole run. Nothing is missed and nothing is capped: blocks are left out only where a
4-gram of theirs does not come again within the scale's reach, or where they lie within a run of shorter period, whose
multiples are no smallest periods.

Documents are independent, so there is no shuffle; a task holds one document's words and an automaton of NODES words.

Defined cases: null and empty texts, and texts of fewer than `least` words, have no runs; texts of any length are read
whole; repeated rows are judged each on its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied

#: Words that a run has at least.
LEAST = 12
#: Words of the grams that tell which blocks can come again.
GRAM = 4
#: Words of the keys that one automaton holds; more keys take several passes over the document.
NODES = 1 << 19
FAR = np.iinfo(np.int64).max

Run = tuple[int, int, int]


@lru_cache(maxsize=64)
def distances(block: int, least: int) -> np.ndarray:
    """The periods q whose runs hold an aligned block of this many words: 2 block - 1 <= max(q, least - q) < 4 block - 1."""
    q = np.arange(1, max(4 * block - 1, least) + 1)
    need = np.maximum(q, least - q)
    return q[(2 * block - 1 <= need) & (need < 4 * block - 1)]


def comes_again(ids: np.ndarray, size: int) -> np.ndarray:
    """For each place, how far ahead its gram of `size` words stands again; FAR where it does not.

    Grams are told apart by a 64-bit mix: two that clash only make a block a candidate for nothing.
    """
    mix = np.uint64(0x9E3779B97F4A7C15)
    keys = ids[: len(ids) - size + 1].astype(np.uint64)
    for k in range(1, size):
        keys = (keys + np.uint64(1)) * mix ^ ids[k : len(ids) - size + 1 + k].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), FAR)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class Covered:
    """Tells which stretches lie within one of the given runs."""

    def __init__(self, runs: list[Run]):
        spans = np.array(sorted((s, e) for s, e, _ in runs), np.int64).reshape(-1, 2)
        self.starts, self.ends = spans[:, 0], np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(len(start), bool)
        k = np.searchsorted(self.starts, start, "right") - 1
        return (k >= 0) & (self.ends[np.maximum(k, 0)] >= end)


def candidate_blocks(again: np.ndarray, n: int, block: int, first: int, last: int, covered: Covered) -> np.ndarray:
    """Starts of aligned blocks that can stand again `first` to `last` words later and are not settled by shorter periods."""
    gram, rows = min(block, GRAM), n // block
    far = np.zeros(rows * block, bool)
    use = min(len(again), len(far))
    far[:use] = again[:use] > last
    at = np.flatnonzero(~far.reshape(rows, block)[:, : block - gram + 1].any(axis=1)) * block
    at = at[at + first + block <= n]
    return at[~covered(at, np.minimum(at + last + block, n))] if len(at) else at


def occurrences(words: tuple[int, ...], at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key number of each block, and (key number, start) of every place in the document where a key stands."""
    numbers: dict[tuple[int, ...], int] = {}
    of = np.fromiter((numbers.setdefault(words[t : t + block], len(numbers)) for t in at.tolist()), np.int64, len(at))
    keys, found = list(numbers), []
    share = max(1, NODES // block)
    for k in range(0, len(keys), share):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, key in enumerate(keys[k : k + share], k):
            automaton.add_word(key, number)
        automaton.make_automaton()
        found += automaton.iter(words)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return of, pairs[:, 1], pairs[:, 0] - block + 1


def seeds(words: tuple[int, ...], at: np.ndarray, block: int, periods: np.ndarray, covered: Covered) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks that stand again at one of the periods, by distance and start."""
    of, key, place = occurrences(words, at, block)
    wide = len(words) + 1
    codes = np.sort(key * wide + place)
    low = np.searchsorted(codes, of * wide + at + periods[0])
    high = np.searchsorted(codes, of * wide + np.minimum(at + periods[-1], len(words)), "right")
    n = high - low
    ends = np.cumsum(n)
    places = codes[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(low, n)] % wide
    start = np.repeat(at, n)
    period = places - start
    good = ~covered(start, places + block)
    if len(periods) <= periods[-1] - periods[0]:  # those of one scale that do not follow each other
        good &= np.isin(period, periods)
    start, period = start[good], period[good]
    order = np.lexsort((start, period))
    return start[order], period[order]


def grown(ids: np.ndarray, start: int, block: int, period: int) -> Run:
    """The whole stretch around a seed that keeps its period."""
    low, high, n = start, start + block, len(ids)
    step = 32
    while high + period < n:
        to = min(high + step, n - period)
        differ = ids[high:to] != ids[high + period : to + period]
        if differ.any():
            high += int(differ.argmax())
            break
        high, step = to, step * 2
    step = 32
    while low > 0:
        to = max(low - step, 0)
        differ = ids[to:low] != ids[to + period : low + period]
        if differ.any():
            low -= int(differ[::-1].argmax())
            break
        low, step = to, step * 2
    return low, high + period, period


def find_runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, end, smallest period) of every run, by start and period."""
    n = len(ids)
    if n < max(least, 2):
        return []
    again: dict[int, np.ndarray] = {}
    near: dict[int, np.ndarray] = {}
    words: tuple[int, ...] = ()
    runs: list[Run] = []
    block = 1
    while 2 * block - 1 <= max(n // 2, least - 1) and block <= n:
        periods, gram = distances(block, least), min(block, GRAM)
        if gram not in again and len(periods):
            again[gram] = comes_again(ids, gram)
            near[gram] = np.sort(again[gram][again[gram] < FAR])
        # Most documents end here: fewer grams come again in reach than one block has.
        if len(periods) and periods[0] <= n // 2 and np.searchsorted(near[gram], periods[-1], "right") > block - gram:
            periods = periods[periods <= n // 2]
            covered = Covered([r for r in runs if r[2] <= min(block, periods[0])])
            at = candidate_blocks(again[gram], n, block, int(periods[0]), int(periods[-1]), covered)
            if len(at):
                words = words or tuple(ids.tolist())
                last, settled = 0, 0
                for start, period in zip(*(x.tolist() for x in seeds(words, at, block, periods, covered)), strict=True):
                    if period == last and start < settled:
                        continue
                    run = grown(ids, start, block, period)
                    last, settled = period, run[1] - period
                    if run[1] - run[0] >= max(least, 2 * period):
                        runs.append(run)
        block *= 2
    shortest: dict[tuple[int, int], int] = {}
    for start, end, period in runs:  # a stretch with a shorter period has its multiples too
        shortest[start, end] = min(period, shortest.get((start, end), period))
    return sorted((s, e, q) for (s, e), q in shortest.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for the words of a run behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, end, period in runs:
        depth[start + period] += 1
        depth[end] -= 1
    return np.cumsum(depth[:-1]) == 0


def runs(docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length, period, by start and period), and the collapsed text: its
    words without those of a run behind its first period, joined by one space. rewrite(doc_id, words) may give other words.
    """
    ship(docs.sparkSession)
    one = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                if rewrite:
                    words = rewrite(doc_id.as_py(), words)
                numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                own = find_runs(ids, least) if len(numbers) < len(words) else []
                if own:
                    words = [w for w, keep in zip(words, kept_words(len(words), own).tolist(), strict=True) if keep]
                counts.append(len(ids))
                found.append([{"start": s, "length": e - s, "period": q} for s, e, q in own])
                texts.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(one)), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), schema)
