"""Hidden Markov language model over whole documents.

Counts. Every word of every learning document is counted; the table of counts grows with the corpus and is only ever
joined. The HEAD most frequent words are shipped to the tasks with their counts; the counts of all others come to the
documents by one join on the word, aggregated to one row a document.

Symbols. The EMIT most frequent words emit as themselves. All others emit as one of CLASSES classes of word endings, and a
word's share of its class is (count + 1) / (class tokens + class words + 1), the last share being that of unknown words.
A document's probability is the forward probability of its symbols times these shares: a proper distribution over the
known words and one unknown word a class.

Training. Baum-Welch from a seeded random model around the corpus's symbol frequencies. Learning documents are in PARTS parts
by hash. A step adds the expected counts of a part's whole sequences, one row a symbol, sums them across partitions, puts
them in the place of the part's earlier counts, and makes the next model from the counts of all parts (incremental
expectation maximisation). A round takes every part once, so all documents count alike; rounds end when the
likelihood gains less than GAIN. Emissions are smoothed with the corpus's symbol frequencies. Blocks of
CUT tokens are worked on side by side, with the exact states at their borders, so nothing restarts inside a document.
Scoring runs the scaled forward recursion over each whole document, many documents a step.

Defined cases: null and empty texts are the end token alone; rows without a doc_id learn; without learning documents
every token has base probability 1 / 1 and the model is uniform over the symbols; repeated rows are scored each on its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learns, materialise, ship, tidied

STATES, EMIT, HEAD, CLASSES = 8, 1 << 14, 1 << 17, 512
#: The most rounds, the gain (log10 a token) below which they stop, and the parts of a round.
ROUNDS, GAIN, PARTS = 50, 0.005, 8
#: Symbols a block and blocks held at once.
CUT, TOGETHER = 256, 1_200
SMOOTH = 2_000.0
END = b""


def class_of(word: bytes) -> int:
    """The ending class of a word: a hash of its last three bytes."""
    return xxhash.xxh32_intdigest(word[-3:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """word, c over the documents given; the empty word is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update((text.as_py() or b"").lower().split())
                counts[END] += 1
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(tidied(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What is shipped to every task: the head words with their counts, and the totals."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int, class_log: np.ndarray, emit: int):
        self.code = {w: i for i, (w, _) in enumerate(head)}
        self.logs = np.log10(np.array([c for _, c in head], np.float64) + 1)
        self.own = min(emit, len(head))
        self.symbol = np.array([i if i < self.own else self.own + class_of(w) for i, (w, _) in enumerate(head)], np.int64)
        self.symbols = self.own + CLASSES
        self.total, self.distinct, self.class_log = total, distinct, class_log


def build_vocabulary(counts: DataFrame, head: int, emit: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the symbols' frequencies in the learning documents.

    The head is all words of at least a count, the least one that at most `head` words reach, found from a histogram of
    counts on a logarithmic scale (a few thousand rows), and as many of the next level, in hash order, as there is room
    for: no task sorts or sends more than the head.
    """
    level = F.floor(F.log2("c") * 64).cast("int")
    sizes = {r["l"]: r["n"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}
    least, held, tied = 1 << 30, 0, None
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > head:
            tied = k
            break
        least, held = k, held + sizes[k]
    top = counts.filter(level >= least)
    if tied is not None and held < head:
        top = top.unionByName(counts.filter(level == tied).orderBy(F.xxhash64("word"), "word").limit(head - held))
    rows = [(r["word"].encode("utf-8", "replace"), r["c"]) for r in top.toArrow().to_pylist()]
    rows.sort(key=lambda r: (-r[1], r[0]))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            k = np.fromiter((class_of(w.as_py()) for w in batch.column(0).cast(pa.binary())), np.int64, batch.num_rows)
            n += np.bincount(k, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    sums = counts.mapInArrow(tidied(classes), "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    for w, c in rows[:emit]:  # words that emit as themselves are in no class
        n[class_of(w)] -= c
        v[class_of(w)] -= 1
    vocabulary = Vocabulary(rows, total, distinct, np.log10(n + v + 1), emit)
    return vocabulary, np.concatenate([[c for _, c in rows[: vocabulary.own]], n]) + 0.5


def encode(docs: DataFrame, shared) -> DataFrame:
    """Per document: its symbols, the sums that need no join, and its words beyond the head with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        classes: dict[bytes, int] = {}
        for batch in batches:
            ids, n_tokens, n_known, logs, shares, words, times, sizes = [], [], [], [], [], [], [], [0]
            for text in batch.column(1).cast(pa.binary()):
                tokens = (text.as_py() or b"").lower().split()
                tokens.append(END)
                codes = np.fromiter(map(v.code.get, tokens, repeat(-1)), np.int64, len(tokens))
                far = np.flatnonzero(codes < 0)
                symbols = np.where(codes < 0, 0, v.symbol[codes] if len(v.symbol) else 0)
                if len(far):
                    mine = [tokens[i] for i in far.tolist()]
                    if len(classes) > 300_000:
                        classes.clear()
                    for w in mine:
                        if w not in classes:
                            classes[w] = class_of(w)
                    symbols[far] = v.own + np.fromiter(map(classes.__getitem__, mine), np.int64, len(mine))
                    found = Counter(mine)
                    words += found
                    times += found.values()
                near = codes[codes >= 0]
                classed = symbols[symbols >= v.own] - v.own
                ids.append(symbols.astype("<u4").tobytes())
                n_tokens.append(len(tokens)), n_known.append(len(near))
                logs.append(float(v.logs[near].sum()))
                shares.append(float(v.logs[near[near >= v.own]].sum() - v.class_log[classed].sum()))
                sizes.append(len(words))
            offsets = pa.array(sizes, pa.int32())
            far_words = pa.ListArray.from_arrays(offsets, pa.array(words, pa.binary()).cast(pa.string()))
            columns = [*(batch.column(i) for i in (0, 2, 3, 4)), pa.array(ids, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()), pa.array(shares, pa.float64()), far_words, pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "learns", "row", "part", "symbols", "n_tokens", "n_known", "logs", "shares", "far", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, learns boolean, row long, part int, symbols binary, n_tokens long, n_known long, logs double, shares double, far array<string>, times array<long>"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), learns("doc_id", 7).alias("learns")).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int"))
    return rows.mapInArrow(tidied(run), schema)


class Model:
    """start (S), move (S, S), emit (symbols, S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Model:
        """From expected counts, emissions smoothed with the symbols' frequencies."""
        emit = emit + SMOOTH * (frequency / frequency.sum())[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of every symbol sequence, all sequences a step, each to its end."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.empty(0, np.int64)
        sorted_ = lengths[order]
        offsets = np.cumsum(sorted_) - sorted_
        out, a = np.zeros(len(texts)), None
        active = np.searchsorted(-sorted_, -np.arange(sorted_[0] if len(texts) else 0), "left").tolist()
        for t, m in enumerate(active):
            e = self.emit[flat[offsets[:m] + t]]
            a = (self.start if a is None else a[:m] @ self.move) * e
            scale = a.sum(1)
            a /= scale[:, None]
            out[:m] += np.log10(scale)
        result = np.empty(len(texts))
        result[order] = out
        return result


class Blocks:
    """Whole sequences laid out as blocks of at most `at` symbols, block after block of each sequence."""

    def __init__(self, texts: list[np.ndarray], at: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        n = -(-lengths // at)
        self.flat = np.concatenate(texts)
        self.index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.begin = np.repeat(np.cumsum(lengths) - lengths, n) + self.index * at
        self.length = np.minimum(at, np.repeat(lengths, n) - self.index * at)
        self.first, self.last = self.index == 0, self.index == np.repeat(n, n) - 1

    def steps(self, rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The rows, longest first, and how many of them reach each step."""
        rows = rows[np.argsort(-self.length[rows], kind="stable")]
        return rows, np.searchsorted(-self.length[rows], -np.arange(self.length[rows[0]]), "left").tolist()


def borders(model: Model, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """What each block gets from its sequence: the scaled forward state before it and the backward state after it.

    A block's symbols make one matrix from the state before it to the state at its end; the states then pass from block
    to block, as many sequences at once as have that many blocks.
    """
    states = len(model.start)
    before, after = np.tile(model.start, (len(blocks.index), 1)), np.ones((len(blocks.index), states))
    long = np.flatnonzero(~(blocks.first & blocks.last))
    if not len(long):
        return before, after
    pass_ = np.empty((len(blocks.index), states, states))
    for i in range(0, len(long), TOGETHER):
        rows, active = blocks.steps(long[i : i + TOGETHER])
        begin = blocks.begin[rows]
        x = np.where(blocks.first[rows][:, None, None], np.eye(states), model.move)
        for t, m in enumerate(active):
            e = model.emit.take(blocks.flat[begin[:m] + t], 0)
            y = x[:m] if not t else (x[:m].reshape(-1, states) @ model.move).reshape(m, states, states)
            y = np.multiply(y, e[:, None, :], out=None if not t else y)
            if t % 8 == 7 or t < 1:
                y /= y.sum((1, 2))[:, None, None]
            x[:m] = y
        pass_[rows] = x / x.sum((1, 2))[:, None, None]
    order = long[np.argsort(blocks.index[long], kind="stable")]
    cuts = np.searchsorted(blocks.index[order], np.arange(blocks.index.max() + 2))
    levels = [order[a:b] for a, b in zip(cuts[1:], cuts[2:], strict=False)]
    for rows in levels:
        x = np.einsum("ni,nij->nj", before[rows - 1], pass_[rows - 1])
        before[rows] = x / x.sum(1, keepdims=True)
    for rows in reversed(levels):
        x = np.einsum("nij,nj->ni", pass_[rows], after[rows])
        after[rows - 1] = x / x.sum(1, keepdims=True)
    return before, after


def expected(model: Model, texts: list[np.ndarray], at: int = CUT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, move, emit) of whole sequences and their log10 probability, by scaled forward-backward.

    Blocks of `at` symbols go side by side with the states at their borders, so the counts are those of uncut sequences
    and memory is held for TOGETHER blocks, whatever a sequence's length.
    """
    states, blocks = len(model.start), Blocks(texts, at)
    before, after = borders(model, blocks)
    start, move, emit, log, one = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0, np.ones(states)
    for i in range(0, len(blocks.index), TOGETHER):
        rows, active = blocks.steps(np.arange(i, min(i + TOGETHER, len(blocks.index))))
        begin, first, ends = blocks.begin[rows], blocks.first[rows], after[rows]
        alphas, scales, met, a = [], [], [], None
        for t, m in enumerate(active):
            into = np.where(first[:, None], before[rows], before[rows] @ model.move) if a is None else a[:m] @ model.move
            symbol = blocks.flat[begin[:m] + t]
            e = model.emit.take(symbol, 0)
            a = into * e
            s = a @ one
            a /= s[:, None]
            e /= s[:, None]
            alphas.append(a), scales.append(s), met.append((symbol, e))
        symbols, gammas, b = [], [], np.empty((0, states))
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            if len(b) < m:
                tail = ends[len(b) : m]
                b = np.concatenate([b, tail / (alphas[t][len(b) :] * tail).sum(1, keepdims=True)])
            symbols.append(met[t][0]), gammas.append(alphas[t] * b)
            x = b * met[t][1]
            if t:
                move += alphas[t - 1][:m].T @ x
                b = x @ model.move.T
        move += before[rows[~first]].T @ x[~first]
        start += gammas[-1][first].sum(0)
        symbol, gamma = np.concatenate(symbols), np.concatenate(gammas)
        emit += np.stack([np.bincount(symbol, gamma[:, k], len(emit)) for k in range(states)], 1)
        log += float(sum(np.log10(s).sum() for s in scales))
    return start, move * model.move, emit, log


def seed(frequency: np.ndarray, states: int = STATES) -> Model:
    """The first model, from the counts of all learning documents: states start near the symbols' frequencies and tend to stay."""
    rng = np.random.default_rng(7)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    emit = (frequency / frequency.sum())[:, None] * rng.gamma(4.0, 0.25, (len(frequency), states))
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def train(encoded: DataFrame, frequency: np.ndarray, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN, parts: int = PARTS) -> Model:
    """Baum-Welch over all whole learning documents, until a round gains less than `gain` (log10 a token) or after `rounds`."""
    spark = encoded.sparkSession
    learning = encoded.filter("learns")
    tokens = learning.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    model, last, columns = seed(frequency, states), -math.inf, [f"s{k}" for k in range(states)]

    def step(part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: Model = shared.value
            start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros_like(m.emit), 0.0
            held, size = [], 0

            def add() -> None:
                nonlocal start, move, emit, log
                a, b, c, d = expected(m, held)
                start, move, emit, log = start + a, move + b, emit + c, log + d

            for batch in batches:
                for s in batch.column(0):
                    held.append(np.frombuffer(s.as_py(), "<u4").astype(np.int64))
                    size += len(held[-1])
                    if size >= 300_000:
                        add()
                        held, size = [], 0
            if held:
                add()
            met = np.flatnonzero(emit.any(1))
            # Rows: -1 the starts, -2 - k the moves from state k, -2 - states the log10 probability, else a symbol.
            keys = np.concatenate([[-1], -2 - np.arange(states + 1), met])
            rows = np.concatenate([start[None], move, np.full((1, states), log), emit[met]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(rows[:, k]) for k in range(states))], ["k", *columns])

        mine = learning.filter(F.col("part") == part).select("symbols")
        sums = mine.mapInArrow(tidied(run), "k long, " + ", ".join(f"{c} double" for c in columns)).groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        shared.destroy()
        keys, rows = sums.column("k").to_numpy(), np.stack([sums.column(c).to_numpy() for c in columns], 1) if sums.num_rows else np.zeros((0, states))
        move, emit = np.zeros((states, states)), np.zeros_like(model.emit)
        for k in range(states):
            move[k] = rows[keys == -2 - k].sum(0)
        emit[keys[keys >= 0]] = rows[keys >= 0]
        return rows[keys == -1].sum(0), move, emit, float(rows[keys == -2 - states].sum(0)[0])

    counts: dict[int, tuple] = {}
    for _ in range(rounds):
        for part in range(parts):
            counts[part] = step(part)
            model = Model.of(*(sum(c[i] for c in counts.values()) for i in range(3)), frequency)
        now = sum(c[3] for c in counts.values()) / max(1, tokens)
        if now - last < gain:
            break
        last = now
    return model


def score(docs: DataFrame, head: int = HEAD, emit: int = EMIT, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    counts = materialise(count_words(docs.filter(learns("doc_id", 7)).select(F.col("text").cast("string").alias("text"))), "hmm-counts")
    vocabulary, frequency = build_vocabulary(counts, head, emit)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = materialise(encode(docs, shared), "hmm-encoded", "part")
    model = spark.sparkContext.broadcast(train(encoded, frequency, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(s.as_py(), "<u4").astype(np.int64) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.forward(texts))], ["row", "path"])

    paths = encoded.select("row", "symbols").mapInArrow(tidied(run), "row long, path double")
    far = encoded.filter(F.size("far") > 0).select("row", F.explode(F.arrays_zip("far", "times")).alias("f")).select("row", F.col("f.far").alias("word"), F.col("f.times").alias("times"))
    far = far.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("far_known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("far_logs"))
    rows = encoded.select("row", "doc_id", "learns", "n_tokens", "n_known", "logs", "shares").join(paths, "row").join(far, "row", "left")
    of_far = F.coalesce("far_logs", F.lit(0.0))
    each = math.log10(vocabulary.total + vocabulary.distinct + 1)
    return rows.select(
        "doc_id",
        (~F.col("learns")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary.total)).cast("long").alias("train_tokens"),
        (F.col("logs") + of_far - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("path") + F.col("shares") + of_far).alias("score"),
    )
