"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

Each class has counts of letter n-grams (up to ORDER letters with word bounds), taken once per document and word. Both
interpolate, with absolute discounting, with one shared lower-order model made of continuation counts over both classes:
a rare expression that neither class knows more of gets the same probability from both, so it decides nothing. A word's
evidence is the difference of its two log-likelihoods. A toxic text's words are mostly ordinary: each comes from the toxic
model with probability SHARE, else from the ordinary one. The log-likelihood of the whole text so, less that in the ordinary
model alone, over the number of its words is compared; beside it the evidence of its three strongest words, against the
logarithm of the length, as the strongest words of a longer text are stronger by chance. A logistic curve fitted on
cross-fitted evidence (models that have not seen the row) turns that into a score from 0 to 1; the weight of the whole text's
difference is at least zero, so that a text likelier under the toxic model never scores lower for it.

Learning uses labelled rows only: a share of each class by hash, expected to hold MAX_TOXIC and MAX_ORDINARY rows (all
where there are fewer), and every n-gram of these rows' whole texts. The bound on rows is the bound of what is collected and
broadcast. Scoring reads every document's whole text and nothing but the text.

Defined cases: null and empty texts have no evidence and get the curve's value there; without labelled rows of both
classes every score is the share of toxic learning rows (0 without any); a doc_id labelled twice is toxic if any label
says so; labels with nulls are ignored; repeated rows are scored each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, learns, materialise, ship, tidied

ORDER, DISCOUNT = 5, 0.75
#: The share of a toxic text's words that the toxic model makes, and the evidence from which a word is a strong one.
SHARE, MARGIN = 0.02, 3.0
MAX_TOXIC, MAX_ORDINARY = 8_000, 12_000
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+")
MEMO = 200_000


def grams(word: str, order: int = ORDER) -> list[str]:
    s = f"^{word}$"
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


class Evidence(dict):
    """word -> log-likelihood in the toxic model less that in the ordinary one; words are computed when first met."""

    def __init__(self, seen: dict[str, float], back: dict[str, float]):
        self.seen, self.back = seen, back

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        total = 0.0
        for g in grams(word):
            here = self.seen.get(g)
            total += self.back.get(g[:-1], 0.0) if here is None else here
        self[word] = total
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """The whole text's difference of log-likelihoods a word, the strongest words' evidence, and the number of words."""
        words = WORDS.findall(text.lower())
        if not words:
            return 0.0, 0.0, 0.0
        v = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        whole = np.logaddexp(math.log(1 - SHARE), math.log(SHARE) + v).mean()
        return float(whole), float(np.clip(np.sort(v[v > MARGIN])[-3:], 0, 10).sum()), float(len(words))


def kneser_ney(ordinary: dict[str, int], toxic: dict[str, int], order: int = ORDER, discount: float = DISCOUNT) -> tuple[dict[str, float], dict[str, float]]:
    """Log-ratios of the two models: of each n-gram seen, and of each context when what follows it is unseen."""
    known = set(ordinary) | set(toxic)
    # The shared model, from the longest suffixes down: how many different letters stand before each.
    levels, types = [], known
    for length in range(order - 1, 0, -1):
        here = Counter(g[1:] if len(g) > length else g for g in types)
        levels.append(here)
        types = set(here)
    shared: dict[str, float] = {}
    for level in reversed(levels):
        total, kinds = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        now = {}
        for g, n in level.items():
            h = g[:-1]
            below = shared.get(g[1:], 1e-4) if h else 1 / len(level)
            now[g] = (n - discount) / total[h] + discount * kinds[h] / total[h] * below
        shared |= now
    sums = []
    for counts in (ordinary, toxic):
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        sums.append((total, kinds))

    def mass(k: int, h: str) -> float:
        total, kinds = sums[k]
        return discount * kinds[h] / total[h] if total[h] else 1.0

    back = {h: math.log(mass(1, h) / mass(0, h)) for h in set(sums[0][0]) | set(sums[1][0])}
    seen = {}
    for g in known:
        h, below = g[:-1], shared.get(g[1:] if len(g) == order else g, 1e-4)
        p = [(max(c.get(g, 0) - discount, 0) / sums[k][0][h] if sums[k][0][h] else 0.0) + mass(k, h) * below for k, c in enumerate((ordinary, toxic))]
        seen[g] = math.log(p[1] / p[0])
    return seen, back


#: The whole text's difference is a few hundredths; the curve is over hundredths, so that its ridge weighs on all alike.
UNIT = 0.01


def evidence_of(features: np.ndarray) -> np.ndarray:
    """What the curve is over: the whole text's difference a word, its strongest words, the logarithm of its length."""
    return np.c_[features[:, 0] / UNIT, features[:, 1], np.log(np.maximum(features[:, 2], 1.0))]


def curve_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the curve (first: intercept); the difference's is at least zero, and the others are fitted without it then."""
    w = logistic(x, y, weight)
    return w if w[1] >= 0 else np.insert(logistic(x[:, 1:], y, weight), 1, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic regression (first: intercept), by damped Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
    return w


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_ordinary: int) -> tuple[DataFrame, list[float]]:
    """Texts of the learning rows (text, toxic), materialised, and the number of rows one of each class stands for."""
    rows = labels.filter(learns("doc_id", 4)).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    found = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # A share of each class by hash: expected to hold the most that is asked for, and told apart row by row.
    shares = [min(1.0, most / max(1, found.get(k, 0))) for k, most in enumerate((max_ordinary, max_toxic))]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.filter(place < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return materialise(texts, "toxicity-sample"), [1 / s for s in shares]


def fold_of(text: str) -> int:
    """Copies of a text are in one fold."""
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


def count_grams(texts: DataFrame) -> dict[str, list[int]]:
    """n-gram -> documents and words that hold it, by class and fold: columns 2 * toxic + fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            found: dict[str, list[int]] = {}
            for w, counts in words.items():
                for g in grams(w):
                    have = found.setdefault(g, [0] * 4)
                    for i in range(4):
                        have[i] += counts[i]
            return pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([c[i] for c in found.values()], pa.int64()) for i in range(4))], ["g", "n0", "n1", "n2", "n3"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 2 * toxic + fold_of(text or "")
                for w in set(WORDS.findall((text or "").lower())):
                    words.setdefault(w, [0] * 4)[at] += 1
                if len(words) > 100_000:
                    yield out()
                    words.clear()
        if words:
            yield out()

    ns = [f"n{i}" for i in range(4)]
    rows = texts.select("text", "toxic").mapInArrow(tidied(run), "g string, n0 long, n1 long, n2 long, n3 long").groupBy("g").agg(*(F.sum(n).alias(n) for n in ns))
    return {r[0]: list(r[1:]) for r in zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True)}


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_ordinary: int = MAX_ORDINARY):
    """The model: (seen, back, weights of the curve), or the share of toxic rows where a class is missing."""
    ship(docs.sparkSession)
    texts, weights = sample(docs, labels, max_toxic, max_ordinary)
    rows = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(rows) < 2:
        discard(texts)
        return 1.0 if rows.get(1) else 0.0
    counts = count_grams(texts)

    def fit(folds: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
        of = lambda k: {g: n for g, c in counts.items() if (n := sum(c[2 * k + f] for f in folds))}
        return kneser_ney(of(0), of(1))

    crossed = docs.sparkSession.sparkContext.broadcast([fit((1,)), fit((0,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Evidence(*m) for m in crossed.value]
        for batch in batches:
            found = [models[fold_of(t or "")].features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in range(3)), batch.column(1)], ["whole", "strong", "n", "toxic"])

    got = texts.select("text", "toxic").mapInArrow(tidied(run), "whole double, strong double, n double, toxic int").toArrow()
    x, y = np.stack([got.column(n).to_numpy() for n in ("whole", "strong", "n")], 1), got.column("toxic").to_numpy()
    curve = curve_of(evidence_of(x), y.astype(float), np.where(y == 1, weights[1], weights[0]))
    model = (*fit((0, 1)), curve)
    crossed.destroy()
    discard(texts)
    return model


class Scorer:
    """Scores of whole texts by a model of train()."""

    def __init__(self, model):
        self.flat = model if isinstance(model, float) else None
        if self.flat is None:
            seen, back, self.curve = model
            self.evidence = Evidence(seen, back)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        x = evidence_of(np.array([self.evidence.features(t or "") for t in texts.cast(pa.string()).to_pylist()]).reshape(-1, 3))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            s = scorer(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def drop_toxic(docs: DataFrame, model) -> DataFrame:
    """docs without the rows that score at least the threshold; a narrow filter, all columns as they are."""
    ship(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(place)) < THRESHOLD))

    return docs.mapInArrow(tidied(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    found = score(docs, train(docs, labels, **bounds))
    return found.select("doc_id", (~learns("doc_id", 4)).alias("held_out"), "score", "predicted")
