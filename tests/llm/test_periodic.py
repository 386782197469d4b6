"""Runs of words against brute force: generated word sequences, the contract's texts, odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathlake.llm import periodic
from mathlake.llm.queries import QUERIES


def brute(words, least=12):
    """Every run by its definition: for each period the maximal stretches, and no shorter period within."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 2 * q) and not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e, q))
            i = j + 1
    return sorted(out)


def numbered(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def test_pieces_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        words, letters = [], rng.choice([1, 2, 3, 5, 30])
        while len(words) < rng.randrange(1, 150):
            part = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
            words += (part * rng.randrange(1, 7))[: rng.randrange(1, 90)]
        assert periodic.find_runs(numbered(words)) == brute(words), words


@pytest.mark.parametrize("least", [1, 2, 3, 4, 7, 12, 13, 40])
def test_other_least_lengths(least):
    rng = random.Random(least)
    for _ in range(200):
        words = []
        while len(words) < rng.randrange(1, 80):
            words += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 5)
        assert periodic.find_runs(numbered(words), least) == brute(words, least), words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_few_letters(words):
    assert periodic.find_runs(numbered(words)) == brute(words)


def test_every_automaton_slice_is_searched(monkeypatch):
    rng = random.Random(7)
    words = [rng.randrange(4) for _ in range(60)] * 4 + [rng.randrange(50) for _ in range(100)]
    whole = periodic.find_runs(numbered(words))
    monkeypatch.setattr(periodic, "NODES", 8)
    assert periodic.find_runs(numbered(words)) == whole == brute(words)


def test_fibonacci_words_and_a_long_uniform_text():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.find_runs(numbered(b)) == brute(b)
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(doc_id, text):
    """The contract, read word by word."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(b" ".join(kept).decode())


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_an_odd_table(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a " * 12, "a b " * 6, "x" * 5000, "é é " * 20, "Same line\n" * 40, " ".join(str(rng.randrange(40)) for _ in range(900))]
    rows = [(i, t, "r", "s", "p") for i, t in enumerate(texts * 6)] + [(None, "a b c " * 9, None, None, None), (None, None, None, None, None)] + [(4, "a " * 12, "r", "s", "p")] * 2
    schema = "doc_id long, text string, runs string, start string, period string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op11_runs"](spark, str(tmp_path))
    assert dict(out.dtypes) == dict.fromkeys(NAMES[:6], "bigint") | dict.fromkeys(NAMES[6:], "string")
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, out.select(*NAMES).collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)


def test_query_on_given_rows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    small = [d for d in docs if len((d[1] or "").split()) < 400]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, sf).select(*NAMES).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    for d in small:
        assert got[d[0]] == expected(*d)


def test_collapsed_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "z a b a b a b a b a b a b a b c")], "doc_id long, text string")
    (row,) = periodic.runs(docs).collect()
    assert row.collapsed == "z a b c" and row.n_words == 16 and [tuple(r) for r in row.runs] == [(1, 14, 2)]
    assert periodic.runs(docs.limit(0)).count() == 0
