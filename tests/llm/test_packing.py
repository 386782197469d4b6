"""Packing and the token store: exact round trips, brute-force best fit, odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mathlake.llm import dac, packing
from mathlake.llm.tokens import WordEncoder, default_tokenizer

ODD = [(1, "Hello, world! It's 2024.", "a"), (2, None, None), (3, "", "b"), (4, " \t\n", "c"), (5, "word " * 9000, "d"), (6, "é😀 ß İ, ﬁ x’s 中文。", "e"), (6, "é😀 ß İ, ﬁ x’s 中文。", "e"), (None, "no id", "f"), (8, "x" * 30000, "g"), (9, "<|endoftext|> a", "h"), (10, "mid<|startoftext|>word <|ENDOFTEXT|>, <|endoftext|>", "i")]
SCHEMA = "doc_id long, text string, rank string"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda s: np.array([*t.encode(s or "", add_special_tokens=False).ids, 2], "<u4")


def best_fit(lengths, capacity):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits)[1]
        else:
            rooms.append(capacity)
            i = len(rooms) - 1
        out.append((i, n))
        rooms[i] -= n
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_windows(histogram, 40)
    rows, used = {tuple(r[:2]): r for r in plan.tolist()}, {}
    for n, count in histogram.items():
        for rank in range(count):
            _, first, base, each, offset = rows[max(k for k in rows if k[0] == n and k[1] <= rank)]
            i = rank - first
            used.setdefault(base + i // each, []).append((offset + i % each * n, n))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40
    assert sorted(40 - sum(n for _, n in p) for p in used.values()) == best_fit(lengths, 40)
    assert sorted(used) == list(range(len(used)))


def test_tree_finds_the_tightest():
    rng, tree, open_ = random.Random(1), packing.TightestTree(100), set()
    for _ in range(2000):
        c = rng.randrange(101)
        (open_.add if (on := rng.random() < 0.5) else open_.discard)(c)
        tree.put(c, on)
        least = rng.randrange(101)
        assert tree.tightest(least) == min((o for o in open_ if o >= least), default=None)


def test_encoder_equals_the_library(plain):
    e = WordEncoder(default_tokenizer())
    for _, text, _ in ODD:
        assert e.ids((text or "").encode(), 2).tolist() == plain(text).tolist()


def test_encoder_forgets_and_still_agrees(plain):
    e, rng = WordEncoder(default_tokenizer(), most_words=40, together=100), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé,") for _ in range(4)) for _ in range(60)) for _ in range(20)]
    got = [x.tolist() for x in e.stream(pa.array(texts), 2)]
    assert got == [plain(t).tolist() for t in texts]


@pytest.mark.parametrize("small", [packing.SMALL, 0])
def test_pieces_cover_every_id_once(spark, plain, small):
    rows = packing.pack(spark.createDataFrame(ODD, SCHEMA).repartition(3), keep_ids=True, small=small).toPandas()
    whole = {}
    for r in rows.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    want = sorted(plain(t).tobytes() for _, t, _ in ODD)
    pieces = rows.sort_values("start")
    for key, part in pieces.groupby(["doc_id", "doc_tokens"], dropna=False):
        whole[key] = part
    assert rows.length.sum() == sum(len(w) // 4 for w in want)
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 4096
    doc5 = pieces[pieces.doc_id == 5]
    assert b"".join(doc5.ids) == plain(ODD[4][1]).tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    codes = dac.Codes(dac.encode(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1, 511, 512, 513}:
        if 0 <= i < len(ids):
            assert codes[i] == ids[i]
    with pytest.raises(IndexError):
        codes[len(ids)]


def test_store_round_trip(spark, plain, tmp_path):
    docs = list(dict.fromkeys(ODD))
    dac.write(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "s"), segment_tokens=50)
    rows = dac.read(spark, str(tmp_path / "s"), keep_ids=True).toPandas()
    start = 0
    for doc_id, text, _ in sorted(docs, key=lambda d: -1 if d[0] is None else d[0]):
        r = rows[rows.doc_id.isna() if doc_id is None else rows.doc_id == doc_id].iloc[0]
        ids = plain(text)
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    places = [(i, k) for i, t, _ in docs for k in (0, 1, 700, len(plain(t)) - 1, len(plain(t)), -1)]
    got = dac.lookup(spark, str(tmp_path / "s"), spark.createDataFrame([*places, places[0], (77, 0)], "doc_id long, at int")).collect()
    ids = {i: plain(t) for i, t, _ in docs if i is not None}
    assert sorted(map(tuple, got)) == sorted({(i, k, int(ids[i][k])) for i, k in places if i is not None and 0 <= k < len(ids[i])})


def test_many_rows_of_one_id_are_split_and_keep_their_order(spark, plain, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(40)] + [(3, "last")], "doc_id long, text string")
    try:
        dac.write(docs, str(tmp_path / "s"), segment_tokens=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = dac.read(spark, str(tmp_path / "s")).orderBy("start").toPandas()
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]] and rows.doc_id.isna().tolist() == [True] * 40 + [False]
    assert spark.read.parquet(str(tmp_path / "s")).select("shard").distinct().count() > 1
    assert dac.lookup(spark, str(tmp_path / "s"), spark.createDataFrame([(None, 0)], "doc_id long, at int")).count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack(empty).count() == 0 and dac.round_trip(empty).count() == 0
