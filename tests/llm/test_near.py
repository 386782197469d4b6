"""SimHash components, repeated strings, decontamination: brute force on small tables, hot groups forced."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from mathlake.llm import decontaminate, lpf, simhash

WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def near_docs():
    rng = random.Random(1)
    docs = []
    for i in range(60):
        t = prose(rng, rng.choice([1, 2, 3, 40, 200]))
        docs.append(t)
        for _ in range(rng.randrange(3)):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w))
    docs += [None, "", " \n", docs[0], docs[0], "A b C", "a B c", "é 😀", "long " * 20000]
    return list(enumerate(docs))


@pytest.mark.parametrize("group", [simhash.GROUP, 2])
def test_components(spark, group):
    docs = near_docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    rows = {r.doc_id: r for r in simhash.near_duplicates(df, group).collect()}
    fps = [plain_fingerprint(t) for _, t in docs]
    assert [rows[i].fingerprint for i, _ in docs] == [f"{f:016x}" for f in fps]
    assert {i: rows[i].component_id for i, _ in docs} == plain_components(fps, [i for i, _ in docs])


@pytest.mark.parametrize("n", [2, 63, 64, 65, 700])
def test_bit_sliced_group_equals_brute_force(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = centres[rng.integers(0, 12, n)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    fps = np.unique(fps)
    root = simhash.group_roots(fps, queries=16)
    want = plain_components([int(f) for f in fps], list(range(len(fps))))
    assert [want[int(r)] for r in root] == [want[i] for i in range(len(fps))]
    assert len(set(root.tolist())) == len(set(want.values()))


def test_far_lanes_are_abandoned_not_lost():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64))
    b[::2] = rng.integers(0, 2**63, 2500, dtype=np.uint64)
    want = np.bitwise_count(a ^ b) <= 3
    assert (simhash.near_lanes(a, b) == want).all()
    hits = np.unpackbits(simhash.near(a[:50], simhash.planes(b)).view(np.uint8), axis=1, bitorder="little")[:, :5000]
    assert (hits.astype(bool) == (np.bitwise_count(a[:50, None] ^ b[None]) <= 3)).all()


def test_every_close_pair_shares_a_key():
    rng = random.Random(4)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        shared = [t for t, m in enumerate(simhash.FIRST) if x & m == y & m]
        assert shared
        assert all(any(x & m == y & m for m in simhash.SECOND[t]) for t in shared)


def test_long_chain_is_one_component(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)]
    stars = {r.u: r.v for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert stars == {i: 0 for i in range(1, 41)} | {101: 100}


def test_one_of_each(spark):
    rows = [(3, "same text here again", 1), (1, "same text here again", 2), (1, "same text here again", 2), (5, "other words stand in this one", 3), (None, "same text here again", 4), (9, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(df).collect())
    assert kept == [(False, 1), (False, 5), (False, 9), (True, 0)]
    assert simhash.one_of_each(df.limit(0)).columns == df.columns and simhash.near_duplicates(df.limit(0)).count() == 0


def plain_removed(texts, width):
    seen = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            seen.setdefault(t[s : s + width], []).append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + width] = b"\1" * width
    return gone


def repeat_docs(width):
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefghijklmnop é\n") for _ in range(n))
    passage, other = line(3 * width), line(width + 3)
    texts = [line(rng.randrange(4 * width)) for _ in range(25)]
    texts += [line(rng.randrange(width)) + passage[rng.randrange(width) :] + line(rng.randrange(width)) for _ in range(25)]
    texts += [line(50) + other + line(90) for _ in range(6)]
    texts += [texts[0]] * 4 + ["ab" * width, "x" * (5 * width), "x" * width, "x" * (width - 1), "", passage * 2]
    return texts


def plain_passages(texts, words):
    """Whether each text holds a window of `words` words that another text holds too."""
    windows = [{tuple(t[k : k + words]) for k in range(len(t) - words + 1)} for t in texts]
    return [any(w & o for j, o in enumerate(windows) if j != i) for i, w in enumerate(windows)]


@pytest.mark.parametrize("bucket,levels", [(lpf.BUCKET, 6), (300, 6), (300, 1), (150, 0)])
def test_repeats(spark, bucket, levels):
    width = 40
    texts = repeat_docs(width) + [None]
    df = spark.createDataFrame([(i, t, b"k") for i, t in enumerate(texts)], "doc_id long, text string, key binary")
    rows = {r.doc_id: r for r in lpf.remove_repeats(df, width, 20, bucket, keep_text=True, words=5, word_gram=2, levels=levels).collect()}
    data = [(t or "").encode() for t in texts]
    passages = plain_passages([d.split() for d in data], 5)
    assert any(passages) and not all(passages)
    for i, gone in enumerate(plain_removed(data, width)):
        left = bytes(b for b, g in zip(data[i], gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.text)) == (len(data[i]), sum(gone), spans, hashlib.sha256(left).hexdigest(), left)
        assert r.shares_passage == passages[i]


@pytest.mark.parametrize("seed", range(4))
def test_longest_previous_factors(seed):
    rng = random.Random(seed)
    for kind, width in ((np.uint8, 20), (np.uint64, 6)):
        data = np.array([rng.choice([97, 98]) for _ in range(150)] + [97] * 50, kind)
        starts = np.array(sorted(rng.sample(range(200 - width + 1), 120)))
        factor, source = lpf.longest_previous(lpf.Suffixes(data, width), starts)
        text = data.tolist()
        for k, i in enumerate(starts.tolist()):
            same = lambda j, i=i: next((n for n in range(width) if text[i + n] != text[j + n]), width)
            earlier = [same(j) for j in starts[:k].tolist()]
            assert factor[k] == max(earlier, default=0)
            assert not factor[k] or earlier[source[k]] == factor[k]


def test_repeats_across_chunks(monkeypatch):
    monkeypatch.setattr(lpf, "CHUNK", 64)
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(500)).encode(), np.uint8)
    starts = [a + k for a, n, _, _ in lpf.runs(data, 40, 20, lpf.BASE) for k in range(n)]
    assert starts == list(range(500 - 40 + 1))


def test_repeats_of_odd_tables(spark):
    schema = "doc_id long, text string"
    t = "".join(random.Random(9).choice("abcdef") for _ in range(900))
    same = lpf.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, "short"), (1, "other")], schema)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in same) == [(5, 0), (5, 0), (900, 900), (900, 900)]
    assert lpf.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def plain_hits(docs, items):
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = set()
    for item_id, text in items:
        w = low(text)
        k = min(5, len(w))
        if not k:
            continue
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc_id, body in docs:
            d = low(body)
            have = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            if len(want & have) >= 0.8 * len(want) - 1e-9:
                out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 3])
def test_contamination(spark, block):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([1, 3, 5, 6, 20, 37, 60]))) for i in range(20)] + [(30, None), (31, " "), (3, "dup " * 7), (3, "dup " * 7)]
    docs = []
    for i in range(60):
        text = prose(rng, rng.choice([0, 4, 50, 2000]))
        if i % 3 == 0:
            w = rng.choice(items[:20])[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            text += " " + " ".join(w).title() + "\n" + prose(rng, 30)
        docs.append((i, text))
    docs += [(90, None), (91, "dup dup dup dup dup dup dup")]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, block=block).collect()}
    want = plain_hits(docs, items)
    assert got == want and want
    kept = decontaminate.drop_contaminated(d, b, block=block)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
