"""Toxicity, language model, quality, personal data, sharding, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

import corpus_pipeline
from mathlake.llm import hmm, pii, quality, sharding, toxicity
from mathlake.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, score string, shard string, base string, spans string"
EXTRA = ("s", "h", "b", "p")


def table(spark, docs):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in docs], SCHEMA)


def toxic_docs(n=400):
    rng = random.Random(1)
    words = ["".join(rng.choice(["an", "er", "ti", "on", "th"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if bad := i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["grumbly", "grumbler", "snarkish", "snarky"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs()
    docs += [(1000, None), (1001, ""), (None, "grumbler snarky grumbly grumbler"), (1002, "SNARKY! grumbler " * 3000), (1002, "SNARKY! grumbler " * 3000)]
    rows = toxicity.toxicity(table(spark, docs), spark.createDataFrame([*labels, (0, 1), (7, None), (None, 1), (99999, 1)], "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(r.predicted == 1 for r in rows if r.doc_id in (1002, None)) and all(r.predicted == 0 for r in rows if r.doc_id in (1000, 1001))


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "a"), (2, None)])
    assert [r.score for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0


def test_shared_backoff_decides_nothing():
    seen, back = toxicity.kneser_ney(Counter({"^a": 5, "^ab": 5}), Counter({"^c": 5, "^cd": 5}))
    e = toxicity.Evidence(seen, back)
    assert e["zzz"] == 0.0 and e["c"] > 0 > e["a"]


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    m = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [np.array([0, 4, 2, 2]), np.array([1]), np.array([3, 3, 0])]
    for got, t in zip(m.forward(texts), texts, strict=True):
        p = sum(m.start[z[0]] * m.emit[t[0], z[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(z, z[1:], t[1:], strict=False)) for z in product(range(3), repeat=len(t)))
        assert got == pytest.approx(math.log10(p))
    start, move, emit, log = hmm.expected(m, texts)
    assert start.sum() == pytest.approx(3) and move.sum() == pytest.approx(5) and emit.sum() == pytest.approx(8)
    assert log == pytest.approx(m.forward(texts).sum())


def test_baum_welch_never_gets_worse():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 4, 30) if i % 2 else rng.integers(4, 8, 30) for i in range(20)]
    model, last = hmm.Model(np.full(2, 0.5), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array(rng.dirichlet(np.ones(8), 2).T)), -np.inf
    for _ in range(6):
        start, move, emit, log = hmm.expected(model, texts)
        assert log >= last - 1e-9
        last = log
        model = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@pytest.mark.parametrize("head, emit", [(1 << 17, 1 << 14), (40, 15), (5, 50)])
def test_language_model(spark, head, emit):
    rng = random.Random(3)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    docs += [(500, None), (501, "ZZZ never Seen " * 40), (502, "word " * 30000), (503, "word"), (503, "word"), (None, "A1 b2")]
    rows = hmm.score(table(spark, docs), head, emit, states=3, rounds=1).toPandas()
    tokens = lambda t: [*(t or "").lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t in docs if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = rows.astype({"doc_id": object})
    for i, t in docs:
        r = rows[rows.doc_id.isna() if i is None else rows.doc_id == i].iloc[0]
        w = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert np.isfinite(r.score) and r.score < 0
    assert len(rows) == len(docs)
    if head > 100:
        mine = rows[rows.doc_id.map(lambda d: d is not None and d < 120)]
        assert mine.score.sum() > mine.base_score.sum()


def test_language_model_of_nothing(spark):
    assert hmm.score(table(spark, [(1, "a")]).limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = hmm.score(table(spark, [(held, "a b")])).collect()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and np.isfinite(r.score)


LINES = {
    "menu | home | about | contact": "navigation",
    "ou&&& token### was*** the%%%": "symbols",
    "THIS!! IS!! LOUD!!": "shouting",
    "The The The The The The The The The The The": "repetition",
    "Please enable JavaScript to go on.": "boilerplate",
    "read more": "punctuation",
    "An ordinary sentence that ends well.": None,
    "Licensed under the Apache License, Version 2.0.": None,
    "Yes.": None,
}


@pytest.mark.parametrize("line, rule", list(LINES.items()))
def test_line_rules(line, rule):
    assert quality.fails(line.encode(), line.encode().split()) == rule


def test_quality(spark):
    rng = random.Random(5)
    good = "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(12)) + "." for _ in range(10))
    docs = [(1, good), (2, None), (3, ""), (4, "w " * 20), (5, "a b c " * 40), (6, good + "\n" + good), (7, good + "\nx | y | z\n\x0b \n"), (8, ("a | b | c | d | e | f" + "\n") * 30 + good), (9, "é😀 ß x #*$ <b>&|% " + good), (10, "z" * 300000)]
    rows = {r.doc_id: r for r in quality.clean(table(spark, docs)).collect()}
    for i, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        c, inside = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rows[1].kept and rows[7].kept and rows[9].kept and not rows[8].kept and "x | y" not in rows[7].text
    assert quality.clean(table(spark, docs).limit(0)).count() == 0


def test_lines_between_many_neighbours_are_boilerplate(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."
    stamp, own = "Tous droits réservés par la maison.", [f"{prose(30)}\n{prose(30)}" for _ in range(60)]
    copied = "\n".join(prose(12) for _ in range(8))
    docs = [(i, f"{t.split(chr(10))[0]}\n{stamp}\n{t.split(chr(10))[1]}") for i, t in enumerate(own)] + [(100 + i, copied) for i in range(80)] + [(200, f"{stamp}\n" + prose(3)), (201, None)]
    df = table(spark, docs)
    assert [r.line for r in quality.common_lines(df, 20).collect()] == [quality.line_hash(stamp.encode().split())]
    rows = {r.doc_id: r for r in quality.clean(df).collect()}
    assert all(stamp not in rows[i].text and rows[i].kept for i in range(60)) and all(rows[100 + i].text == copied and rows[100 + i].kept for i in range(80))
    assert stamp in rows[200].text
    # Joined instead of sent, and in a corpus of twenty times as many rows, each document is judged alike.
    of = lambda d, **k: {(r.doc_id, r.kept, r.base_failed, r.text) for r in quality.clean(d, **k).collect()}
    once = of(df)
    assert of(df, sent=0) == once and of(df.crossJoin(spark.range(20)).drop("id")) == once


def test_boilerplate_may_be_long_and_near_copies_are_none(spark):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)) + "."
    notice, lines = prose(90), [prose(20) for _ in range(9)]
    near = ["\n".join(prose(20) if k == i % 9 and i < 207 else x for k, x in enumerate(lines)) for i in range(400)]
    near = [f"{t}\n{prose(5)}" for t in near]
    df = table(spark, [(i, f"{prose(150)}\n{notice}\n{prose(150)}") for i in range(40)] + [(1000 + i, t) for i, t in enumerate(near)])
    rows = {r.doc_id: r for r in quality.clean(df).collect()}
    assert all(notice not in rows[i].text and rows[i].kept for i in range(40))
    # Edits give each line over 20 pairs, but few of its texts; only the line beside the one that always differs has many.
    assert all(rows[1000 + i].text.split("\n")[:8] == t.split("\n")[:8] for i, t in enumerate(near))



BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_base_spans(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "x+y@q-r.co.uk", "@", ".", "+", "1.2.3.4", "300.1.1.1", "0255.1.1.1", "4539148803436467", "4539 1488-0343 6467", " ", "-", "+1 (555) 123-4567", "(", "é", "😀", "12345", "\n", "a", "..", "+44"]
    docs = list(enumerate("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)))
    docs += [(900, None), (901, ""), (902, "1" * 40000), (903, "a" * 60000 + "@b"), (904, "1-" * 30000), (905, "a@b" + ".c" * 30000), (906, "+1" + " " * 40000), (907, "9." * 30000)]
    rows = {r.doc_id: r for r in pii.digest(table(spark, docs)).collect()}
    for i, t in docs:
        want = plain_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(rows[i].spans.split(","))


def test_patterns_find_unseen_identifiers_and_masks_keep_columns(spark):
    docs = [(i, f"please call extension phone: +1 (555) 12{i % 10}-45{i:02d} or wait {i * 7919 % 10007:05d} turns") for i in range(40)]
    docs += [(100, "please call extension phone: 555-9900 or wait 12345 turns"), (101, None), (102, "no digits here"), (103, "mail a@b.c, a@b.c")]
    df = table(spark, docs)
    rows = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert rows[100] == "phone:29:37" and rows[101] == rows[102] == ""
    masked = pii.mask(df)
    assert masked.columns == df.columns
    got = {r.doc_id: r.text for r in masked.collect()}
    assert got[100] == "please call extension phone: [PHONE] or wait 12345 turns" and got[101] is None and got[103] == "mail [EMAIL], [EMAIL]"
    assert pii.digest(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).count() == 0


@pytest.mark.parametrize("literals", [pii.LITERALS, 0])
def test_secrets_are_found_by_what_stands_before_them(spark, literals):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    docs = [(i, f'w {i} set api_key = "{key(i)}"; done\n') for i in range(40)] + [(50, "set api_key = 'A-7'."), (51, f"commit {key(99)} of {key(98)}"), (52, "api_key = 12 34 56, no"), (53, "x1 " * 2600 + "api_key = B9")]
    rows = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("secret:")] for r in pii.digest(table(spark, docs), literals).collect()}
    text = dict(docs)
    assert all([text[i][a:b] for a, b in rows[i]] == [key(i)] for i in range(40))
    assert [text[50][a:b] for a, b in rows[50]] == ["A-7"] and not rows[51] and [text[52][a:b] for a, b in rows[52]] == ["12 34 56"]
    assert [text[53][a:b] for a, b in rows[53]] == ["B9"]


def checked(digits):
    """digits with a last one that makes Luhn's sum a multiple of ten."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def test_words_after_and_shapes_find_unseen_identifiers(spark):
    """Of each kind 30 seeds, three identifiers without a base form in the same context, and 30 like them elsewhere."""
    kinds = {
        "email": (lambda i: f"u{i}x@host{i}.org", lambda i: f"u{i:02d}x"),
        "ip": (lambda i: f"10.1.{i}.7", lambda i: f"10.{i:02d}"),
        "card": (lambda i: checked(f"4539148803436467{i:02d}"), lambda i: f"45391488{i:02d}"),
        "phone": (lambda i: f"+1 555 1234{i:03d}", lambda i: f"555-99{i:02d}"),
    }
    docs, planted, word = [], {}, lambda i: "w" + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10]
    for n, (kind, (seed, unseen)) in enumerate(kinds.items()):
        for i in range(30):
            docs += [(1000 * n + i, f"{word(i)} {seed(i)} zu{kind}"), (1000 * n + 500 + i, f"misc {unseen(i + 40)} else")]
        for i in range(3):
            planted[1000 * n + 100 + i] = f"{kind}:4:{4 + len(unseen(i))}"
            docs.append((1000 * n + 100 + i, f"any, {unseen(i)} zu{kind}".replace("any,", word(i + 40)[:2] + "y")))
    for i in range(30):  # a word alone is no pattern where half of what stands behind it are numbers; word and shape are
        docs += [(9000 + i, f"use {hashlib.sha1(str(i).encode()).hexdigest()}."), (9100 + i, f"use {i + 1000}.")]
    docs += [(9200 + i, f"use a{i}b{i}c.") for i in range(3)]
    planted |= {9200 + i: "secret:4:9" for i in range(3)}
    rows = {r.doc_id: r for r in pii.digest(table(spark, docs)).collect()}
    assert all(r.spans == "secret:4:44" for i, r in rows.items() if 9000 <= i < 9100)
    assert {i: r.spans for i, r in rows.items() if r.n_spans and not sum(r[f"n_{k}"] for k in BASE) and not 9000 <= i < 9100} == planted


def test_rounds_go_on_until_nothing_is_added(spark):
    """Each context is confident only once the six tokens are known that the context before it makes known: five rounds."""
    docs, token = [], lambda c, i: f"{c}{i}-{c}{i}"
    contexts = "abcdef"
    for k, c in enumerate(contexts):
        held = [f"+{k + 1} 555 1234{i:03d}" for i in range(54 if k else 60)]
        held += [token(c, i) for i in range(6 if k else 0)] + [token(chr(ord(c) + 1), i) for i in range(6)]
        docs += [(1000 * k + i, f"{c}word {h}") for i, h in enumerate(held)]
    rows = {r.doc_id: r.spans for r in pii.digest(table(spark, docs)).collect()}
    assert all(rows[i].startswith("phone:6:") for i, _ in docs) and len(rows) == len(docs)


def test_long_words_count_by_their_ends(spark):
    long = lambda c: c * 700 + "z" * pii.WORD
    docs = [(i, f"{long('ab'[i % 2])}{' ' * 600}+1 555 1234{i:03d} w{i}") for i in range(20)] + [(50, f"{long('c')}\n\n555-1234 x"), (51, f"{'z' * 50} 555-1235 y")]
    rows = {r.doc_id: r.spans for r in pii.digest(table(spark, docs)).collect()}
    assert rows[50] == f"phone:{702 + pii.WORD}:{710 + pii.WORD}" and rows[51] == ""


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(spark):
    docs = [(i, f"t{i}") for i in range(1500)] + [(-5, None), (2**62 + 7, "é"), (None, "n"), (3, "t3")]
    rows = sharding.layout(table(spark, docs)).collect()
    slots = {}
    for r in rows:
        key = (r.doc_id or 0) % 2**64
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17)) and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[-5].size, by_id[-5].text_crc32) == (1, 0) and by_id[2**62 + 7].size == 3 and by_id[2**62 + 7].text_crc32 == zlib.crc32("é".encode())
    assert sharding.layout(table(spark, docs).limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0.7 * before < docs.count() <= before, name
        assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.filter("n_chars <> length(text)").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == left


def test_decontamination_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.sql("select doc_id, item_id, n_shared from (" + ORACLE_SQL["op6_decontamination"] + ")").fetchall())
    assert sorted((r.doc_id, r.item_id, r.n_shared) for r in QUERIES["op6_decontamination"](spark, sf).collect()) == want
