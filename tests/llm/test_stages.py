"""The pipeline's stages on a small odd table, against a plain version of the whole run; columns clash with helper names."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from mathlake.llm import sharding, simhash
from mathlake.llm.tokens import default_tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, row int, rest string, task int, __n int, __doc long, slot int, `ids` string"


def texts():
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    out = [(i, prose(60)) for i in range(80)] + [(100 + i, f"{prose(20)} vilefoul gruesomest {prose(20)} vilefoul") for i in range(40)]
    item, known = prose(30), [w for _, t in out[:80] for w in t.split()]
    out += [(200, out[3][1]), (300, f"{prose(40)} {item.title()} {prose(40)}"), (400, f"write to some.one@mail.example.org or +1 (555) 123-4567 {prose(20)}")]
    out += [(500, None), (501, ""), (502, " \n\t"), (503, " ".join(rng.choice(known) for _ in range(60_000))), (504, "a short one"), (504, "a short one"), (505, "é😀 ß 中文 " * 3)]
    return out, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, item = texts()
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", 2, 3, i, 4, "x") for i, t in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(100 <= i < 140)) for i, _ in rows[:120]] + [(7, 1, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain_run():
    """doc_id -> text of what the stages keep, by their rules."""
    rows, item = texts()
    kept = {i: t for i, t in rows if not re.search("vilefoul", t or "")}
    marks = {i: simhash.fingerprint((t or "").encode()) for i, t in kept.items()}
    component = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if (marks[a] ^ marks[b]).bit_count() <= 3:
                low, high = sorted((component[a], component[b]))
                component = {k: low if v == high else v for k, v in component.items()}
    kept = {i: t for i, t in kept.items() if component[i] == i}
    words = lambda t: (t or "").lower().split()
    five = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = five(words(item))
    kept = {i: t for i, t in kept.items() if len(want & five(words(t))) < 0.8 * len(want)}
    kept[400] = kept[400].replace("some.one@mail.example.org", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]")
    return kept


def test_stages_equal_the_plain_run(spark, tables):
    docs, want = spark.read.parquet(f"{tables}/documents.parquet"), plain_run()
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    rows = docs.collect()
    assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
    assert all(r.row == 1 and r.rest == "r" and r.task == 2 and r["__n"] == 3 and r["__doc"] == r.doc_id and r.slot == 4 and r.ids == "x" for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert counts == sorted(counts, reverse=True) and counts[0] == len(texts()[0]) - 40
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    got = {i: b"".join(p.sort_values("start").ids) for i, p in packed.groupby("doc_id")}
    assert got == {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, x in want.items()}
    run = corpus_pipeline.run(spark, tables).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, run[key].to_numpy().tolist())) == sorted(map(tuple, packed[key].to_numpy().tolist()))


def test_stages_take_empty_tables(spark, tables):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{tables}/documents.parquet").limit(0), tables)
        assert out.count() == 0 and len(out.columns) == 12, name


def test_shards_are_written(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard"}
    want = {r.doc_id: r.shard for r in sharding.layout(docs, 4).collect()}
    assert all(want[r.doc_id] == r.shard for r in back.select("doc_id", "shard").collect())
