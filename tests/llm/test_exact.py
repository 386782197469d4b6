"""Exact duplicates: the index over several batches and sessions, odd tables, hot texts."""

import hashlib
from collections import Counter

import pytest

from mathlake.llm import exact
from mathlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, digest string, n string, batch string, row string"


def table(spark, docs):
    return spark.createDataFrame([(*d, "d", "n", "b", "r") for d in docs], SCHEMA)


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def check(docs, rows):
    sizes, last = Counter(sha(t) for _, t in docs), {}
    for i, t in docs:
        if i is not None:
            last[sha(t)] = max(i, last.get(sha(t), i))
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((i, sha(t)) for i, t in docs)
    assert all(r.group_size == sizes[r.text_sha256] and r.keep_id == last.get(r.text_sha256) for r in rows)
    kept = [r for r in rows if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and Counter(r.text_sha256 for r in kept) == Counter(dict.fromkeys(sizes, 1))


DOCS = [(1, "a"), (2, "A"), (3, "a"), (-(2**62), "a"), (2**62, None), (7, ""), (8, " "), (9, "long " * 50_000), (10, "long " * 50_000), (5, "b"), (5, "b"), (6, "á"), (6, "á"), (None, "a"), (None, None), (None, "alone"), (None, "alone")]


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_odd_table(spark, parts):
    check(DOCS, exact.last_of_each(table(spark, DOCS), parts).collect())
    assert exact.last_of_each(table(spark, DOCS).limit(0), parts).count() == 0


def test_a_third_of_all_rows_is_one_text(spark, monkeypatch):
    docs = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(3000)]
    check(docs, exact.last_of_each(table(spark, docs)).collect())
    monkeypatch.setattr(exact, "HOT", 1000)  # all texts are matched where they are read
    check(docs, exact.last_of_each(table(spark, docs)).collect())


def test_ids_that_are_no_numbers(spark):
    rows = exact.last_of_each(table(spark, [(1, "x"), (2, "x")]).withColumn("doc_id", exact.F.concat(exact.F.lit("d"), exact.F.col("doc_id").cast("string")))).collect()
    assert {(r.doc_id, r.kept, r.keep_id) for r in rows} == {("d1", False, "d2"), ("d2", True, "d2")}


def test_new_data_against_a_kept_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact.DigestIndex(spark, path, buckets=3)
    first = index.ingest(table(spark, [(1, "a"), (2, "a"), (3, "b")]), "monday").collect()
    assert {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in first} == {(1, False, 2, 2), (2, True, 2, 2), (3, True, 3, 1)}
    for name in index.names.values():  # another session knows the path only
        spark.sql(f"drop table {name}")
    again = exact.DigestIndex(spark, path, buckets=99)
    assert again.buckets == 3
    for _ in range(2):  # a batch that is ingested again replaces itself
        second = again.ingest(table(spark, [(9, "a"), (4, "c"), (5, "c"), (6, None)]), "tuesday").collect()
        assert {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in second} == {(9, False, 2, 3), (4, False, 5, 2), (5, True, 5, 2), (6, True, 6, 1)}
    assert {(r.batch, r.keep_id) for r in again.read("kept").collect()} == {("monday", 2), ("monday", 3), ("tuesday", 5), ("tuesday", 6)}


def test_the_index_is_joined_bucket_by_bucket(spark, tmp_path):
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index")
    index.ingest(table(spark, DOCS), "one")
    new, known = (index.read(t) for t in ("seen", "kept"))
    plan = new.join(known.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_query_columns(spark, sf):
    out = QUERIES["op12_exact"](spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, out.collect())
