"""The filter interaction audit against a document-by-document evaluation of every order."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from mathlake.llm import interaction
from mathlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, part string, mask string, n string, good string, bad string"


def table(spark, docs):
    return spark.createDataFrame([(i, t, lang, "p", "m", "n", "g", "b") for i, t, lang in docs], SCHEMA)


def fails(docs):
    for i, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }


def brute(docs, labels):
    out = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    judged = [(i, lang or "", f, any(q == 1 for j, q, _ in labels if i is not None and j == i), any(t == 1 for j, _, t in labels if i is not None and j == i)) for (i, _, lang), f in zip(docs, fails(docs), strict=True)]
    for _, part, f, good, bad in judged:
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, name in enumerate(order, 1):
                row = out[part, order, step]
                if f[name] and gone:
                    row[2] += 1
                elif f[name]:
                    row[1] += 1
                    row[4] += good
                    row[5] += bad
                    shapley[part, name] += 1
                row[3] += f[name] and sum(f.values()) == 1
                gone = gone or f[name]
                row[0] += not gone
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


GOOD = " ".join(f"word{i}" for i in range(250))
DOCS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (3, GOOD, "de"), (3, GOOD, "de"), (None, GOOD, "de"), (None, GOOD, None), (4, None, None), (5, "", ""), (6, "", "en"), (7, "a # b", "en"), (8, "SHOUT " * 300, "fr"),
    (9, GOOD.upper() + " $", "fr"), (10, "same " * 400, "en"), (11, "é É | x", "es"), (0, "same " * 400, "en"), (12, GOOD + " x" * 20_000, "en"), (13, GOOD + "\x0b*", "en"), (14, GOOD + "\x0b*", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (6, None, 1), (None, 1, 1), (10, 1, 0), (99, 1, 1), (9, 0, 1)]
NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(df):
    got = [tuple(r) for r in df.select(*NAMES).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_every_order_of_an_odd_table(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = interaction.audit(table(spark, DOCS), labels)
    assert dict(out.dtypes) == dict.fromkeys(NAMES[3:], "bigint") | {"part": "string", "filter_order": "string", "step": "int"}
    assert rows_of(out) == brute(DOCS, LABELS)


def test_no_documents_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(table(spark, []), none).count() == 0
    assert rows_of(interaction.audit(table(spark, DOCS[:3]), none)) == brute(DOCS[:3], [])


def test_other_filters(spark):
    """Two filters over given cells."""
    cells = spark.createDataFrame([("x", 0, 5, 1, 0), ("x", 1, 3, 1, 1), ("x", 3, 2, 0, 2)], "part string, mask int, n long, n_good long, n_bad long")
    got = {(r.filter_order, r.step): tuple(r)[3:] for r in interaction.interactions(cells, ["P", "Q"]).collect()}
    assert got == {("PQ", 1): (5, 5, 0, 3, 1, 3, 8), ("PQ", 2): (5, 0, 2, 0, 0, 0, 2), ("QP", 1): (8, 2, 0, 0, 0, 2, 2), ("QP", 2): (5, 3, 2, 3, 1, 1, 8)}


@pytest.mark.parametrize("name", ["op13_interactions"])
def test_query_has_all_rows(spark, sf, name):
    parts = spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().count()
    assert QUERIES[name](spark, sf).count() == parts * 600
