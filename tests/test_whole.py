"""The derived documents hold whole texts."""

import pytest
from pyspark.sql import functions as F

from mathlake.plans import queries
from mathlake.sources import corpus


@pytest.mark.parametrize("column", ["DOCS_MD", "DOCS_WHOLE", "DOCS_TEX"])
def test_documents_are_not_cut(spark, sf, column):
    rows = corpus.derived(spark, sf, "documents", "text", f"{getattr(corpus, column)} as out").collect()
    assert max(len(r.text) for r in rows) > 10_000
    for r in rows:
        out = r.out.replace("\\$", "$")
        assert len(out) > len(r.text) and all(line in out for line in r.text[80:].split("\n"))


def test_positions_lie_behind_long_texts(spark, sf):
    texts = corpus.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    last = queries.image_parse_whole(spark, sf).groupBy("doc_id").agg(F.max("start").alias("at"))
    assert last.join(texts, "doc_id").filter("at > n").count() == texts.count()
