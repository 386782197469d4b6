"""Every registered query of the core library against its SQL, over whole tables."""

import math

import duckdb
import pandas as pd
import pytest

from mathlake.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 9) if hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, (int, float)) else v

    out = [tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Vectors whose grey values differ between single and double precision."""
    folder = str(tmp_path_factory.mktemp("edges"))
    duckdb.sql(f"copy (select i as vec_id, list_transform(range(64), lambda k: case when (i + k) % 2 = 0 then -0.094488225877285::float else 0.3::float end) as embedding, 0 as label from range(60) t(i)) to '{folder}/embeddings.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["difference_histogram", "raster_similarity", "visual_scores", "raster_variants"])
def test_grey_values_in_single_precision(spark, edges, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{edges}/embeddings.parquet'")
    assert rows(QUERIES[name](spark, edges).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())


def test_words_are_found_where_their_texts_lie(spark, tmp_path):
    """Texts are dealt out once, their words never; rows that share an id, or have none, keep their own words."""
    docs = [(1, "one two one"), (1, "one two one"), (1, "two ones"), (None, "no id"), (None, "no id"), (2, None), (3, ""), (4, "é, !"), (5, "xab ab é b")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["located_formulas"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Window", "Join", "Generate"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["located_formulas"]).fetchall()
    assert len(want) == 9 and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
