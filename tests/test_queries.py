import os

import duckdb
import pytest

from stringloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.execute(f"create view {t[:-8]} as select * from '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    found = duck.execute(catalogue.SQL[name])
    cols = [x[0] for x in found.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_recall(spark):
    rows = {r.category: r.recall for r in catalogue.QUERIES["recall_by_category"](spark, DIR).collect()}
    assert rows["EXACT"] == 1.0 and rows["DOUBLE"] == 1.0


def test_fold_takes_whole_texts(spark, tmp_path):
    import unicodedata

    texts = ["é" * 70 + " plain " * 20 + "über ñandú", "x" * 64 + "àéîõü", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bare = lambda t: t and "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    got = {r.doc_id: r.a for r in catalogue.QUERIES["analyze_fold_diacritics"](spark, str(tmp_path)).collect()}
    assert got == {i: bare(t) for i, t in enumerate(texts)}
