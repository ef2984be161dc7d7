"""Every catalogued query against its SQL, on the smallest driver tables."""

import os
from pathlib import Path

import pytest

from sparkglyph.plans import catalogue

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def test_spelling_knows_all_languages(spark, tmp_path):
    word = lambda lang, w: [(i, f"{w} " * 3, lang) for i in range(10)]
    spark.createDataFrame(word("es", "perro") + word("en", "window"), "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "windaw perro")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalogue.QUERIES["q45_spell"](spark, str(tmp_path)).collect()
    assert "window" in {x for r in got for x in r}


def test_every_vector_is_scored(spark):
    ids = spark.read.parquet(str(SF / "embeddings.parquet")).select("vec_id").toPandas()["vec_id"]
    assert sorted(catalogue.QUERIES["q46_pca_outlier"](spark, str(SF)).toPandas()["id"]) == sorted(ids)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(SF)).toPandas()
    if name not in catalogue.SQL:
        assert len(got)
        return
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
