"""Every core query with SQL against DuckDB on the smallest tables; the others for rows and invariants."""

import duckdb
import pandas as pd
import pytest

from sparkruns.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_object_dtype(df[c]) or pd.api.types.is_string_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v != v else v)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(_norm(ours), _norm(theirs), check_dtype=False, rtol=0, atol=1e-9)


def test_row_ids_are_unique(spark, sf_dir):
    ids = QUERIES["pr10_row_id"](spark, sf_dir)
    assert ids.select("row_id").distinct().count() == ids.count() == 6000


def test_downsample_keeps_positives(spark, sf_dir):
    out = QUERIES["ml01_downsample"](spark, sf_dir).groupBy("target").count().collect()
    n = {r["target"]: r["count"] for r in out}
    assert n[1] == 1968 and 0.8 * n[1] < n[0] < 1.2 * n[1]


@pytest.mark.parametrize("name,column", [("ml04_row_classifier", "score"), ("ml05_run_classifier", "discard_probability"), ("ml11_segment_hazard", "segment_probability")])
def test_scores_are_probabilities(spark, sf_dir, name, column):
    out = QUERIES[name](spark, sf_dir).toPandas()
    assert len(out) and out[column].between(0, 1).all()


def test_segment_mass_sums_to_one(spark, sf_dir):
    out = QUERIES["ml11_segment_hazard"](spark, sf_dir).toPandas()
    assert (out.groupby("run_id")["segment_probability"].sum() - 1).abs().max() < 1e-5
