"""Every query against the SQL that should give the same rows, on the same Parquet tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from chronoweave.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return repr(float(v)) if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") else str(v)

    out = df[cols].astype(object).map(cell)
    return out.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, db, name):
    got = normal(catalog.queries()[name](spark, DATA).toPandas())
    want = normal(db.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


SLOW = {"choose_k", "kmeans_cosine"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    got = catalog.queries()[name](spark, DATA)
    rows = got.limit(50).toPandas()
    assert len(rows) and len(set(got.columns)) == len(got.columns)
    assert all(rows[c].notna().any() for c in rows)


def test_best_lag_takes_every_channel(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronoweave.plans import series

    df = spark.range(18 * 40).select(F.concat(F.lit("t"), F.lpad((F.col("id") % 18).cast("string"), 2, "0")).alias("event_type"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * F.lit(3_600_000_000)).alias("ts"), F.lit(1.0).alias("value"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = series.best_lag(spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(f"t{i:02}", f"t{j:02}") for j in range(18) for i in range(j)} and len(got) == 153
