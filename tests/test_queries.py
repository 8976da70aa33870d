"""Every registered query that has SQL, at the smallest size, against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from flightloom.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, (list, np.ndarray)):
        return str([shown(x) for x in v])
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.8g}" if isinstance(v, (float, np.floating)) else str(v)


def plain(df):
    out = df[sorted(df.columns)].map(shown)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, sf_dir, duck, name):
    got, want = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(duck.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["decide", "assemble_raw_features", "bm25_topk", "structural_veto", "feature_queries", "diversify"])
def test_no_cartesian_plan_and_no_single_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Exchange SinglePartition" not in plan
