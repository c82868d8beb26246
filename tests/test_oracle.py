"""Every registered query against its SQL twin on the smallest fixture."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from tools_oracle import compare

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SMALL)
    ok, detail = compare(df, con.execute(E.oracle_sql()[name]))
    assert ok, detail


def test_model_queries_score_every_candidate(spark):
    qs = E.queries()
    scores = qs["route_model_scores"](spark, SMALL)
    assert scores.count() == qs["candidate_routes"](spark, SMALL).count()
    row = qs["model_accuracy"](spark, SMALL).first()
    assert 0.5 < row["test_accuracy"] <= 1 and row["num_trees"] == 200


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert "factory_oee" in df.columns
