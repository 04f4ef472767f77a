"""Each query with SQL, against DuckDB on the smallest tables."""

import os

import pytest
from conftest import SMALL

from foldspark.plans.catalogue import ORACLE_SQL, QUERIES

FEW = ["supervised_matrix_ranges", "matrix_checked", "prediction_record_rows", "table_series", "series_lineitem_daily", "series_quality_report", "series_fingerprint", "supervised_matrix", "folds_rolling", "fold_train_stats", "pred_seasonal_naive", "fold_metrics_report", "conformal_intervals", "strategy_metrics_report", "block_bootstrap", "ar_regime_recursion"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    d = duckdb.connect()
    for t in ("lineitem", "orders", "events", "customer"):
        d.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return d


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, ([None if x is None or x != x else x for x in r] for r in df.values.tolist())))


@pytest.mark.parametrize("name", list(ORACLE_SQL) if os.environ.get("ALL_QUERIES") else FEW)
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
