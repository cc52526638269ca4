"""Every query with an oracle against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from brooklet import queries as store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = store.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and type(v).__name__ not in ("bool_", "bool", "str_") else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, small, duck, name):
    got, wanted = rows(store.queries()[name](spark, small).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert got == wanted


@pytest.mark.parametrize("name", [n for n in store.queries() if n not in ORACLES])
def test_rows(spark, small, name):
    assert store.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_llm():
    root = Path(__file__).resolve().parents[1]
    for path in [p for p in (root / "brooklet").rglob("*.py") if "llm" not in p.parts]:
        assert "llm" not in path.read_text()


@pytest.mark.parametrize("name", ["bm25_search", "classify_query", "stats", "store_fold"])
def test_hot_paths_stay_in_the_jvm(spark, small, name):
    plan = store.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowEvalPython", "Python")


@pytest.mark.parametrize("name", ["importance_documents", "ingest_dedup"])
def test_texts_cross_to_python_once(spark, small, name):
    """Entities and importance are one call, whatever asks for them."""
    plan = store.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1


def test_knn_takes_groups_of_k(spark, small):
    plan = store.queries()["knn"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
