"""Driver contract: entry runs, every query has an oracle, and Spark equals DuckDB on sf0.001."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from riskframe.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "VAR_NAME_CODE" in df.columns


def test_every_query_has_oracle():
    from riskframe.plans.queries import REGISTRY
    assert set(REGISTRY) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(ocols, res.fetchall())


def test_no_python_udf_cartesian_or_nested_loop_in_any_plan(spark):
    """Every registered query plans without Python evaluation, cartesian products or nested loops."""
    import re
    for name, fn in REGISTRY.items():
        text = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        bad = re.findall(r"BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin", text)
        assert not bad, (name, bad)


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT", "smallint": "SMALLINT"}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_types_match_oracle(spark, duck, name):
    st = dict(entry.queries()[name](spark, SF).dtypes)
    rel = duck.sql(entry.oracle_sql()[name])
    ot = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t, t.upper()) for c, t in st.items()} == ot


@pytest.mark.parametrize("name", ["exposure_split", "date_multi_format", "clean_table", "report_period", "profit_loss"])
def test_date_queries_do_not_depend_on_session_time_zone(spark, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        sdf = entry.queries()[name](spark, SF)
        srows = [tuple(r) for r in sdf.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert _rows(sdf.columns, srows) == _rows(ocols, res.fetchall())
