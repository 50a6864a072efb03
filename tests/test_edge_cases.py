"""Hand-made edge cases (FIXTURES §3) not covered elsewhere."""

import datetime as dt
from decimal import Decimal

from riskframe.operators import ingest as I
from riskframe.operators import validate as V
from riskframe.operators.exposure import split_exposure

D = dt.date


def test_feb29_start_without_expiry(spark):
    df = spark.createDataFrame([("p", "c", D(2020, 2, 29), None, Decimal("366"))],
                               "POLICY_ID string, CERTIFICATE_ID string, START_DATE date, EXPIRY_DATE date, GWP decimal(20,4)")
    rows = {r.CL_YEAR: r for r in split_exposure(df).collect()}
    assert rows[2021].END_SEQ == D(2021, 2, 28)                   # +1 year from Feb 29 → Feb 28
    assert rows[2020].EXPOSURE_DAY == 307 and rows[2021].EXPOSURE_DAY == 58
    # NB_YEAR = 1 but 2021 is not leap: both rows use their own year length
    assert rows[2020].EXPOSURE_YEAR == 307 / 366 and rows[2021].EXPOSURE_YEAR == 58 / 365


def test_all_null_and_empty_columns(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, None)], "d string, n string, t string")
    s = [V.ColumnSetting("D", "d", "Date"), V.ColumnSetting("N", "n", "Double"), V.ColumnSetting("T", "t", "Text")]
    rep = {r.COLUMN: r for r in V.validate(df, s, V.Profile.of("GLM_GWP")).collect()}
    assert rep["D"].TYPE_OK is False          # no value at all is not a date column
    assert rep["N"].TYPE_OK is True           # nothing non-numeric among the values
    assert rep["T"].MISSING_COUNT == 2
    empty = df.limit(0)
    rep0 = {r.COLUMN: r for r in V.validate(empty, s, V.Profile.of("GLM_GWP")).collect()}
    assert {r.TYPE_OK for r in rep0.values()} == {False}   # an empty column fails every type
    assert rep0["T"].MISSING_PCT == 0.0


def test_integer_widths_beyond_int32(spark):
    df = spark.createDataFrame([(1, 300, 2 ** 31), (-5, 0, 0)], "a long, b long, c long")
    got = {r.COLUMN: r.NARROW_TYPE for r in I.integer_widths(df, ["a", "b", "c"]).collect()}
    assert got == {"a": "tinyint", "b": "smallint", "c": "bigint"}
    assert dict(I.narrow_integers(df, ["a", "b", "c"]).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint"}


def test_snapshot_changes_in_schema(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert I.snapshot_changed(a, spark.createDataFrame([(1, "x")], "k long, v string"))     # type changed
    assert I.snapshot_changed(a, spark.createDataFrame([(1, "x", 1)], "k int, v string, w int"))  # extra column
    assert not I.snapshot_changed(a, spark.createDataFrame([(1, "x")], "k int, v string"))


def test_duplicate_row_count_changed(spark):
    new = spark.createDataFrame([(1,), (1,), (1,)], "k int")
    old = spark.createDataFrame([(1,), (1,)], "k int")
    assert [tuple(r) for r in I.snapshot_diff(new, old).collect()] == [(1, "new")]
