import datetime as dt
from decimal import Decimal

import pytest

from riskframe.operators.exposure import split_exposure

D = dt.date


def _split(spark, rows, **kw):
    df = spark.createDataFrame(rows, "POLICY_ID string, CERTIFICATE_ID string, INIT_DATE date, START_DATE date, "
                                     "EXPIRY_DATE date, GWP decimal(20,4)")
    return {(r.POLICY_ID, r.CL_YEAR): r for r in split_exposure(df, **kw).collect()}


def test_three_year_span(spark):
    out = _split(spark, [("p", "c", None, D(2019, 7, 1), D(2021, 3, 1), Decimal("1000"))])
    assert sorted(y for _, y in out) == [2019, 2020, 2021]
    a, b, c = out[("p", 2019)], out[("p", 2020)], out[("p", 2021)]
    assert (a.START_SEQ, a.END_SEQ, a.EXPOSURE_DAY) == (D(2019, 7, 1), D(2019, 12, 31), 184)
    assert (b.START_SEQ, b.END_SEQ, b.EXPOSURE_DAY, b.DAYS_OF_YEAR) == (D(2020, 1, 1), D(2020, 12, 31), 366, 366)
    assert (c.START_SEQ, c.END_SEQ, c.EXPOSURE_DAY) == (D(2021, 1, 1), D(2021, 3, 1), 59)   # expiry day excluded
    assert b.EXPOSURE_YEAR == 1.0
    assert a.EXPOSURE_YEAR == 184 / 365 and c.EXPOSURE_YEAR == 59 / 365
    total = (184 / 365 + 1.0) + 59 / 365
    assert a.TOTAL_EXPOSURE == total
    assert sum(r.EXPOSURE_PREM for r in out.values()) == pytest.approx(1000.0, abs=1e-9)
    assert [out[("p", y)].YEAR_SEQ for y in (2019, 2020, 2021)] == [1, 2, 3]


def test_one_year_span_ending_in_leap_year(spark):
    # NB_YEAR = 1 and the expiry year is leap: both rows divide by 366 when expiry is after Feb 28
    out = _split(spark, [("p", "c", None, D(2019, 6, 1), D(2020, 3, 1), Decimal("100")),
                         ("q", "c", None, D(2019, 6, 1), D(2020, 2, 28), Decimal("100"))])
    assert out[("p", 2019)].EXPOSURE_YEAR == 214 / 366 and out[("p", 2020)].EXPOSURE_YEAR == 60 / 366
    assert out[("q", 2019)].EXPOSURE_YEAR == 214 / 365 and out[("q", 2020)].EXPOSURE_YEAR == 58 / 365


def test_same_year_is_exposed_to_dec31(spark):
    out = _split(spark, [("p", "c", None, D(2020, 3, 1), D(2020, 6, 1), Decimal("50"))])
    r = out[("p", 2020)]
    assert (r.START_SEQ, r.END_SEQ, r.EXPOSURE_DAY, r.NB_YEAR) == (D(2020, 3, 1), D(2020, 12, 31), 306, 0)
    assert float(r.EXPOSURE_PREM) == pytest.approx(50.0)


def test_expiry_on_dec31_and_missing_dates(spark):
    out = _split(spark, [("a", "c", None, D(2019, 1, 1), D(2019, 12, 31), Decimal("10")),
                         ("b", "c", None, D(2019, 5, 1), None, Decimal("10")),          # expiry ← start + 1 year
                         ("d", "c", D(2018, 2, 1), None, D(2018, 8, 1), Decimal("10")),  # start ← init
                         ("e", "c", None, None, None, Decimal("10"))])                   # no dates: no rows
    assert out[("a", 2019)].EXPOSURE_DAY == 365
    assert out[("b", 2020)].END_SEQ == D(2020, 5, 1)
    assert out[("d", 2018)].START_SEQ == D(2018, 2, 1)
    assert not [k for k in out if k[0] == "e"]


def test_expiry_before_start_gives_expiry_year_only(spark):
    out = _split(spark, [("p", "c", None, D(2021, 5, 1), D(2020, 3, 1), Decimal("10"))])
    assert list(out) == [("p", 2020)]


def test_non_positive_premium_rows_are_dropped(spark):
    out = _split(spark, [("z", "c", None, D(2019, 1, 1), D(2019, 6, 1), Decimal("0")),
                         ("n", "c", None, D(2019, 1, 1), D(2019, 6, 1), Decimal("-5")),
                         ("j", "c", None, D(2019, 6, 1), D(2020, 1, 1), Decimal("5"))])  # last row has 0 days
    assert list(out) == [("j", 2019)]


def test_year_filter(spark):
    out = _split(spark, [("p", "c", None, D(2019, 7, 1), D(2021, 3, 1), Decimal("1000"))], years=[2020])
    assert list(out) == [("p", 2020)]


def test_premium_is_preserved_per_policy_at_scale(spark):
    from pyspark.sql import functions as F

    from riskframe.plans import glm
    from riskframe.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    py = glm.policy_years(fx)
    bad = (py.groupBy("POLICY_ID").agg(F.sum("EXPOSURE_PREM").alias("s"), F.first("GWP").alias("g"))
             .filter(F.abs(F.col("s") - F.col("g").cast("double")) > 1e-6).count())
    assert bad == 0
