import pytest

from riskframe.functions.buckets import INF, amount_labels, bucketize, unit_labels


def test_amount_labels():
    edges, labels = amount_labels([0, 4e8, 1e9, "Infinity"])
    assert edges == [0, 4e8, 1e9, INF]
    assert labels == ["01-From 0 to 400m", "02-Above 400m to 1.00bn", "03-Above 1.00bn"]


def test_unit_labels_shift_inner_edges():
    edges, labels = unit_labels([0, 3, 6, INF], "years")
    assert edges == [0, 2, 5, INF]
    assert labels == ["01-Under 3 years", "02-From 3 to 5 years", "03-From 6 years and above"]


def test_vietnamese_labels():
    _, labels = unit_labels([0, 3, 6, INF], "năm", locale="vi")
    assert labels == ["01-Dưới 3 năm", "02-Từ 3 đến 5 năm", "03-Từ 6 năm trở lên"]


@pytest.mark.parametrize("edges", [[0, 3, 6], [0, 1, 1, INF], [5]])
def test_bad_unit_edges_raise(edges):
    with pytest.raises(ValueError):
        unit_labels(edges, "years")


def test_right_closed_lowest_included(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 2.0, 2.5, 5.0, 5.5, 99.0, -1.0, None]], "x double")
    out = [r.g for r in bucketize(df, "x", "g", [0, 3, 6, INF], "unit", unit="years").collect()]
    assert out == ["01-Under 3 years", "01-Under 3 years", "02-From 3 to 5 years", "02-From 3 to 5 years",
                   "03-From 6 years and above", "03-From 6 years and above", "NaN", "NaN"]


def test_amount_edges_and_text_values(spark):
    df = spark.createDataFrame([("0",), ("400000000",), ("400000001",), ("abc",)], "x string")
    out = [r.g for r in bucketize(df, "x", "g", [0, 4e8, INF], "amount").collect()]
    assert out == ["01-From 0 to 400m", "01-From 0 to 400m", "02-Above 400m", "NaN"]


def test_bucketize_from_settings_and_health_nway(spark):
    from decimal import Decimal

    from riskframe.functions.buckets import bucketize_from_settings
    from riskframe.operators.nway import NWaySpec, n_way
    df = spark.createDataFrame([
        (2020, "P1", "C1", 30, Decimal("5e8"), 0, Decimal("0"), 1.0, Decimal("100")),
        (2020, "P1", "C2", 45, Decimal("2e8"), 1, Decimal("50"), 0.5, Decimal("60")),
        (2020, "P2", "C3", 61, Decimal("1.5e9"), 2, Decimal("70"), 1.0, Decimal("90")),
    ], "CAL_YEAR int, POLICY_ID string, CERTIFICATE_ID string, CERT_AGE int, SUM_ASSURED decimal(20,4), "
       "NUM_CLAIMS long, CLAIM_PMT decimal(20,4), EXPOSURE_YEAR double, EXPOSURE_PREM decimal(20,4)")
    b = bucketize_from_settings(df, {"SUM_ASSURED_GROUP": {"bin": [0, 4e8, 1e9, "Infinity"], "unit": "m"},
                                     "CERT_AGE_GROUP": {"bin": [0, 40, 60, "Infinity"], "unit": "years"}})
    assert [r.SUM_ASSURED_GROUP for r in b.collect()] == ["02-Above 400m to 1.00bn", "01-From 0 to 400m", "03-Above 1.00bn"]
    assert [r.CERT_AGE_GROUP for r in b.collect()] == ["01-Under 40 years", "02-From 40 to 59 years", "03-From 60 years and above"]
    # HEALTH counts certificates, not policies, and sums SUM_ASSURED of first rows
    out = {r.VAR_DETAIL: r for r in n_way(b, NWaySpec(factors=["CERT_AGE_GROUP"], years=[2020], product="HEALTH")).collect()}
    assert out["02-From 40 to 59 years"].NUM_POLS == 1 and out["02-From 40 to 59 years"].SUM_ASSURED == Decimal("200000000.0000")
    assert sum(r.NUM_POLS for r in out.values()) == 3
