import datetime as dt
from decimal import Decimal

from riskframe.operators.claims import attach_claims, group_claims, unmatched_claims

D = dt.date
PY = "POLICY_ID string, CERTIFICATE_ID string, CL_YEAR int, START_SEQ date, END_SEQ date, EXPOSURE_PREM double"
CL = "CLAIM_ID string, POLICY_ID string, CERTIFICATE_ID string, OCCURENCE_DATE date, CLAIM_PMT decimal(20,4)"


def test_attach_closed_interval_and_filters(spark):
    py = spark.createDataFrame([("p", "c", 2020, D(2020, 3, 1), D(2020, 12, 31), 1.0),
                                ("q", "c", 2020, D(2020, 1, 1), D(2020, 6, 1), 1.0)], PY)
    cl = spark.createDataFrame([
        ("1", "p", "c", D(2020, 3, 1), Decimal("10")),     # on START_SEQ: in
        ("2", "p", "c", D(2020, 12, 31), Decimal("20")),   # on END_SEQ: in
        ("3", "p", "c", D(2020, 2, 1), Decimal("30")),     # before: out of sequence
        ("4", "p", "c", D(2020, 5, 1), Decimal("-5")),     # negative: dropped
        ("5", "p", None, D(2020, 5, 1), Decimal("7")),     # null key: dropped
        ("6", "p", "c", D(2021, 1, 5), Decimal("9")),      # year without policy row
        ("7", "x", "c", D(2020, 1, 5), Decimal("4")),      # policy not in exposure
    ], CL)
    out = {r.POLICY_ID: r for r in attach_claims(py, cl).collect()}
    p = out["p"]
    assert (p.NUM_CLAIMS, p.CLAIM_PMT) == (3, Decimal("60.0000"))
    assert (p.NUM_CLAIMS_SEQ, p.NUM_CLAIMS_NOT_SEQ) == (2, 1)
    assert (p.CLAIM_PMT_SEQ, p.CLAIM_PMT_NOT_SEQ) == (Decimal("30.0000"), Decimal("30.0000"))
    q = out["q"]
    assert q.NUM_CLAIMS is None and q.CLAIM_PMT is None and (q.NUM_CLAIMS_SEQ, q.NUM_CLAIMS_NOT_SEQ) == (0, 0)
    un = {(r.POLICY_ID, r.LD_YEAR) for r in unmatched_claims(py, cl).collect()}
    assert un == {("x", 2020)}


def test_repeated_claim_id_counts_rows_but_sequence_once(spark):
    cl = spark.createDataFrame([("1", "p", "c", D(2020, 3, 1), Decimal("10")),
                                ("1", "p", "c", D(2020, 4, 1), Decimal("15"))], CL)
    g = group_claims(cl).first()
    assert (g.NUM_CLAIMS, g.CLAIM_PMT) == (2, Decimal("25.0000"))
    py = spark.createDataFrame([("p", "c", 2020, D(2020, 1, 1), D(2020, 12, 31), 1.0)], PY)
    r = attach_claims(py, cl).first()
    assert r.NUM_CLAIMS_SEQ == 1 and r.CLAIM_PMT_SEQ == Decimal("15.0000")   # latest entry kept


def test_prepare_claims_parses_text_dates(spark):
    from riskframe.operators.claims import prepare_claims
    df = spark.createDataFrame([("1", "p", "c", "3-15-2020", "12.5", "51A12345"), ("2", "p", "c", "bad", "x", None),
                                ("3", "p", "c", "1-2-2019", "1", None)],
                               "CLAIM_ID string, POLICY_ID string, CERTIFICATE_ID string, OCCURENCE_DATE string, "
                               "CLAIM_COST string, REG_NO string")
    out = prepare_claims(df, 2020).collect()
    assert len(out) == 1 and out[0].OCCURENCE_DATE == D(2020, 3, 15) and out[0].CLAIM_COST == 12.5
    assert out[0].REG_NO == "51A12345" and out[0].LD_YEAR == 2020


def test_coverage_codes(spark):
    from riskframe.functions.text import coverage_codes
    s = spark.createDataFrame([("NUM_CLAIMS_AC01", "NUM_CLAIMS_Glass", "VARS_AC", 1),
                               ("CLAIM_PMT_AC01", "CLAIM_PMT_Windscreen", "VARS_AC", 2),
                               ("NUM_CLAIMS_AC02", "AC02", "VARS_AC", 3),
                               ("GWP", "Premium", "INFO", 4)],
                              "standard_name string, import_name string, variable_type string, ordinal int")
    assert [tuple(r) for r in coverage_codes(s).collect()] == [("AC01", "Windscreen")]


def test_claims_are_summed_in_two_shuffles(spark):
    from datetime import date
    from decimal import Decimal
    from riskframe.operators.claims import claims_by_year
    rows = [("p", "c", f"k{i % 40}" if i % 9 else None, date(2020, 1, 1 + i % 28), Decimal(i)) for i in range(300)]
    claims = spark.createDataFrame(rows, "POLICY_ID string, CERTIFICATE_ID string, CLAIM_ID string, OCCURENCE_DATE date, CLAIM_PMT decimal(20,4)")
    years = claims_by_year(claims)
    got = years.collect()
    last = {}
    for *_, k, d, a in rows:
        if k:
            last[k] = max(last.get(k, (date.min, 0)), (d, a))
    assert len(got) == 1 and got[0].CLAIM_PMT == sum(r[-1] for r in rows) and got[0].NUM_CLAIMS == sum(r[2] is not None for r in rows)
    assert sum(d._n for d in got[0]._DATES) == len(last) + sum(r[2] is None for r in rows)
    assert sum(d._amt for d in got[0]._DATES) == sum(a for _, a in last.values()) + sum(r[-1] for r in rows if r[2] is None)
    assert years._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
