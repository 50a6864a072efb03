"""Hot keys: one policy owns a third of all rows; results must equal a brute-force computation."""

import random
from decimal import Decimal

import pandas as pd

from riskframe.operators.claims import attach_claims
from riskframe.operators.nway import NWaySpec, n_way

SCHEMA = ("CAL_YEAR int, POLICY_ID string, A string, NUM_CLAIMS long, CLAIM_PMT decimal(20,4), "
          "EXPOSURE_YEAR double, EXPOSURE_PREM decimal(20,4), VEHICLE_VALUE decimal(20,4)")


def _rows(n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        pol = "HOT" if i % 3 == 0 else f"P{i}"
        rows.append((rnd.choice([2020, 2021]), pol, rnd.choice("abc"), rnd.randint(0, 2),
                     Decimal(rnd.randint(0, 10 ** 6)) / 100, rnd.randint(1, 365) / 365.0,
                     Decimal(rnd.randint(1, 10 ** 7)) / 100, Decimal(rnd.randint(1, 10 ** 9)) / 100))
    return rows


def _brute(pdf: pd.DataFrame, year: int) -> dict:
    d = pdf if year == 0 else pdf[pdf.CAL_YEAR == year]
    allrow = d.groupby("A").agg(NUM_POLS=("POLICY_ID", "nunique"), NUM_CLAIMS=("NUM_CLAIMS", "sum"),
                                CLAIM_PMT=("CLAIM_PMT", "sum"))
    # first row of each policy: smallest (CAL_YEAR, A, EXPOSURE_YEAR, EXPOSURE_PREM, VEHICLE_VALUE)
    first = d.sort_values(["CAL_YEAR", "A", "EXPOSURE_YEAR", "EXPOSURE_PREM", "VEHICLE_VALUE"]).drop_duplicates("POLICY_ID")
    expo = first.groupby("A").agg(EXPOSURE_PREM=("EXPOSURE_PREM", "sum"), SUM_ASSURED=("VEHICLE_VALUE", "sum"))
    out = {}
    for a in allrow.index:
        ep = expo.EXPOSURE_PREM.get(a, Decimal(0))
        out[a] = (int(allrow.NUM_POLS[a]), int(allrow.NUM_CLAIMS[a]), ep, expo.SUM_ASSURED.get(a, Decimal(0)))
    return out


def test_hot_policy_nway_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for year in (0, 2021):
        res = n_way(df, NWaySpec(factors=["A"], years=[year])).collect()
        got = {r.VAR_DETAIL: (r.NUM_POLS, r.NUM_CLAIMS, r.EXPOSURE_PREM, r.SUM_ASSURED) for r in res}
        want = {a: (p, n, Decimal(ep).quantize(Decimal("0.0001")), Decimal(sa).quantize(Decimal("0.0001")))
                for a, (p, n, ep, sa) in _brute(pdf, year).items()}
        assert got == want, year


def test_hot_claim_key_attach_equals_brute_force(spark):
    import datetime as dt
    rnd = random.Random(3)
    py = [("HOT", "c", 2020, dt.date(2020, 3, 1), dt.date(2020, 9, 30), 1.0)] + \
         [(f"P{i}", "c", 2020, dt.date(2020, 1, 1), dt.date(2020, 12, 31), 1.0) for i in range(300)]
    claims = []
    for i in range(3000):
        pol = "HOT" if i % 3 == 0 else f"P{rnd.randrange(300)}"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(366))
        claims.append((f"C{i}", pol, "c", day, Decimal(rnd.randint(0, 10 ** 6)) / 100))
    pyd = spark.createDataFrame(py, "POLICY_ID string, CERTIFICATE_ID string, CL_YEAR int, START_SEQ date, END_SEQ date, "
                                    "EXPOSURE_PREM double")
    cld = spark.createDataFrame(claims, "CLAIM_ID string, POLICY_ID string, CERTIFICATE_ID string, OCCURENCE_DATE date, "
                                        "CLAIM_PMT decimal(20,4)").repartition(8)
    got = {r.POLICY_ID: (r.NUM_CLAIMS or 0, r.NUM_CLAIMS_SEQ, r.CLAIM_PMT_SEQ or Decimal(0)) for r in attach_claims(pyd, cld).collect()}
    bounds = {p[0]: (p[3], p[4]) for p in py}
    for pol, (lo, hi) in bounds.items():
        mine = [c for c in claims if c[1] == pol]
        inside = [c for c in mine if lo <= c[3] <= hi]
        assert got[pol] == (len(mine), len(inside), sum((c[4] for c in inside), Decimal(0))), pol
