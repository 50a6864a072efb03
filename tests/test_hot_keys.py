"""A policy that holds most claims: spread over tasks, with the rows and maps of the plain join."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskframe.operators import skew
from riskframe.operators.claims import KEYS, claim_maps, claims_in_sequence

CLAIMS = "CLAIM_ID string, POLICY_ID string, CERTIFICATE_ID string, OCCURENCE_DATE date, CLAIM_PMT decimal(20,4)"
YEARS = "POLICY_ID string, CERTIFICATE_ID string, CL_YEAR int, START_SEQ date, END_SEQ date"


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    day = lambda: date(2020, 1, 1) + timedelta(rnd.randrange(700))
    claims = []
    for i in range(6000):
        who = ("HOT", "c") if i % 3 == 0 else (f"P{rnd.randrange(400)}", "c")
        claims.append((None if i % 50 == 7 else f"{i % 5500}", *who, date(2020, 5, 5) if who[0] == "HOT" and i % 2 else day(), Decimal(rnd.randint(-50, 900))))
    claims += [("x", None, "c", day(), Decimal(1)), ("y", "P1", None, day(), Decimal(1)), ("z", "P1", "c", None, Decimal(1)), ("w", "P1", "c", day(), None)]
    years = [(p, "c", y, date(y, 3, 1), date(y, 3 + p.count("1"), 20)) for p in ["HOT", *[f"P{k}" for k in range(0, 400, 2)]] for y in (2020, 2021)]
    years += [("HOT", "c", 2020, date(2020, 6, 1), date(2020, 12, 31)), years[0], (None, "c", 2020, date(2020, 1, 1), date(2020, 2, 1))]
    return spark.createDataFrame(years, YEARS), spark.createDataFrame(claims, CLAIMS), years, claims


def brute(years, claims):
    last = {}
    for k, (i, p, c, d, a) in enumerate(claims):
        if None in (p, c, d, a) or a < 0:
            continue
        key = (p, c, d.year, i if i is not None else ("none", k))
        last[key] = max(last.get(key, (d, a)), (d, a))
    out = []
    for (p, c, y, i), (d, a) in last.items():
        for s, e in {(s, e) for q, r, z, s, e in years if (q, r, z) == (p, c, y)}:
            out.append((p, c, y, i if isinstance(i, str) else None, d, a, s, e, s <= d <= e))
    return sorted(out, key=repr)


COLUMNS = [*KEYS, "LD_YEAR", "CLAIM_ID", "OCCURENCE_DATE", "CLAIM_PMT", "START_SEQ", "END_SEQ", "IN_SEQ"]


@pytest.mark.parametrize("hot_claims", [1, 40, 10**9])
def test_hot_policy_equals_brute_force(data, hot_claims):
    py, claims, years, rows = data
    got = claims_in_sequence(py, claims, hot_claims=hot_claims).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(years, rows)


def test_hot_policy_is_read_by_all_tasks(spark, data):
    py, claims, _, _ = data
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = claims_in_sequence(py, claims, hot_claims=40).where("POLICY_ID = 'HOT' and LD_YEAR = 2020")
        tasks = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks) < 0.5 * sum(tasks)


def test_only_hot_keys_are_repeated_and_many_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 1), (None, 2)], "k string, v int")
    other = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), (None, "n")], "k string, w string")
    hot = skew.HotKeys(rows, ["k"], 10)
    assert hot.count == 1 and sorted(r.k or "" for r in hot.repeated(other).collect()) == ["", *["a"] * 10, "b", "c"]
    for limit in (0, 10):
        monkeypatch.setattr(skew, "BROADCAST_KEYS", limit)
        assert hot.join(rows, other, ["v"]).count() == 101
    assert skew.HotKeys(rows, ["k"], 1000).join(rows, other, ["v"]).count() == 101
    with pytest.raises(ValueError):
        skew.HotKeys(rows, ["k"], 0)


def test_maps_hold_what_the_rows_hold(data):
    py, claims, years, rows = data
    got = claim_maps(py, claims, map_claims=25).collect()
    entries = sorted((r.POLICY_ID, r.CERTIFICATE_ID, r.LD_YEAR, i, a, r.START_SEQ, r.END_SEQ, inside)
                     for r in got for m, inside in ((r.IN_SEQ, True), (r.NOT_SEQ, False)) for i, a in m.items())
    assert entries == sorted(x[:4] + x[5:] for x in brute(years, rows) if x[3] is not None)
    assert all({**r.IN_SEQ, **r.NOT_SEQ}.keys() == r.CLAIM_OCCURENCE.keys() for r in got)
    assert max(len(r.CLAIM_OCCURENCE) for r in got) <= 60 and len({r.CHUNK for r in got if r.POLICY_ID == "HOT"}) > 20
