"""The writes of the combination give their shuffles back, move policies instead of policy-years, and keep their rows with and without hot policies."""

import random
import time
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskframe.operators import claims as C
from riskframe.operators.exposure import split_exposure
from riskframe.plans import glm
from riskframe.sources.fixtures import Fixtures

CLAIMS = "CLAIM_ID string, POLICY_ID string, CERTIFICATE_ID string, OCCURENCE_DATE date, CLAIM_PMT decimal(20,4)"
POLICIES = "POLICY_ID string, CERTIFICATE_ID string, START_DATE date, EXPIRY_DATE date, GWP decimal(20,4)"


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(4)
    day = lambda: date(2019, 1, 1) + timedelta(rnd.randrange(1100))
    who = lambda i: ("HOT", "c") if i % 3 == 0 else (rnd.choice([None, "P1"]), rnd.choice([None, "c"])) if i % 40 == 1 else (f"P{rnd.randrange(90)}", "c")
    claims = [(None if i % 11 == 7 else f"{i % 800}", *who(i), None if i % 60 == 5 else day(), None if i % 70 == 3 else Decimal(rnd.randint(-80, 900))) for i in range(1500)]
    policies = [(p, "c", s := day(), s + timedelta(rnd.randrange(900)), Decimal(rnd.randint(-5, 900))) for p in ["HOT", "HOT", None, *[f"P{k}" for k in range(0, 120, 2)]]]
    return spark.createDataFrame(policies, POLICIES), spark.createDataFrame(claims, CLAIMS)


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("hot_claims", [1, 50, 10**9])
@pytest.mark.parametrize("dealt", [False, True])
def test_rows_and_figures_whatever_is_hot_or_dealt(spark, data, tmp_path, monkeypatch, hot_claims, dealt):
    monkeypatch.setattr(C, "HOT_CLAIMS", hot_claims)
    policies, claims = data
    py, path = split_exposure(policies.repartition(*C.KEYS) if dealt else policies), str(tmp_path / "c")
    got = {r.metric: r.value for r in C.write_combined(py, claims, 2020, path).collect()}
    assert got == {r.metric: r.value for r in C.reconcile_claims(py, claims, 2020).collect()} and got["dup_claim"] > 0 and got["claim_negative"] < 0
    assert rows(spark.read.parquet(f"{path}/combined")) == rows(C.attach_claims(py, claims))
    groups = spark.read.parquet(f"{path}/claim_groups")
    assert groups.count() == groups.select(*C.KEYS, "LD_YEAR").distinct().count()
    assert rows(groups.where("_grouped").select(*C.KEYS, "LD_YEAR", "NUM_CLAIMS", "CLAIM_PMT")) == rows(C.group_claims(claims))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def test_the_writes_give_their_shuffles_back(spark, data, tmp_path, monkeypatch):
    policies, claims = data
    conf, written = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    parquet = type(claims.write).parquet
    monkeypatch.setattr(type(claims.write), "parquet", lambda self, path, *a: (written.append((path.split("/")[-1], spark.conf.get(conf))), parquet(self, path, *a))[1])
    before, old = shuffle_files(spark), spark.conf.get(conf)
    C.write_combined(split_exposure(policies), claims, 2020, str(tmp_path / "c"))
    for _ in range(10):  # they go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and spark.conf.get(conf) == old
    assert written == [("claims", "true"), ("claim_groups", "true"), ("combined", "true")] and not (tmp_path / "c" / "claims").exists()


def test_policies_travel_before_they_are_split(spark, tmp_path, monkeypatch):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    plans, observe = [], type(fx["v_claim"]).observe

    def seen(self, *a):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return observe(self, *a)

    monkeypatch.setattr(type(fx["v_claim"]), "observe", seen)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        C.write_combined(glm.policy_years(fx, dealt=True), fx["v_claim"], 1997, str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    years = plans[-1].split("posexplode")
    assert len(years) > 1 and "Join" in years[0] and "Exchange" not in years[0] and "Exchange" in years[1]


def test_a_list_that_the_totals_tell_travels_as_its_date(spark, data):
    groups = C._all_claim_groups(data[1], "CLAIM_PMT").where("_grouped")
    light = C._light_dates(groups, "CLAIM_PMT")
    assert light.where(F.col("_day").isNotNull() & F.col("_DATES").isNotNull()).isEmpty() and 0 < light.where("_day is not null").count() < light.count()
    assert rows(C._whole_dates(light, groups, "CLAIM_PMT")) == rows(groups)
