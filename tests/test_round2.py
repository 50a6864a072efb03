"""Checks of this round: whole completion, restart-safe names, sessions that are given, scans and exchanges of the n-way plan."""

import os
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskframe.functions.buckets import INF, amount_labels, unit_labels
from riskframe.functions.numeric import to_number
from riskframe.operators import nway
from riskframe.operators.validate import Profile
from riskframe.plans import glm
from riskframe.sources.fixtures import Fixtures

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(spark):
    return spark.createDataFrame([(1997, "p1", "A", 1, Decimal(10), 1.0, Decimal(100), Decimal(5)), (1997, "p2", "NaN", 0, Decimal(0), 1.0, Decimal(900), Decimal(7))],
                                 "CAL_YEAR int, POLICY_ID string, G_GROUP string, NUM_CLAIMS long, CLAIM_PMT decimal(20,4), EXPOSURE_YEAR double, EXPOSURE_PREM decimal(20,4), VEHICLE_VALUE decimal(20,4)")


@pytest.mark.parametrize("with_labels", [True, False])
def test_completion_keeps_unbucketed_groups(spark, with_labels):
    df = rows(spark)
    table = nway.n_way(df, nway.NWaySpec(factors=["G_GROUP"], n=1, years=[1997]))
    domain = nway.factor_domain(df, "G_GROUP", ["A", "B"]) if with_labels else ["A", "B"]
    full = nway.complete_groups(table, [domain], [1997], "001_G_GROUP", ["G_GROUP"])
    got = {r.VAR_DETAIL: r.EXPOSURE_PREM for r in full.collect()}
    assert got == {"A": 100, "B": 0, "NaN": 900}


def test_nway_reads_and_shuffles_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = glm.glm_table(Fixtures(spark, "/root/testdata/sf0.001"))
        plan = nway.n_way(t, nway.NWaySpec(factors=glm.FACTORS, n=2, years=[1996, 1998]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Expand" not in plan and plan.count("FileScan parquet") <= 5
    assert plan.count("Exchange hashpartitioning") <= 14


@pytest.mark.parametrize("text, value", [("NaN", None), ("Infinity", None), ("-inf", None), ("12d", None), ("3f", None), ("", None), ("1e400", None), (" 7 ", 7.0),
                                         ("-2.5e1", -25.0), (".5", 0.5), ("5.", 5.0), ("0x1", None)])
def test_strict_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "v string").select(to_number(F.col("v"))).first()[0] == value


def test_reserve_template_has_no_key():
    assert Profile.of("MOF", "RES_PNT_11_02").duplicate_keys == ()
    assert Profile.of("MOF", "CLM_X").duplicate_keys == (("CLAIM_ID",),)


def test_labels():
    assert unit_labels([0, 3, 6, INF], "years") == ([0.0, 2.0, 5.0, INF], ["01-Under 3 years", "02-From 3 to 5 years", "03-From 6 years and above"])
    assert unit_labels([0, 3, INF], "năm", "vi")[1] == ["01-Dưới 3 năm", "02-Từ 3 năm trở lên"]
    assert amount_labels([0, 4e8, 1e9, "Infinity"])[1] == ["01-From 0 to 400m", "02-Above 400m to 1.00bn", "03-Above 1.00bn"]
    assert amount_labels([0, 4e8, 1e9])[1] == ["01-From 0 to 400m", "02-Above 400m to 1.00bn"]
    with pytest.raises(ValueError):
        unit_labels([0, 3, 6], "years")


def run(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | env, capture_output=True, text=True, timeout=120).stdout.strip().splitlines()[-1]


def test_stream_name_is_the_same_in_every_process():
    code = "from riskframe.streaming.ingest import _job_name; print(_job_name('/in', '/out'))"
    assert run(code, PYTHONHASHSEED="1") == run(code, PYTHONHASHSEED="2")


def test_a_given_master_and_settings_stay():
    code = ("from riskframe.session import get_spark; s = get_spark();"
            "print(s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.session.timeZone'))")
    args = "--master local[2] --conf spark.sql.shuffle.partitions=77 --conf spark.ui.enabled=false --conf spark.sql.session.timeZone=Asia/Tokyo pyspark-shell"
    assert run(code, PYSPARK_SUBMIT_ARGS=args).split() == ["local[2]", "77", "Asia/Tokyo"]


def test_no_checkpoint_folder_is_made_up_on_a_cluster(spark, monkeypatch):
    from riskframe import session

    class Context:
        master = "local-cluster[2,1,1024]"
        _jsc = spark.sparkContext._jsc

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        pytest.skip("a checkpoint folder is set already")
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
