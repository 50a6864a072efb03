"""Figures that are observed while writing equal those of the reconciliation passes, with fewer scans."""

import os

from pyspark.sql import functions as F

from riskframe.operators.claims import reconcile_claims, write_combined
from riskframe.operators.exposure import reconcile_exposure, split_exposure, write_exposure
from riskframe.plans import glm
from riskframe.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_exposure_figures_of_the_write(spark, tmp_path):
    p = Fixtures(spark, SF)["v_policy"]
    few = lambda n: p.where(F.col("POLICY_ID").cast("long") <= n)
    odd = few(3).withColumns({"EXPIRY_DATE": F.date_sub("START_DATE", 400), "GWP": F.lit(None).cast("decimal(20,4)")})
    p = p.unionByName(few(5)).unionByName(odd).unionByName(few(2).withColumn("START_DATE", F.lit(None).cast("date")))
    got, want = write_exposure(p, str(tmp_path / "e")).first().asDict(), reconcile_exposure(p).first().asDict()
    assert abs(got.pop("premium_after_exposure") - want.pop("premium_after_exposure")) < 1e-3 and got == want
    assert got["dup_policy_years"] > 0 and got["rows_null_premium"] > 0
    kept = spark.read.parquet(str(tmp_path / "e")).where("KEPT = 'true'").drop("KEPT")
    assert kept.count() == split_exposure(p).count() and set(kept.columns) == set(split_exposure(p).columns)
    empty = write_exposure(p.limit(0), str(tmp_path / "none")).first()
    assert (empty.rows_after_split, empty.dup_policy_years, empty.premium_of_original) == (0, 0, None)


def test_claim_figures_of_the_writes(spark, tmp_path):
    fx = Fixtures(spark, SF)
    claims = fx["v_claim_ext"]
    few = lambda n, claims=claims: claims.where(F.col("CERTIFICATE_ID").cast("long") <= n)
    odd = [few(3), few(2).withColumn("CLAIM_ID", F.lit(None).cast("string")), few(1).withColumn("POLICY_ID", F.lit(None).cast("string")), few(1).withColumn("OCCURENCE_DATE", F.lit(None).cast("date"))]
    for more in odd:
        claims = claims.unionByName(more)
    py = glm.policy_years(fx)
    got = {r.metric: r.value for r in write_combined(py, claims, glm.ANALYSIS_YEAR, str(tmp_path / "c")).collect()}
    assert got == {r.metric: r.value for r in reconcile_claims(py, claims, glm.ANALYSIS_YEAR).collect()}
    assert got["rows_unmatched"] > 0 and got["dup_claim"] > 0 and sorted(os.listdir(tmp_path / "c")) == ["claim_groups", "combined"]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_the_writes_read_each_source_once(spark, tmp_path, monkeypatch):
    fx = Fixtures(spark, SF)
    py, claims = glm.policy_years(fx), fx["v_claim"]
    seen, observe = [], type(claims).observe
    monkeypatch.setattr(type(claims), "observe", lambda self, *a: (seen.append(scans(self)), observe(self, *a))[1])
    write_combined(py, claims, glm.ANALYSIS_YEAR, str(tmp_path / "c")).collect()
    assert seen == [scans(claims), scans(py) + 1]  # the claim groups are read back
    assert scans(reconcile_claims(py, claims, glm.ANALYSIS_YEAR)) > sum(seen)
