import tempfile

from pyspark.sql import functions as F

from riskframe.plans.quality import DIRTY_SETTINGS
from riskframe.sources.fixtures import Fixtures
from riskframe.streaming import ingest_stream


def test_ingest_stream_is_complete_and_idempotent(spark):
    src, sink, ck = (tempfile.mkdtemp(prefix="rf-") for _ in range(3))
    dirty = Fixtures(spark, "/root/testdata/sf0.001")["v_dirty"]
    dirty.filter(F.col("event_id") < 500).write.mode("overwrite").parquet(f"{src}/part1")
    dirty.filter(F.col("event_id") >= 500).write.mode("overwrite").parquet(f"{src}/part2")
    q = ingest_stream(spark, f"{src}/*", dirty.schema, DIRTY_SETTINGS, sink, checkpoint=ck)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == dirty.count()
    assert set(out.columns) >= {"CLAIM_ID", "SALES_CHANNEL", "GWP", "START_DATE", "REG_NO", "COVERAGE_ID", "batch_id"}
    # a second run with the same checkpoint finds nothing new and writes nothing twice
    q2 = ingest_stream(spark, f"{src}/*", dirty.schema, DIRTY_SETTINGS, sink, checkpoint=ck)
    q2.awaitTermination(120)
    assert spark.read.parquet(sink).count() == dirty.count()


def test_pnt11_report_one_call_equals_registered_query(spark):
    import __spark_entry__ as entry
    from riskframe.operators.pnt11 import pnt11_report
    from riskframe.plans import mof
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    res = fx["v_reserve"].withColumnRenamed("USAGE_CODE", "COVERAGE_ID")
    rep = pnt11_report(fx["v_mof_premium"], fx["v_mof_claim"], res, fx["m_coverage"], fx["m_vehicle"], mof.AGE_EDGES,
                       reserve_template="RES_PNT_11_02")
    q = entry.queries()["pnt11_combined"](spark, "/root/testdata/sf0.001")
    key = ["PROD_MOF_CODE", "PNT_11_CODE", "SUB_PNT_11_CODE", "AGE_PNT_11_CODE"]
    a = {tuple(r[k] for k in key): float(r.RES_PERIOD) for r in rep.collect()}
    b = {tuple(r[k] for k in key): float(r.RES_PERIOD) for r in q.collect()}
    assert a == b and len(a) > 0


def test_segments_equal_text_key_grouping(spark):
    from decimal import Decimal

    from riskframe.functions.buckets import INF
    from riskframe.operators import pnt11 as P
    cov = [{"cols": "A", "PROD_MOF_CODE": "01", "PROD_MOF_NAME": "Motor"},
           {"cols": "B", "PROD_MOF_CODE": "01", "PROD_MOF_NAME": "Motor"},      # same output tuple as A
           {"cols": "C", "PROD_MOF_CODE": "02", "PROD_MOF_NAME": "Other"}]
    veh = [{"cols": "car", "PNT_11_CODE": "1", "PNT_11_NAME": "Car", "SUB_PNT_11_CODE": "11", "SUB_PNT_11_NAME": "Small"}]
    rows = [("A", "car", 1, "r1", Decimal("1"), Decimal("10")), ("B", "car", 2, "r2", Decimal("2"), Decimal("20")),
            ("C", "truck", 7, "r3", Decimal("3"), Decimal("30")), ("Z", "car", None, "r1", Decimal("4"), Decimal("40")),
            ("A", "car", 99, "r4", Decimal("5"), Decimal("50"))]
    df = spark.createDataFrame(rows, "COVERAGE_ID string, TYPE_VEHICLE string, VEHICLE_AGE int, REG_NO string, "
                                     "VEHICLE_VALUE decimal(20,4), GWP decimal(20,4)")
    edges = [0, 3, 6, INF]
    by_text = P.summary_gwp(P.apply_mapping(df, cov, veh, edges))
    sg = P.Segments(cov, veh, edges)
    by_seg = sg.decode(P.summary_gwp(df.withColumn("_SEG", sg.seg()), ["_SEG"]))
    norm = lambda d: sorted(tuple(r[c] for c in P.KEYS + ["NUM_CARS", "SUM_ASSURED", "GROSS_PREMIUM"]) for r in d.collect())
    assert norm(by_text) == norm(by_seg)
    assert len(norm(by_seg)) == 4            # A and B share a segment; unmapped and NaN ages get their own
