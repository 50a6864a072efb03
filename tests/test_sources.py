import os
import tempfile

from riskframe.sources.files import load_template, mapping_from_header, read_two_header, union_data_parts
from riskframe.sources.sinks import write_if_changed


def test_two_header_csv(spark):
    d = tempfile.mkdtemp(prefix="rf-")
    p = os.path.join(d, "gwp.csv")
    with open(p, "w") as f:
        f.write("POLICY_ID,GWP\nSo hop dong,Phi bao hiem\nA1,100\nA2,200\n")
    df, mapping = read_two_header(spark, p)
    assert mapping == {"POLICY_ID": "So hop dong", "GWP": "Phi bao hiem"}
    assert sorted(tuple(r) for r in df.collect()) == [("A1", "100"), ("A2", "200")]


def test_numeric_second_row_is_rejected(spark):
    import pytest
    for value in ("2.5", "2019-12-31", "2019-12-31 10:00:00"):
        with pytest.raises(ValueError):
            mapping_from_header(spark.createDataFrame([("x", value)], "a string, b string"))
    assert mapping_from_header(spark.createDataFrame([("1", "Name")], "a string, b string")) == {"a": "1", "b": "Name"}


def test_union_parts_by_prefix(spark):
    d = tempfile.mkdtemp(prefix="rf-")
    spark.createDataFrame([(1, "x")], "k int, a string").write.parquet(f"{d}/DATA_2")
    spark.createDataFrame([(2, 5.0)], "k int, b double").write.parquet(f"{d}/DATA_1")
    spark.createDataFrame([(3,)], "k int").write.parquet(f"{d}/NOTES")
    out = union_data_parts(spark, [f"{d}/DATA_2", f"{d}/DATA_1", f"{d}/NOTES"])
    assert sorted(r.k for r in out.collect()) == [1, 2] and set(out.columns) == {"k", "a", "b"}


def test_template_order_and_snapshot_sink(spark):
    t = spark.createDataFrame([("A", "10"), ("A", "2"), ("B", "1"), ("A", "x")], "type string, lineCode string")
    assert [r.lineCode for r in load_template(t, "A").collect()] == ["2", "10", "x"]
    d = tempfile.mkdtemp(prefix="rf-")
    snap = spark.createDataFrame([(1,), (2,)], "k int")
    assert write_if_changed(snap, None, f"{d}/s1")
    assert not write_if_changed(snap, f"{d}/s1", f"{d}/s2")


def test_preview_parts(spark):
    from riskframe.sources.files import preview_parts
    d = tempfile.mkdtemp(prefix="rf-")
    spark.createDataFrame([(i, "x") for i in range(10)], "k int, a string").coalesce(1).write.parquet(f"{d}/DATA_A")
    spark.createDataFrame([(float(i),) for i in range(2)], "b double").coalesce(1).write.parquet(f"{d}/DATA_B")
    rows = preview_parts(spark, [f"{d}/DATA_A", f"{d}/DATA_B"], 3).collect()
    assert len(rows) == 5 and sorted(r.ROW_INDEX for r in rows) == [0, 0, 1, 1, 2]
    assert {r.ROW_JSON for r in rows if r.ROW_INDEX == 0} == {'{"k":0,"a":"x"}', '{"b":0.0}'}
