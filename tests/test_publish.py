"""Snapshots and reports by period: what readers see after each step, and after writes that fail."""

import os

import pytest
from pyspark.sql import functions as F

from riskframe.sources.sinks import write_periods
from riskframe.sources.snapshots import Snapshots, table_digest

ROWS = "k int, v string, m map<string,int>"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def test_digest_tells_content_but_not_order(spark):
    rows = [(1, "a", {"x": 1, "y": 2}), (None, "1", None), (2, None, {}), (2, None, {})]
    one = table_digest(table(spark, rows))
    assert one == table_digest(table(spark, [*rows[::-1][:3], (1, "a", {"y": 2, "x": 1})]).repartition(3))
    for other in (rows[:3], [*rows, rows[0]], [(1, None, {"x": 1, "y": 2}), *rows[1:]], [(1, "a", {"x": 2, "y": 1}), *rows[1:]]):
        assert table_digest(table(spark, other)) != one
    assert table_digest(table(spark, rows).withColumn("k", F.col("k").cast("long"))) != one
    # a null moves to the next column
    assert table_digest(spark.createDataFrame([(None, 5)], "a int, b int")) != table_digest(spark.createDataFrame([(5, None)], "a int, b int"))
    assert table_digest(table(spark, [])).rows == 0


def test_unchanged_tables_are_found_without_old_rows(spark, tmp_path):
    shop = Snapshots(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        shop.read()
    rows = [(i, str(i), {"x": i}) for i in range(50)]
    assert shop.publish(table(spark, rows)) and not shop.publish(table(spark, rows[::-1]).repartition(5))
    first = shop.current()
    for name in os.listdir(tmp_path / "t" / "versions" / first):  # the old rows cannot be read any more
        os.chmod(tmp_path / "t" / "versions" / first / name, 0)
        (tmp_path / "t" / "versions" / first / name).write_bytes(b"") if os.access(tmp_path / "t" / "versions" / first / name, os.W_OK) else None
    assert not shop.publish(table(spark, rows)) and shop.current() == first
    assert shop.publish(table(spark, rows[:-1])) and shop.read().count() == 49 and shop.current() != first
    assert shop.publish(table(spark, [])) and shop.read().count() == 0 and not shop.publish(table(spark, []))
    assert sorted(n for n in os.listdir(tmp_path / "t") if not n.startswith(".")) == ["CURRENT", "digests", "versions"]


def test_a_failed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    shop = Snapshots(spark, str(tmp_path / "t"))
    shop.publish(table(spark, [(1, "a", None)]))
    before = shop.current(), shop.digest()
    bad = table(spark, [(2, "b", None), (3, "c", None)])
    fails = bad.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        shop.publish(fails)
    assert (shop.current(), shop.digest()) == before and shop.read().count() == 1
    write = Snapshots._write
    monkeypatch.setattr(Snapshots, "_write", lambda self, text, *parts: (_ for _ in ()).throw(OSError("killed")) if parts == ("CURRENT",) else write(self, text, *parts))
    with pytest.raises(OSError, match="killed"):  # all written but the pointer
        shop.publish(bad)
    monkeypatch.undo()
    assert (shop.current(), shop.digest()) == before and shop.read().count() == 1
    assert shop.publish(bad) and sorted(r.k for r in shop.read().collect()) == [2, 3]


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_one_period_is_rewritten_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(4000).select((2020 + F.col("id") % 2).cast("int").alias("Y"), (1 + F.col("id") % 12).cast("int").alias("M"), "id")
    write_periods(rows, path, ["Y", "M"], ["id"])
    before = files(path)
    assert spark.read.parquet(path).count() == 4000 and len(before) <= 24
    write_periods(rows.where("Y = 2020 and M = 3").withColumn("id", -F.col("id")), path, ["Y", "M"])
    after = files(path)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all("Y=2020/M=3/" in f for f in changed)
    back = spark.read.parquet(path)
    assert back.count() == 4000 and back.where("id < 0").select("Y", "M").distinct().collect() == [(2020, 3)]
    plan = back.where("Y = 2020 and M = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Y" in plan
    assert len(back.where("Y = 2020 and M = 3").inputFiles()) >= 1
