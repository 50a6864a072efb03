"""Date orders from whole columns, and distinct counts from merged sketches."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from riskframe.operators import sketches
from riskframe.operators.dateorder import date_orders, read_dates, read_in_order


def test_order_comes_from_the_whole_column(spark):
    days = [date(2021, 1, 1) + timedelta(37 * i) for i in range(60)]
    rows = [(d.strftime("%d/%m/%Y"), d.strftime("%m/%d/%Y"), f"{d.day}.{d.month}.{d.year}", d.strftime("%m-%d-%Y %I:%M %p"), d.strftime("%Y/%m/%d"), d.strftime("%d %B %Y"), d) for d in days]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, want date")
    out = read_dates(df, list("abcdef")).collect()
    assert all(r[c] == r.want for r in out for c in "abcdef")
    orders = {(r.COLUMN, r.SEPARATOR): r for r in date_orders(df, list("abcdef")).collect()}
    assert {k: r.DATE_ORDER for k, r in orders.items()} == {("a", "/"): "DMY", ("b", "/"): "MDY", ("c", "."): "DMY", ("d", "-"): "MDY", ("e", "/"): "DMY", ("f", "name"): "DMY"}
    b = orders["b", "/"]
    assert (b.NUM_VALUES, b.DAY_FIRST, b.NO_DATE) == (60, 0, 0) and b.MONTH_FIRST + b.AMBIGUOUS == 60 == b.AMBIGUOUS + sum(d.day > 12 for d in days)


CASES = [
    ("3/4/2020", datetime(2020, 4, 3), datetime(2020, 3, 4)), ("13/4/2020", datetime(2020, 4, 13), datetime(2020, 4, 13)), ("4/13/2020", datetime(2020, 4, 13), datetime(2020, 4, 13)),
    ("31/2/2020", None, None), ("29/2/2020", datetime(2020, 2, 29), datetime(2020, 2, 29)), ("29/2/2021", None, None), ("0/4/2020", None, None), ("13/13/2020", None, None),
    ("2020-2-30", None, None), ("2020-02-03 04:05:06", datetime(2020, 2, 3, 4, 5, 6), datetime(2020, 2, 3, 4, 5, 6)), ("2020/1/2T23:59", datetime(2020, 1, 2, 23, 59), datetime(2020, 1, 2, 23, 59)),
    ("2020-1-2 24:00", None, None), ("1-2-2020 12:30 am", datetime(2020, 2, 1, 0, 30), datetime(2020, 1, 2, 0, 30)), ("1-2-2020 13:30 PM", None, None),
    (" 5 Mar 2020 ", datetime(2020, 3, 5), datetime(2020, 3, 5)), ("5 Foo 2020", None, None), ("1/2-2020", None, None), ("1/2/20", None, None), ("", None, None), (None, None, None),
    ("n/a", None, None), ("20200102", None, None), ("1/2/2020 extra", None, None), ("9999-12-31", datetime(9999, 12, 31), datetime(9999, 12, 31)), ("0000-1-1", None, None)]


def test_values(spark):
    rows = [(k, t, t) for k, (t, _, _) in enumerate(CASES)]
    out = read_in_order(spark.createDataFrame(rows, "k int, d string, m string"), ["d", "m"], {"m": ["/", "-", "."]}, as_date=False).orderBy("k").collect()
    assert [(r.d, r.m) for r in out] == [c[1:] for c in CASES]


def test_ties_and_empty_columns(spark):
    df = spark.createDataFrame([("13/1/2020", None), ("1/13/2020", ""), ("2/3/2020", "NaT")], "v string, w string")
    assert [(r.DATE_ORDER, r.DAY_FIRST, r.MONTH_FIRST, r.AMBIGUOUS) for r in date_orders(df, ["v", "w"]).collect()] == [("DMY", 1, 1, 1)]
    assert [r.v for r in read_dates(df, ["v", "w"]).collect()] == [date(2020, 1, 13), date(2020, 1, 13), date(2020, 3, 2)]
    assert date_orders(df.limit(0), ["v"]).count() == 0


def test_merged_sketches_keep_within_the_error_and_parts_are_read_once(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(40_000), f"c{i % 5}", f"p{i % 7}") for i in range(100_000)]
    df = spark.createDataFrame(rows, "id long, many long, few string, part string").cache()
    path = str(tmp_path / "s")
    columns = ["id", "many", "few"]
    for part in [f"p{k}" for k in range(7)]:
        sketches.part_sketches(df.where(F.col("part") == part), columns, part).write.mode("append").parquet(path)
    sketches.part_sketches(df.where("part = 'p3'"), columns, "p3").write.mode("append").parquet(path)  # the same part again
    kept = spark.read.schema(sketches.SCHEMA).parquet(path)
    got = {r.COLUMN: r for r in sketches.merged(kept).collect()}
    exact = {"id": 100_000, "many": len({r[1] for r in rows}), "few": 5}
    assert all(abs(got[c].DISTINCT_ESTIMATE / n - 1) <= 4 * sketches.relative_error() and got[c].NUM_ROWS == 100_000 for c, n in exact.items())
    verdict = {r.COLUMN: r.IS_CATEGORICAL for r in sketches.categorical(kept).collect()}
    assert verdict == {"id": False, "many": True, "few": True}
    near = {r.COLUMN: r.IS_CATEGORICAL for r in sketches.categorical(kept, ratio=exact["many"] / 100_000).collect()}
    assert near["many"] is None
    assert sketches.near_unique(kept, "many").first().REPEATED is True and sketches.near_unique(kept, "id").first().REPEATED is None
    assert kept.agg(F.max(F.length("SKETCH"))).first()[0] < 40_000
    df.unpersist()


def test_sketches_of_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, b int")
    got = {r.COLUMN: r for r in sketches.categorical(sketches.part_sketches(df, ["a", "b"], "p")).collect()}
    assert (got["a"].NUM_VALUES, got["a"].DISTINCT_ESTIMATE, got["a"].IS_CATEGORICAL, got["b"].IS_CATEGORICAL) == (0, 0, True, False)
    assert sketches.merged(sketches.part_sketches(df.limit(0), ["a"], F.lit("p"))).count() == 0


def test_steps_are_compiled_once_whatever_the_columns(spark):
    import datetime

    from riskframe.operators import dateorder
    steps = lambda n: dateorder._values([f"c{i}" for i in range(n)], {}, dateorder._RAW, dateorder._TOKENS, dateorder._KIND)
    assert steps(13).count("transform(") == steps(1).count("transform(") == 3
    names = ["a", "it's"]
    df = spark.createDataFrame([("13/1/2020", "1.31.2021"), ("2/3/2020 4:05 PM", "2.3.2021"), ("2 March 2020", None), ("", "x")], names)
    day = datetime.date
    got = [tuple(r) for r in read_dates(df, names).collect()]
    assert got == [(day(2020, 1, 13), day(2021, 1, 31)), (day(2020, 3, 2), day(2021, 2, 3)), (day(2020, 3, 2), None), (None, None)]
