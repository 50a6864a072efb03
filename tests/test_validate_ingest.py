import datetime as dt

from riskframe.operators import ingest as I
from riskframe.operators import validate as V


def test_validate_checks(spark):
    df = spark.createDataFrame([("1", "2019-01-02, 2019-02-03", "1.5", "Unknown A", "k"),
                                ("1", "2019-03-04", "", "b", None),
                                ("2", None, "x", "c", None)], "ID string, D string, N string, T string, E string")
    settings = [V.ColumnSetting("CLAIM_ID", "ID", "Text", False), V.ColumnSetting("DT", "D", "Date"),
                V.ColumnSetting("NUM", "N", "Double"), V.ColumnSetting("TXT", "T", "Text", False),
                V.ColumnSetting("EMPTY", "E", "Text", False), V.ColumnSetting("GONE", "G", "Text")]
    rep = {r.COLUMN: r for r in V.validate(df, settings, V.Profile.of("GLM_CLM")).collect()}
    assert rep["CLAIM_ID"].DUP_OK is False
    assert rep["DT"].TYPE_OK is True                   # comma-separated dates, one format for all
    assert rep["NUM"].TYPE_OK is False                 # "x" is not numeric ("" is ignored)
    assert rep["TXT"].UNKNOWN_COUNT == 1 and rep["TXT"].UNKNOWN_OK is False
    assert rep["EMPTY"].MISSING_COUNT == 2 and rep["EMPTY"].MISSING_OK is False
    assert rep["GONE"].CHECK == "Column not found"
    st = V.validation_status(V.validate(df, settings, V.Profile.of("GLM_CLM")), V.Profile.of("GLM_CLM")).first()
    assert st.STATUS is False and st.FIRST_FAILURE == "type"


def test_duplicate_pair(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), ("a", None), ("b", "1")], "P string, C string")
    r = V.duplicate_report(df, [("P", "C")]).first()
    assert (r.NUM_ROWS, r.DISTINCT_KEYS, r.DUPLICATE_ROWS, r.DUP_OK) == (5, 3, 2, False)


def test_date_format_choice(spark):
    df = spark.createDataFrame([("1/2/2019",), ("01/02/2019",), ("nan",)], "d string")
    assert I.date_format_choice(df, ["d"]) == {"d": "d/M/yyyy"}
    df2 = spark.createDataFrame([("01/02/2019 01:15",)], "d string")
    assert I.date_format_choice(df2, ["d"]) == {"d": "d/M/yyyy H:m"}
    mixed = spark.createDataFrame([("31/12/2019",), ("2019-12-31",)], "d string")
    out = [r[0] for r in mixed.select(I.to_date_multi("d", I.date_format_choice(mixed, ["d"])["d"])).collect()]
    assert out == [dt.date(2019, 12, 31)] * 2


def test_clean_and_snapshot(spark):
    df = spark.createDataFrame([("1", None, "2019-01-01"), (None, None, None), ("x", None, "bad")],
                               "a string, b string, event_date string")
    c = I.clean_table(df)
    assert c.columns == ["a", "event_date"] and c.count() == 2
    assert [r.a for r in c.collect()] == [1.0, None]
    new = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    old = spark.createDataFrame([(2,), (1,)], "k int")
    assert [tuple(r) for r in I.snapshot_diff(new, old).collect()] == [(1, "new")]
    assert I.snapshot_changed(new, old) and not I.snapshot_changed(old, old.orderBy("k"))


def test_mapping_guard():
    import pytest
    with pytest.raises(ValueError):
        I.check_mapping([V.ColumnSetting("A", "x", "Text"), V.ColumnSetting("B", "x", "Text")])


def test_mof_composite_duplicate_reported_on_both_columns(spark):
    df = spark.createDataFrame([("p1", "c1", "Unknown"), ("p1", "c1", "x"), ("p2", "c1", "y")],
                               "POLICY_ID string, CERTIFICATE_ID string, CH string")
    settings = [V.ColumnSetting("POLICY_ID", "POLICY_ID", "Text", False), V.ColumnSetting("CERTIFICATE_ID", "CERTIFICATE_ID", "Text"),
                V.ColumnSetting("CHANNEL", "CH", "Text")]
    p = V.Profile.of("MOF", "GWP_PNT_11")
    rep = {r.COLUMN: r for r in V.validate(df, settings, p).collect()}
    assert rep["POLICY_ID"].DUP_OK is False and rep["CERTIFICATE_ID"].DUP_OK is False and rep["CHANNEL"].DUP_OK is True
    st = V.validation_status(V.validate(df, settings, p), p).first()
    # unknown counts in MOF status, duplicate comes after it in the order of families
    assert st.FIRST_FAILURE == "unknown" and st.MESSAGE == "Data validation failed! Due to unknown: CHANNEL"


def test_texts_that_no_format_parses_do_not_reach_the_parser(spark):
    """The look of a text turns nearly all away that do not parse, and none that does."""
    from pyspark.sql import functions as F

    from riskframe.operators.validate import DATE_FORMATS, _looks, _parses
    texts = ["2019-12-31", "31-12-2019", "12-31-2019", "31/12/2019", "12/31/2019", "2019/1/2", "1.2.2019", "31.12.2019", "12.31.2019", "7 May 2020", "07 may 2020", "7 January 2020",
             "2019-1-2 3:04:05", "2/1/2019 23:59:59", "1-2-2019 9:30 PM", "1-2-2019 09:30 am", "0012-1-1", "012-001-2019", "+12019-1-1", "-2019-1-1", "12019-1-1", "n/a", "13/13/2019",
             "2019-00-10", "2019-1-32", "19-1-1", "", " ", "2019-12-31x", "x2019-12-31", "2019-12-31 24:00:00", "1-2-2019 13:00 PM", "٣-1-2019", "2019-02-30"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for _, pattern in DATE_FORMATS:
        parses, looks = F.try_to_timestamp("v", F.lit(pattern)).isNotNull(), F.col("v").rlike(_looks(pattern))
        rows = df.select("v", parses.alias("p"), looks.alias("l"), _parses(pattern)(F.col("v")).alias("both")).collect()
        assert [r.v for r in rows if r.p != r.both] == []
        assert sum(r.l and not r.p for r in rows) <= 5 and any(r.p for r in rows)
    plan = df.agg(*[F.bool_and(_parses(p)(F.col("v"))) for _, p in DATE_FORMATS])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("RLIKE") >= len(DATE_FORMATS)
