import pytest
from pyspark.sql import functions as F

from riskframe.functions.text import coverage_prefix, standardize_reg_no


@pytest.mark.parametrize("raw,expected", [
    ("30A-123.45", "30A12345"), ("51 L D 12345", "51LD12345"), ("５１Ａ１２３４５", "51A12345"),
    ("12345NG01", "12345NG01"), ("   ", "ERROR_REG_NO"), (None, "ERROR_REG_NO"), ("51a-123.45", "51A12345"),
    ("??", "ERROR_REG_NO"), ("51A—12345", "51A12345"), ("1234567", "ERROR_REG_NO"),
])
def test_reg_no(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(standardize_reg_no(F.col("r"))).first()[0] == expected


def test_coverage_prefix(spark):
    df = spark.createDataFrame([("0",), ("01",), ("1",), ("010",)], "c string")
    assert [r[0] for r in df.select(coverage_prefix(F.col("c"))).collect()] == ["00", "01", "01", "010"]


def test_folding_equals_the_library_on_every_character(spark):
    """Plates that hold any one non-ASCII character get the verdict of Python's own NFKC."""
    import unicodedata

    from riskframe.functions.text import nfkc_fold, nfkc_table
    from riskframe.plans.oracle import plate_by_library
    table = nfkc_table()
    assert sum(len(v) > 1 for v in table.values()) > 50 and all(unicodedata.normalize("NFKC", k) == v for k, v in table.items())
    forms = sorted(table)
    df = spark.createDataFrame([(c, f"30{c}123", f"{c}A12{c}3") for c in forms], "c string, p string, q string")
    for r in df.select("c", "p", "q", nfkc_fold(F.col("p")).alias("fold"), standardize_reg_no(F.col("p")).alias("x"), standardize_reg_no(F.col("q")).alias("y")).collect():
        assert r.fold == unicodedata.normalize("NFKC", r.p)
        assert (r.x, r.y) == (plate_by_library(r.p), plate_by_library(r.q)), repr(r.c)
