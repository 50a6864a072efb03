"""Readers for extract files, data parts, settings headers and templates.

Re-aimed: the reference decodes workbooks in memory on one machine; here an extract is a folder
of CSV or Parquet parts read by Spark. Workbook decoding itself is not built (see README).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Texts that are data and no column name (decimal numbers, dates and timestamps).
_DATA_VALUE = re.compile(r"-?\d*\.\d+$|\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$")


def mapping_from_header(df: DataFrame) -> dict[str, str]:
    """A3: ``{standard_name: business_name}`` from a two-header file read with the first header
    row as column names (the second header row is the first data row). Only that one row is
    read. Rejects a second row that is a decimal number or a timestamp (data, not names)."""
    first = df.limit(1).collect()
    if not first:
        raise ValueError("file has no second header row")
    row = first[0].asDict()
    for k, v in row.items():
        if v is not None and _DATA_VALUE.match(str(v).strip()):
            raise ValueError(f"second header row holds data in column {k!r}: not a header")
    return {k: ("" if v is None else str(v)) for k, v in row.items()}


def read_two_header(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, dict[str, str]]:
    """A1: read a file whose first row holds standard names and second row business names.
    Returns the data (second header row removed; all columns as text) and the header mapping."""
    df = spark.read.option("header", True).option("inferSchema", False).format(fmt).load(path)
    mapping = mapping_from_header(df)
    is_header = None
    for c, v in mapping.items():
        e = F.col(f"`{c}`").eqNullSafe(F.lit(v if v != "" else None))
        is_header = e if is_header is None else (is_header & e)
    return df.filter(~is_header), mapping


def union_data_parts(spark: SparkSession, paths: Sequence[str], prefix: str = "DATA", fmt: str = "parquet") -> DataFrame:
    """A2: the parts whose file name starts with ``prefix`` (in name order), unioned by column
    name with missing columns as null; raises if there is none."""
    names = sorted(p for p in paths if p.rstrip("/").rsplit("/", 1)[-1].startswith(prefix))
    if not names:
        raise ValueError(f"no data part starting with {prefix!r}")
    out = None
    for p in names:
        part = spark.read.format(fmt).load(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _part_columns(spark: SparkSession, paths: Sequence[str], fmt: str) -> list[tuple[str, list[str]]]:
    """The qualified address and the column names of each part. Spark reads one footer (or header) a part in a
    task of its own; several parts are asked for at once."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def one(path: str) -> tuple[str, list[str]]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
        return where.getFileSystem(conf).makeQualified(where).toUri().toString(), spark.read.format(fmt).load(path).columns

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(one, paths))


def profile_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """A4: per file of every part: FILE_NAME, NUM_ROWS, HAS_DATA (more than one row),
    NUM_COLUMNS and FIRST_COLUMNS (the first ten names of the part).

    One scan over all parts, whatever their number and schemas: it reads no data column and is
    grouped by the file's address, with a row a task and file shuffled. The names are a small table that
    is joined by the part that a file lies under.
    """
    if not paths:
        raise ValueError("no parts to profile")
    parts = _part_columns(spark, paths, fmt)
    names = spark.createDataFrame([(p, len(c), ",".join(c[:10])) for p, c in parts], "_part string, NUM_COLUMNS long, FIRST_COLUMNS string")
    rows = spark.read.format(fmt).schema("_none string").load(list(paths)).select("_metadata.file_path", "_metadata.file_name")
    files = rows.groupBy("file_path", F.col("file_name").alias("FILE_NAME")).agg(F.count(F.lit(1)).alias("NUM_ROWS"))
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  file:/x and file:///x are one address
    steps = F.split(plain("file_path"), "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))
    return files.withColumn("_part", above).join(names.withColumn("_part", plain("_part")), "_part") \
        .select("FILE_NAME", "NUM_ROWS", (F.col("NUM_ROWS") > 1).alias("HAS_DATA"), "NUM_COLUMNS", "FIRST_COLUMNS")


def preview_parts(spark: SparkSession, paths: Sequence[str], n: int = 3) -> DataFrame:
    """A4/I4 preview: the first ``n`` rows of every Parquet part (FILE_NAME, ROW_INDEX, ROW_JSON
    with the part's own columns). Uses the row position within the file, so it is a filter on
    each task's input, never a window over a whole (possibly huge) file; the limit is the
    feature."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    data = [c for c in df.columns]
    return (df.filter(F.col("_metadata.row_index") < n)
              .select(F.col("_metadata.file_name").alias("FILE_NAME"), F.col("_metadata.row_index").alias("ROW_INDEX"),
                      F.to_json(F.struct(*[F.col(f"`{c}`") for c in data])).alias("ROW_JSON")))


def read_table(spark: SparkSession, path: str, columns: Sequence[str], extra_codes: Sequence[str] = ()) -> DataFrame:
    """A5: Parquet scan of the needed columns only, plus NUM_CLAIMS_<code> / CLAIM_PMT_<code>
    for each additional coverage code (the column list reaches the scan)."""
    cols = list(columns) + [f"{p}_{c}" for c in extra_codes for p in ("NUM_CLAIMS", "CLAIM_PMT")]
    return spark.read.parquet(path).select(*cols)


def load_template(template: DataFrame, type_: str | None = None, order_col: str = "lineCode") -> DataFrame:
    """Template lines of one company type ordered by line code (filter pushed to the source)."""
    t = template if type_ is None else template.filter(F.col("type") == type_)
    return t.orderBy(F.col(order_col).try_cast("double").asc_nulls_last(), F.col(order_col))
