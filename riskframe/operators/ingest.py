"""Mapping, typing and cleaning of imported extracts.

Whole-column decisions (which date format, which integer width, which columns are numeric or
empty) are taken from one aggregate over the table, then applied as one projection — two passes,
no per-column jobs, no data on the driver beyond the one-row decision.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.numeric import to_number
from riskframe.functions.text import coverage_prefix
from riskframe.operators.validate import DATE_FORMATS, ColumnSetting

# Import date formats tried in order (strptime spelling → Spark pattern).
IMPORT_DATE_FORMATS = [("%d/%m/%Y %H:%M", "d/M/yyyy H:m"), ("%d/%m/%Y", "d/M/yyyy"),
                       ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"), ("%Y-%m-%d", "yyyy-M-d")]
# After them, every other format that validation accepts, so a validated date is never lost.
ALL_DATE_FORMATS = [*IMPORT_DATE_FORMATS, *[f for f in DATE_FORMATS if f not in IMPORT_DATE_FORMATS]]
NULL_TEXTS = ("", "nan", "NaN", "None", "NaT")


def check_mapping(settings: Sequence[ColumnSetting]) -> None:
    """B2: an empty mapping or an import name used twice is an error."""
    if not settings:
        raise ValueError("empty column mapping")
    seen = set()
    for s in settings:
        if s.import_name in seen:
            raise ValueError(f"import name {s.import_name!r} mapped twice")
        seen.add(s.import_name)


def map_columns(df: DataFrame, settings: Sequence[ColumnSetting]) -> DataFrame:
    """B1: rename business → standard names and keep the mapped columns, in file order."""
    check_mapping(settings)
    m = {s.import_name: s.standard_name for s in settings}
    return df.select(*[F.col(f"`{c}`").alias(m[c]) for c in df.columns if c in m])


def _blank(v: Column) -> Column:
    return v.isNull() | F.trim(v).isin(*NULL_TEXTS)


def date_format_choice(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """B3 decision: per column the first import format that parses every non-blank value."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.trim(F.col(f"`{c}`").cast("string"))
        for j, (_, p) in enumerate(ALL_DATE_FORMATS):
            aggs.append(F.count_if(~_blank(v) & F.try_to_timestamp(v, F.lit(p)).isNull()).alias(f"_{i}_{j}"))
    if not aggs:
        return {}
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        out[c] = next((p for j, (_, p) in enumerate(ALL_DATE_FORMATS) if r[f"_{i}_{j}"] == 0), None)
    return out


def to_date_multi(c: str, chosen: str | None) -> Column:
    """B3 apply: the chosen whole-column format, else per value the first format that parses."""
    v = F.trim(F.col(f"`{c}`").cast("string"))
    if chosen is not None:
        return F.to_date(F.try_to_timestamp(v, F.lit(chosen)))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for _, p in ALL_DATE_FORMATS]))


def convert_types(df: DataFrame, settings: Sequence[ColumnSetting], integer_null: int | None = None,
                  unknown_text: str = "Unknown") -> DataFrame:
    """Date (multi-format), Integer/Double (numeric coerce; optional null fill for
    integers, the reference's −999), Text (null → ``Unknown``; fixes the reference's ``"nan"``),
    COVERAGE_ID zero prefix. Types are matched case-insensitively."""
    types = {s.standard_name: s.data_type.lower() for s in settings if s.standard_name in df.columns}
    dates = [c for c, t in types.items() if t == "date"]
    chosen = date_format_choice(df, dates)
    cols = {}
    for c, t in types.items():
        if t == "date":
            cols[c] = to_date_multi(c, chosen.get(c))
        elif t in ("double", "integer"):
            x = to_number(F.col(f"`{c}`"))
            if t == "integer":
                x = x.try_cast("long")  # beyond 64 bits: null
                if integer_null is not None:
                    x = F.coalesce(x, F.lit(integer_null).cast("long"))
            cols[c] = x
        elif t == "text":
            cols[c] = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(unknown_text))
    out = df.withColumns(cols)
    if "COVERAGE_ID" in out.columns:
        out = out.withColumn("COVERAGE_ID", coverage_prefix(F.col("COVERAGE_ID")))
    return out


_WIDTHS = [("tinyint", -(2 ** 7), 2 ** 7 - 1), ("smallint", -(2 ** 15), 2 ** 15 - 1),
           ("int", -(2 ** 31), 2 ** 31 - 1), ("bigint", -(2 ** 63), 2 ** 63 - 1)]


def integer_widths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B5 decision: per integer column its min, max and the narrowest signed type holding both
    (Spark has no unsigned types; the reference's uint8 range 0..255 needs smallint here)."""
    agg = df.agg(*[F.min(c).cast("long").alias(f"_lo{i}") for i, c in enumerate(columns)],
                 *[F.max(c).cast("long").alias(f"_hi{i}") for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        t = None
        for name, a, b in _WIDTHS:
            cond = (lo >= a) & (hi <= b)
            t = F.when(cond, F.lit(name)) if t is None else t.when(cond, F.lit(name))
        rows.append(F.struct(F.lit(c).alias("COLUMN"), lo.alias("MIN_VALUE"), hi.alias("MAX_VALUE"),
                             F.coalesce(t.otherwise(F.lit("bigint")), F.lit("tinyint")).alias("NARROW_TYPE")))
    return agg.select(F.inline(F.array(*rows)))


def narrow_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B5 apply: cast each column to its narrowest type (one small aggregate, then a projection)."""
    widths = {r["COLUMN"]: r["NARROW_TYPE"] for r in integer_widths(df, columns).collect()}
    return df.withColumns({c: F.col(c).cast(t) for c, t in widths.items()})


def low_cardinality(df: DataFrame, columns: Sequence[str], ratio: float = 0.5) -> DataFrame:
    """Distinct / rows < ratio marks a categorical (dictionary-friendly) text column."""
    out = None
    for c in columns:  # each column is counted alone: no row is expanded
        values = df.groupBy(F.col(f"`{c}`").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        one = values.agg(F.count("_v").alias("DISTINCT_VALUES"), F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("NUM_ROWS"))
        one = one.select(F.lit(c).alias("COLUMN"), "DISTINCT_VALUES", "NUM_ROWS",
                         (F.coalesce(F.try_divide(F.col("DISTINCT_VALUES").cast("double"), F.col("NUM_ROWS").cast("double")), F.lit(1.0))
                          < F.lit(ratio)).alias("IS_CATEGORICAL"))
        out = one if out is None else out.unionByName(one)
    return out


def clean_table(df: DataFrame, date_words: Sequence[str] = ("date", "time")) -> DataFrame:
    """Drop all-null rows and all-null columns; a text column becomes numeric when any value
    parses (the others become null); columns named like a date/time are parsed to timestamps."""
    df = df.na.drop(how="all")
    texts = [c for c, t in df.dtypes if t == "string"]
    agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_nn{i}") for i, c in enumerate(df.columns)],
                 *[F.count(to_number(F.col(f"`{c}`"))).alias(f"_num{i}") for i, c in enumerate(texts)]).first()
    keep = [c for i, c in enumerate(df.columns) if agg[f"_nn{i}"] > 0]
    numeric = {c for i, c in enumerate(texts) if agg[f"_num{i}"] > 0}
    cols = []
    for c in keep:
        e = F.col(f"`{c}`")
        if c in numeric:
            e = to_number(e)
        if any(w in c.lower() for w in date_words):
            v = e.cast("string")
            e = (F.coalesce(*[F.try_to_timestamp(v, F.lit(p)) for _, p in ALL_DATE_FORMATS]) if c not in numeric
                 else F.lit(None).cast("timestamp")).cast("timestamp_ntz")
        cols.append(e.alias(c))
    return df.select(*cols)


def snapshot_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (with multiplicity) only in the new or only in the old snapshot, tagged by side.
    Column sets must agree (else everything differs; compare schemas first)."""
    cols = new.columns
    both = new.withColumn("_n", F.lit(1)).unionByName(old.select(*cols).withColumn("_n", F.lit(-1)))
    # one pass over each side: the sign of the count says where a row is in excess, and how often
    left = both.groupBy(*cols).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    return left.withColumn("SIDE", F.when(F.col("_n") > 0, F.lit("new")).otherwise(F.lit("old"))) \
        .withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n")))).select(*cols, "SIDE")


def snapshot_changed(new: DataFrame, old: DataFrame) -> bool:
    """A9 decision: schema differs, or any row differs (order-insensitive)."""
    if new.dtypes != old.dtypes:
        return True
    return not snapshot_diff(new, old).isEmpty()


def union_parts(parts: Mapping[str, DataFrame], source_col: str = "SOURCE") -> DataFrame:
    """Union by name of the parts sorted by name, missing columns as null, tagged by part."""
    out = None
    for name in sorted(parts):
        p = parts[name].withColumn(source_col, F.lit(name))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("no data parts")
    return out
