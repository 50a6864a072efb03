"""The order of day, month and year of date texts, from all values of a column at once.

Every value is split once into its numbers (or its month's name), separator and time. A year shows by its
four digits. Of the two other numbers, one above 12 must be the day, and such values say in which
order the column writes its dates; values in which both may be the month follow that order.
Two scans whatever the number of formats: one to count the evidence, one to read the dates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators of numeric dates, and the names of months in dates that name them.
SEPARATORS = ("-", "/", ".")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_TIME = r"(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?: ?([AaPp][Mm]))?)?"
_NUMERIC = r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})" + _TIME + "$"
_NAMED = r"^(\d{1,2})[ -]([A-Za-z]{3,9})[ -](\d{4})" + _TIME + "$"
BLANK = ("", "nan", "NaN", "None", "NaT")


def _groups(pattern: str, n: int) -> str:
    """The groups of a pattern as an array (empty texts for what is left out); one element where it does not match."""
    pattern = pattern.replace("{", "{{").replace("}", "}}")
    return f"split(regexp_replace({{v}}, r'{pattern}', '" + "\u0001".join(f"${k}" for k in range(1, n + 1)) + "'), '\u0001')"


# The steps below are SQL texts over the fields of the step before (named by their keys).
#: ``n``: the groups of a numeric date, ``m``: of one that names its month; and whether the text is blank.
_RAW = {"blank": "{v} IS NULL OR {v} IN (" + ", ".join(f"'{x}'" for x in BLANK) + ")", "n": _groups(_NUMERIC, 8), "m": _groups(_NAMED, 7)}

_MONTH = "map(" + ", ".join(f"'{key}', {i + 1}" for i, name in enumerate(MONTHS) for key in dict.fromkeys((name, name[:3]))) + ")"


def _either(i: int, j: int) -> str:
    """Group ``i`` of a numeric date or ``j`` of a named one."""
    return f"CASE WHEN size({{n}}) = 8 THEN {{n}}[{i - 1}] WHEN size({{m}}) = 7 THEN {{m}}[{j - 1}] END"


def _number(group: str) -> str:
    """A group of digits as a number, null where it was left out (a cast that fails costs far more than the test)."""
    return f"TRY_CAST(nullif({group}, '') AS INT)"


#: Separator (``name`` for a named month, ``?`` for no date, null for a blank), the three numbers, the lengths of the outer ones,
#: whether there is a time, and hour, half of the day, minute, second.
_TOKENS = {
    "sep": "CASE WHEN NOT {blank} THEN CASE WHEN size({n}) = 8 THEN {n}[1] WHEN size({m}) = 7 THEN 'name' ELSE '?' END END",
    "a": _number(_either(1, 1)), "c": _number(_either(4, 3)),
    "b": f"CASE WHEN size({{n}}) = 8 THEN {_number('{n}[2]')} WHEN size({{m}}) = 7 THEN element_at({_MONTH}, lower({{m}}[1])) END",
    "len_a": "CASE WHEN size({n}) = 8 THEN length({n}[0]) END", "len_c": "CASE WHEN size({n}) = 8 THEN length({n}[3]) END",
    "timed": f"{_either(5, 4)} != ''", "hour": _number(_either(5, 4)), "half": f"upper({_either(8, 7)})",
    "mi": _number(_either(6, 5)), "s": f"coalesce({_number(_either(7, 6))}, 0)"}

#: ``DAY`` or ``MONTH``: which comes first for certain; ``EITHER``: both may; ``YEAR``, ``NAME``: no question; null: no date.
_KIND = {"kind": """CASE WHEN {sep} = 'name' THEN CASE WHEN {b} IS NOT NULL THEN 'NAME' END WHEN {len_a} = 4 AND {len_c} <= 2 THEN 'YEAR'
  WHEN {len_c} = 4 AND {len_a} <= 2 THEN CASE WHEN {a} > 12 AND {b} BETWEEN 1 AND 12 THEN 'DAY' WHEN {b} > 12 AND {a} BETWEEN 1 AND 12 THEN 'MONTH'
    WHEN {a} BETWEEN 1 AND 12 AND {b} BETWEEN 1 AND 12 THEN 'EITHER' END END""",
         "h": "CASE WHEN {half} = '' THEN {hour} WHEN {hour} BETWEEN 1 AND 12 THEN {hour} % 12 + IF({half} = 'PM', 12, 0) ELSE -1 END"}

#: Whether the month comes first: for certain, or after one of the column's separators that write it so.
_SWAP = {"swap": "{kind} = 'MONTH' OR {kind} = 'EITHER' AND array_contains({after}, {sep})"}

#: Year, month and day.
_ORDERED = {"y": "CASE WHEN {kind} = 'YEAR' THEN {a} WHEN {kind} IS NOT NULL THEN {c} END", "mo": "CASE WHEN {kind} = 'YEAR' OR NOT ({swap}) THEN {b} ELSE {a} END",
            "d": "CASE WHEN {kind} = 'YEAR' THEN {c} WHEN {swap} THEN {b} ELSE {a} END"}
_FIRST = {"first": "CASE WHEN {mo} BETWEEN 1 AND 12 AND {y} >= 1 THEN make_date({y}, {mo}, 1) END"}
_MOMENT = """CASE WHEN (NOT {timed} OR {h} BETWEEN 0 AND 23 AND {mi} <= 59 AND {s} <= 59) AND {d} BETWEEN 1 AND dayofmonth(last_day({first}))
  THEN CAST(date_add({first}, {d} - 1) AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, 0, CAST(CASE WHEN {timed} THEN {h} * 3600 + {mi} * 60 + {s} ELSE 0 END AS DECIMAL(18, 6))) END"""


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _values(columns: Sequence[str], month_first: Mapping[str, Sequence[str]], *steps: Mapping[str, str], keep: Sequence[str] = ()) -> str:
    """The steps over an array with one value a column, each a struct with the fields that later steps use, or that ``keep`` names.

    Each step is one function over the array: its text is compiled once whatever the number of columns, and what
    it makes is kept, so no step is computed again for every use of it.
    """
    texts = lambda values: "CAST(array(" + ", ".join(f"'{x}'" for x in values) + ") AS ARRAY<STRING>)"
    out = "array(" + ", ".join(f"named_struct('column', {_quoted(c)}, 'v', trim(CAST(`{c}` AS STRING)), 'after', {texts(month_first.get(c, ()))})" for c in columns) + ")"
    known = ["column", "v", "after"]
    for k, group in enumerate(steps):
        names = {x: f"s{k}.{x}" for x in known}
        later = [text for step in steps[k + 1:] for text in step.values()]
        known = [x for x in known if x in keep or any(f"{{{x}}}" in text for text in later)]
        fields = [*[f"'{x}', s{k}.{x}" for x in known], *[f"'{x}', {text.format(**names)}" for x, text in group.items()]]
        out = f"transform({out}, s{k} -> named_struct({', '.join(fields)}))"
        known = [*known, *group]
    return out


def date_orders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column and separator that occurs in it: NUM_VALUES, DAY_FIRST and MONTH_FIRST (values that allow one
    order only), AMBIGUOUS, NO_DATE and DATE_ORDER: ``DMY`` or ``MDY`` by the more frequent evidence,
    ``DMY`` if there is none or as much of either. Blanks are no values. One aggregate, one row a task and group."""
    values = _values(columns, {}, _RAW, _TOKENS, _KIND, keep=("column", "sep", "kind"))
    pairs = F.expr(f"transform({values}, s -> named_struct('COLUMN', s.column, 'SEPARATOR', s.sep, '_kind', s.kind))")
    kind = F.col("_kind")
    return df.select(F.inline(pairs)).where("SEPARATOR is not null").groupBy("COLUMN", "SEPARATOR").agg(
        F.count(F.lit(1)).alias("NUM_VALUES"), F.count_if(kind == "DAY").alias("DAY_FIRST"), F.count_if(kind == "MONTH").alias("MONTH_FIRST"),
        F.count_if(kind == "EITHER").alias("AMBIGUOUS"), F.count_if(kind.isNull()).alias("NO_DATE")) \
        .withColumn("DATE_ORDER", F.when(F.col("MONTH_FIRST") > F.col("DAY_FIRST"), F.lit("MDY")).otherwise(F.lit("DMY")))


def month_first(orders: DataFrame) -> dict[str, list[str]]:
    """The separators of each column that write the month first (a row per column and separator at most)."""
    out: dict[str, list[str]] = {}
    for r in orders.where("DATE_ORDER = 'MDY'").select("COLUMN", "SEPARATOR").collect():
        out.setdefault(r["COLUMN"], []).append(r["SEPARATOR"])
    return out


def read_in_order(df: DataFrame, columns: Sequence[str], month_first: Mapping[str, Sequence[str]], as_date: bool = True) -> DataFrame:
    """The columns as dates (or timestamps without a zone). A value that allows one order only is read in it; others have the
    month first after a column's separators in ``month_first``, and the day first after all others."""
    kind = "DATE" if as_date else "TIMESTAMP_NTZ"
    values = _values(columns, month_first, _RAW, _TOKENS, _KIND, _SWAP, _ORDERED, _FIRST, {"moment": _MOMENT}, keep=("moment",))
    dates = F.expr(f"transform({values}, s -> CAST(s.moment AS {kind}))")
    return df.withColumn("__dates", dates).withColumns({c: F.col("__dates")[i] for i, c in enumerate(columns)}).select(*[F.col(f"`{c}`") for c in df.columns])


def read_dates(df: DataFrame, columns: Sequence[str], as_date: bool = True) -> DataFrame:
    """The columns as dates (or timestamps without a zone), in the order that all their values together show."""
    return read_in_order(df, columns, month_first(date_orders(df, columns)), as_date)
