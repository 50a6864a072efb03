"""E9 as Column expressions: report-period bounds computed per row inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(year: Column, code: str, value: Column, accumulated: bool = False) -> Column:
    """First day of the MONTHLY / QUARTERLY / YEARLY period; Jan 1 when accumulated."""
    one = F.lit(1)
    if accumulated or code.upper() == "YEARLY":
        return F.make_date(year, one, one)
    if code.upper() == "MONTHLY":
        return F.make_date(year, value, one)
    if code.upper() == "QUARTERLY":
        return F.make_date(year, value * 3 - 2, one)
    raise ValueError(f"unknown report period code {code!r}")


def period_end(year: Column, code: str, value: Column) -> Column:
    """Last day of the period (month end, quarter end or Dec 31)."""
    one = F.lit(1)
    if code.upper() == "MONTHLY":
        return F.last_day(F.make_date(year, value, one))
    if code.upper() == "QUARTERLY":
        return F.last_day(F.make_date(year, value * 3, one))
    if code.upper() == "YEARLY":
        return F.make_date(year, F.lit(12), F.lit(31))
    raise ValueError(f"unknown report period code {code!r}")
