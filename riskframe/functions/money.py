"""Money helpers: exact decimals from float intermediates.

A float amount becomes money by ``floor(x * 10^scale + 0.5)`` — IEEE multiply, add and floor are
exactly specified, so every engine and every partitioning yields the same units — and the units
are turned into a DECIMAL without any further rounding. Sums of the result are exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_money(x: Column, scale: int = 4, precision: int = 20) -> Column:
    units = F.floor(x.cast("double") * F.lit(float(10 ** scale)) + F.lit(0.5))
    step = F.lit(Decimal(1).scaleb(-scale))  # 10^-scale as DECIMAL(scale+1, scale)
    return (units.cast(f"decimal({precision + scale},0)") * step).cast(f"decimal({precision},{scale})")


def money_sql(expr: str, scale: int = 4, precision: int = 20) -> str:
    """The same conversion as SQL text."""
    step = f"CAST({Decimal(1).scaleb(-scale)} AS DECIMAL({scale + 1},{scale}))"
    return (f"CAST(CAST(floor(CAST({expr} AS DOUBLE) * {float(10 ** scale)!r} + 0.5) AS DECIMAL({precision + scale},0))"
            f" * {step} AS DECIMAL({precision},{scale}))")
