"""Distinct counts that parts of a table keep and that merge without reading the parts again.

A part's sketch (HyperLogLog, a few kilobytes a column whatever the part's size) is stored with its row count. When
a part arrives, only its own rows are read; the sketches of all parts are merged. Estimates
have a stated relative error, and a decision that lies within it is left to the exact count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sketch's registers: its size is 2 ** bits bytes at most, its relative error 1.04 / sqrt(2 ** bits).
SKETCH_BITS = 14
#: Multiples of the relative error that a decision keeps away from its limit.
CERTAIN = 4.0

SCHEMA = "PART string, COLUMN string, NUM_ROWS long, NUM_VALUES long, SKETCH binary"


def relative_error(bits: int = SKETCH_BITS) -> float:
    """Standard error of an estimate, as a share of the distinct count."""
    return 1.04 / math.sqrt(1 << bits)


def part_sketches(df: DataFrame, columns: Sequence[str], part: str | Column, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per part and column: rows, non-null values and the sketch of the values as text. ``part`` is a name, or a
    column that names each row's part. One scan; a row a task, part and column is shuffled."""
    name = F.lit(part) if isinstance(part, str) else part
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    aggs = [x for i, v in enumerate(values) for x in (F.count(v).alias(f"_n{i}"), F.hll_sketch_agg(v, F.lit(bits)).alias(f"_s{i}"))]
    per_part = df.groupBy(name.alias("PART")).agg(F.count(F.lit(1)).alias("NUM_ROWS"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("COLUMN"), F.col(f"_n{i}").alias("NUM_VALUES"), F.col(f"_s{i}").alias("SKETCH")) for i, c in enumerate(columns)])
    return per_part.select("PART", "NUM_ROWS", F.inline(rows)).select("PART", "COLUMN", "NUM_ROWS", "NUM_VALUES", "SKETCH")


def merged(sketches: DataFrame) -> DataFrame:
    """Per column: NUM_ROWS, NUM_VALUES and DISTINCT_ESTIMATE over all parts. A part that is stored twice (a rerun)
    counts once: its sketches are equal, so the larger row count stands for both."""
    once = sketches.groupBy("PART", "COLUMN").agg(F.max("NUM_ROWS").alias("NUM_ROWS"), F.max("NUM_VALUES").alias("NUM_VALUES"), F.hll_union_agg("SKETCH").alias("SKETCH"))
    return once.groupBy("COLUMN").agg(F.sum("NUM_ROWS").alias("NUM_ROWS"), F.sum("NUM_VALUES").alias("NUM_VALUES"),
                                      F.hll_sketch_estimate(F.hll_union_agg("SKETCH")).alias("DISTINCT_ESTIMATE"))


def categorical(sketches: DataFrame, ratio: float = 0.5, bits: int = SKETCH_BITS) -> DataFrame:
    """B7 from sketches: per column ``IS_CATEGORICAL`` (distinct / rows < ``ratio``), null where the estimate is too near
    the limit to tell; such columns are counted exactly (``ingest.low_cardinality``). No row, no category."""
    margin = CERTAIN * relative_error(bits)
    share = F.try_divide(F.col("DISTINCT_ESTIMATE").cast("double"), F.col("NUM_ROWS").cast("double"))
    return merged(sketches).withColumn("IS_CATEGORICAL", F.when(share.isNull(), F.lit(False)).when(share < ratio * (1 - margin), F.lit(True))
                                       .when(share >= ratio * (1 + margin), F.lit(False)))


def near_unique(sketches: DataFrame, key: str, bits: int = SKETCH_BITS) -> DataFrame:
    """C6 from sketches: one row: NUM_ROWS, DISTINCT_ESTIMATE and ``REPEATED``: true where far fewer values than rows are
    certain, null where only the exact count (``validate.duplicate_report``) can tell."""
    m = merged(sketches.where(F.col("COLUMN") == key))
    far = F.col("DISTINCT_ESTIMATE") < F.col("NUM_VALUES") * (1 - CERTAIN * relative_error(bits))
    return m.select("NUM_ROWS", "NUM_VALUES", "DISTINCT_ESTIMATE", F.when(far, F.lit(True)).alias("REPEATED"))
