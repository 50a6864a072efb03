"""Joins on keys of which some may be hot.

A key is hot when more rows share it than one task should read. Its rows are dealt to salts, and the
other side's rows of that key, and of no other, are repeated once per salt. Nothing is dropped, and
keys that are not hot keep the plain join's plan: salt 0 and no repetition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

SALT = "_salt"
#: Hot keys that are sent to every task; with more, they are joined like any other table.
BROADCAST_KEYS = 100_000


class HotKeys:
    """The keys that more than ``rows_per_salt`` rows share, with their number of salts.

    Rows are counted with partial aggregation, so a hot key reaches the shuffle as one row a task.
    The table (at most rows / ``rows_per_salt`` keys) is written to the checkpoint folder, counted there,
    and broadcast only up to ``BROADCAST_KEYS`` keys.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], rows_per_salt: int):
        if rows_per_salt < 1:
            raise ValueError("rows_per_salt must be positive")
        self.keys = list(keys)
        counts = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_salt)
        self.table = cut_lineage(counts.select(*self.keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")))
        self.count = self.table.count()

    def _with_salts(self, df: DataFrame) -> DataFrame:
        hot = F.broadcast(self.table) if self.count <= BROADCAST_KEYS else self.table
        return df.join(hot, self.keys, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    def dealt(self, rows: DataFrame, by: Sequence[str | Column]) -> DataFrame:
        """Add ``_salt``: rows of a hot key are dealt by the hash of ``by`` (which should tell its rows apart)."""
        if not self.count:
            return rows.withColumn(SALT, F.lit(0))
        return self._with_salts(rows).withColumn(SALT, F.pmod(F.xxhash64(*by), F.col("_salts").cast("long")).cast("int")).drop("_salts")

    def repeated(self, other: DataFrame) -> DataFrame:
        """Add ``_salt``: a row of a hot key comes once per salt, any other once with 0."""
        if not self.count:
            return other.withColumn(SALT, F.lit(0))
        return self._with_salts(other).withColumn(SALT, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    def join(self, rows: DataFrame, other: DataFrame, by: Sequence[str | Column]) -> DataFrame:
        """Inner join on the keys with the rows of hot keys spread over tasks."""
        if not self.count:
            return rows.join(other, self.keys)
        return self.dealt(rows, by).join(self.repeated(other), [*self.keys, SALT]).drop(SALT)
