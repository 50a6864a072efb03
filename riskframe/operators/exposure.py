"""Split policies into calendar-year exposure rows with earned premium.

Per policy row the calendar years ``year(START) .. year(EXPIRY)`` (only ``year(EXPIRY)`` when
START > EXPIRY) become one row each:

======================  =========  ========  ==================
case                    START_SEQ  END_SEQ   EXPOSURE_DAY
======================  =========  ========  ==================
y = year(START)         START      y-12-31   END - START + 1
year(START) < y < ye    y-01-01    y-12-31   END - START + 1
y = year(EXPIRY)        y-01-01    EXPIRY    END - START (no +1)
======================  =========  ========  ==================

``EXPOSURE_YEAR`` = days / days-in-year, except for one-year spans ending in a leap year
(days/366 when EXPIRY is after Feb 28, else days/365, for both rows). ``TOTAL_EXPOSURE`` is the
sum over the policy's rows and ``EXPOSURE_PREM = GWP * EXPOSURE_YEAR / TOTAL_EXPOSURE``.

Design: the total is computed inside the row in closed form (first-year share + one per full
middle year + last-year share), then ``posexplode(sequence(year(START), year(EXPIRY)))`` emits
one row per year and scalar expressions give the segment columns. No self join and no window: the operator
is narrow, runs inside the scan stage, scales with the input and is immune to key skew. Kept quirks: same-year policies are exposed to Dec 31, and the
expiry-year row excludes the expiry day. Fixed: the key is the (POLICY_ID, CERTIFICATE_ID) row
itself, never a concatenated string, so repeated keys are not multiplied.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from riskframe.operators.validate import key_counts

EXPOSURE_COLUMNS = ["NB_YEAR", "CL_YEAR", "YEAR_SEQ", "START_SEQ", "END_SEQ", "EXPOSURE_DAY", "DAYS_OF_YEAR",
                    "EXPOSURE_YEAR", "TOTAL_EXPOSURE", "EXPOSURE_PREM"]


def _is_leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def prepare_policy_dates(df: DataFrame, start: str = "START_DATE", expiry: str = "EXPIRY_DATE",
                         init: str | None = "INIT_DATE") -> DataFrame:
    """Null START ← INIT; null EXPIRY ← START + 1 year (Feb 29 → Feb 28)."""
    s = F.col(start).cast("date")
    if init and init in df.columns:
        s = F.coalesce(s, F.col(init).cast("date"))
    e = F.coalesce(F.col(expiry).cast("date"), F.add_months(s, 12))
    return df.withColumns({start: s, expiry: e})


def split_exposure(df: DataFrame, years: Iterable[int] | None = None, *, start: str = "START_DATE",
                   expiry: str = "EXPIRY_DATE", init: str | None = "INIT_DATE", gwp: str = "GWP",
                   positive_only: bool = True) -> DataFrame:
    """Policy rows → policy-year rows (see module doc). ``years=None`` keeps every year.

    ``positive_only`` keeps rows with EXPOSURE_PREM > 0 (the reference's output); rows with a
    null date have no year and are dropped. ``YEAR_SEQ`` numbers the rows of one policy row in
    year order (1 = first). Kept rows always form a prefix of the years (only the expiry-year
    row can have zero days), so YEAR_SEQ also numbers the kept rows.

    Plan: one projection computes the year list and the total exposure (closed form, so the
    float result does not depend on partitioning), ``posexplode`` emits the rows, and plain
    per-row expressions give the segment columns.
    """
    df = prepare_policy_dates(df, start, expiry, init)
    st, ex = F.col(start), F.col(expiry)
    ys, ye = F.col("_ys"), F.col("_ye")
    base = list(df.columns)

    def year_days(y: Column) -> Column:
        return F.lit(365) + _is_leap(y).cast("int")

    # per policy row: year bounds, the one-year-leap denominator, first- and last-year shares
    out = df.withColumns({"_ys": F.year(st), "_ye": F.year(ex)})
    out = out.withColumns({
        "NB_YEAR": ye - ys,
        "_years": F.when(st <= ex, F.sequence(ys, ye)).otherwise(F.array(ye)),
        "_leap_den": F.when(((ye - ys) == 1) & _is_leap(ye),
                            F.when(ex > F.make_date(ye, F.lit(2), F.lit(28)), F.lit(366)).otherwise(F.lit(365))),
        "_d_first": F.datediff(F.make_date(ys, F.lit(12), F.lit(31)), st) + 1,
        "_d_last": F.datediff(ex, F.make_date(ye, F.lit(1), F.lit(1))),
    })
    ey_first = F.col("_d_first").cast("double") / F.coalesce("_leap_den", year_days(ys)).cast("double")
    ey_last = F.col("_d_last").cast("double") / F.coalesce("_leap_den", year_days(ye)).cast("double")
    n_mid = F.greatest(ye - ys - 1, F.lit(0)).cast("double")
    # Σ EXPOSURE_YEAR in closed form: middle years are full years (exactly 1.0 each), so the total
    # is (first + number of middle years) + last, in that order (the oracle uses the same order).
    total = (F.when(st <= ex, (ey_first + n_mid) + F.when(ye > ys, ey_last).otherwise(F.lit(0.0)))
              .when(ys == ye, ey_first).otherwise(ey_last))
    out = out.withColumn("TOTAL_EXPOSURE", total)
    out = out.select(*base, "NB_YEAR", "TOTAL_EXPOSURE", "_ys", "_ye", "_leap_den",
                     F.posexplode("_years").alias("_pos", "CL_YEAR"))
    y = F.col("CL_YEAR")
    first = y == ys
    full = first | (y < ye)
    out = out.withColumns({
        "START_SEQ": F.when(first, st).otherwise(F.make_date(y, F.lit(1), F.lit(1))),
        "END_SEQ": F.when(full, F.make_date(y, F.lit(12), F.lit(31))).otherwise(ex),
        "_plus": full.cast("int"),
        "DAYS_OF_YEAR": year_days(y),
    })
    out = out.withColumn("EXPOSURE_DAY", F.datediff("END_SEQ", "START_SEQ") + F.col("_plus"))
    if positive_only:
        # EXPOSURE_DAY >= 0 and TOTAL_EXPOSURE >= 0, so EXPOSURE_PREM > 0 ⇔ GWP > 0 and the row has days
        out = out.filter((F.col(gwp) > 0) & (F.col("EXPOSURE_DAY") > 0))
    if years is not None:
        out = out.filter(F.col("CL_YEAR").isin([int(x) for x in years]))
    out = out.withColumn("EXPOSURE_YEAR", F.try_divide(F.col("EXPOSURE_DAY").cast("double"),
                                                       F.coalesce("_leap_den", "DAYS_OF_YEAR").cast("double")))
    out = out.withColumn("EXPOSURE_PREM",
                         F.col(gwp).cast("double") * F.try_divide(F.col("EXPOSURE_YEAR"), F.col("TOTAL_EXPOSURE")))
    return out.select(*base, "NB_YEAR", "CL_YEAR", (F.col("_pos") + 1).alias("YEAR_SEQ"), "START_SEQ", "END_SEQ",
                      "EXPOSURE_DAY", "DAYS_OF_YEAR", "EXPOSURE_YEAR", "TOTAL_EXPOSURE", "EXPOSURE_PREM")


def reconcile_exposure(policies: DataFrame, *, start: str = "START_DATE", expiry: str = "EXPIRY_DATE",
                       init: str | None = "INIT_DATE", gwp: str = "GWP") -> DataFrame:
    """Reconciliation figures of the split from one aggregate pass: rows after
    the split and the expected Σ(NB_YEAR+1) over policies (they differ by the policies whose
    START is after EXPIRY), duplicate (POLICY_ID, CERTIFICATE_ID, CL_YEAR) rows, premium before
    and after, and the positive / non-positive split (null premiums counted apart).
    """
    all_rows = split_exposure(policies, None, start=start, expiry=expiry, init=init, gwp=gwp, positive_only=False)
    duplicates = key_counts(all_rows, ["POLICY_ID", "CERTIFICATE_ID", "CL_YEAR"]).select("DUPLICATE_ROWS").scalar()
    return all_rows.agg(*_figures(gwp)).withColumn("dup_policy_years", duplicates)


def _figures(gwp: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows_after_split"),
        F.sum(F.when(F.col("YEAR_SEQ") == 1, F.col("NB_YEAR") + 1)).cast("long").alias("rows_expected"),
        F.sum(F.when(F.col("YEAR_SEQ") == 1, F.col(gwp))).cast("decimal(38,4)").alias("premium_of_original"),
        F.sum(F.col("EXPOSURE_PREM")).alias("premium_after_exposure"),
        F.count_if(F.col("EXPOSURE_PREM") > 0).alias("rows_positive"),
        F.count_if(~(F.col("EXPOSURE_PREM") > 0)).alias("rows_non_positive"),
        F.count_if(F.col("EXPOSURE_PREM").isNull()).alias("rows_null_premium"),
    ]


def write_exposure(policies: DataFrame, path: str, *, start: str = "START_DATE", expiry: str = "EXPIRY_DATE",
                   init: str | None = "INIT_DATE", gwp: str = "GWP") -> DataFrame:
    """F13 and C12 in one: write the split to ``path`` and return the figures of ``reconcile_exposure``.

    The policies are read once: the write observes the figures of the rows that pass through it (the split
    is narrow, so they are taken in the writing stage, whose tasks count once even if they are run
    again). Rows go to ``path``/KEPT=true (positive premium, what the rating uses) or KEPT=false, and repeated
    policy-years are counted from the key columns of what is written.
    """
    spark = policies.sparkSession
    seen = Observation("exposure")
    rows = split_exposure(policies, None, start=start, expiry=expiry, init=init, gwp=gwp, positive_only=False)
    rows.observe(seen, *_figures(gwp)).withColumn("KEPT", F.coalesce(F.col("EXPOSURE_PREM") > 0, F.lit(False))) \
        .write.mode("overwrite").partitionBy("KEPT").parquet(path)
    schema = ("rows_after_split long, rows_expected long, premium_of_original decimal(38,4), premium_after_exposure double, "
              "rows_positive long, rows_non_positive long, rows_null_premium long")
    names = [c.split()[0] for c in schema.split(", ")]
    figures = spark.createDataFrame([tuple(seen.get[c] for c in names)], schema)
    key = ["POLICY_ID", "CERTIFICATE_ID", "CL_YEAR"]
    written = spark.read.schema(rows.select(key).schema).parquet(path)
    return figures.withColumn("dup_policy_years", key_counts(written, key).select("DUPLICATE_ROWS").scalar())
