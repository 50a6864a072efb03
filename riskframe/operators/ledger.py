"""General-ledger mapping and the trial balance.

The ledger is an account / contra-account journal (every line stored once from each side), so
both amounts are summed under the debit-side account. The chart of accounts is joined plainly: the
planner broadcasts it by its size in bytes, or shuffles.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TB_KEYS = ["ACCOUNT", "AG_CODE", "BS_CODE", "PL_CODE"]
TB_COLUMNS = TB_KEYS + ["OPENING_DEBIT_AMOUNT", "OPENING_CREDIT_AMOUNT", "PERIOD_DEBIT_AMOUNT",
                        "PERIOD_CREDIT_AMOUNT", "CLOSING_DEBIT_AMOUNT", "CLOSING_CREDIT_AMOUNT", "CLOSING_NET_AMOUNT"]
MONEY = "decimal(38,4)"


def report_period(year: int, code: str, value: int, accumulated: bool = False) -> tuple[dt.date, dt.date]:
    """MONTHLY 1-12, QUARTERLY 1-4, YEARLY 1 → (start, end); accumulated → start is Jan 1."""
    code = code.upper()
    if code == "MONTHLY":
        if not 1 <= value <= 12:
            raise ValueError("month must be 1..12")
        start = dt.date(year, value, 1)
        end = dt.date(year, value, calendar.monthrange(year, value)[1])
    elif code == "QUARTERLY":
        if not 1 <= value <= 4:
            raise ValueError("quarter must be 1..4")
        m0, m1 = 3 * value - 2, 3 * value
        start = dt.date(year, m0, 1)
        end = dt.date(year, m1, calendar.monthrange(year, m1)[1])
    elif code == "YEARLY":
        if value != 1:
            raise ValueError("year period value must be 1")
        start, end = dt.date(year, 1, 1), dt.date(year, 12, 31)
    else:
        raise ValueError(f"unknown report period code {code!r}")
    if accumulated:
        start = dt.date(year, 1, 1)
    return start, end


def require_validated(mapping_status: dict[str, str], fields: tuple[str, ...] = ("DEBIT_ACC", "CREDIT_ACC")) -> None:
    """The account-mapping settings of the ledger columns must be marked ``Validated``
    before a trial balance is built (a plan-time settings check, no data is read)."""
    for f in fields:
        if mapping_status.get(f) != "Validated":
            raise ValueError(f"{f} mapping must be validated before processing the trial balance")


def filter_period(gl: DataFrame, start: dt.date, end: dt.date, col: str = "INVOICE_DATE") -> DataFrame:
    """Rows whose date lies in [start, end] (pushed down to the scan)."""
    return gl.filter(F.col(col).cast("date").between(F.lit(start), F.lit(end)))


def gl_checks(gl: DataFrame, start: dt.date, end: dt.date, closing_account: str = "911") -> DataFrame:
    """B16 + B17 in one aggregate: rows outside the period and whether the closing account occurs."""
    d = F.col("INVOICE_DATE").cast("date")
    return gl.agg(F.count_if((d < F.lit(start)) | (d > F.lit(end))).alias("ROWS_OUTSIDE_PERIOD"),
                  F.max((F.col("DEBIT_ACC") == closing_account) | (F.col("CREDIT_ACC") == closing_account))
                   .alias("HAS_CLOSING_ACCOUNT"))


def map_accounts(gl: DataFrame, accounts: DataFrame, check: bool = False, start: dt.date | None = None,
                 end: dt.date | None = None) -> DataFrame:
    """G11 (D1, D2): attach DEBIT_SM/BS/PL and CREDIT_SM/BS/PL from the chart of accounts (left
    joins; unmapped accounts keep nulls). ``check`` runs the period and closing-account guards."""
    if check:
        r = gl_checks(gl, start, end).first()
        if r["ROWS_OUTSIDE_PERIOD"]:
            raise ValueError(f"INVOICE_DATE outside {start}..{end}: {r['ROWS_OUTSIDE_PERIOD']} rows")
        if not r["HAS_CLOSING_ACCOUNT"]:
            raise ValueError("closing account 911 does not occur in the ledger")
    acc = accounts.select("code", "accountSM", "accountBS", "accountPL")  # broadcast where the planner sees it is small
    deb = acc.select(F.col("code").alias("_dcode"), F.col("accountSM").alias("DEBIT_SM"),
                     F.col("accountBS").alias("DEBIT_BS"), F.col("accountPL").alias("DEBIT_PL"))
    cre = acc.select(F.col("code").alias("_ccode"), F.col("accountSM").alias("CREDIT_SM"),
                     F.col("accountBS").alias("CREDIT_BS"), F.col("accountPL").alias("CREDIT_PL"))
    out = gl.join(deb, gl["DEBIT_ACC"] == deb["_dcode"], "left").drop("_dcode")
    return out.join(cre, out["CREDIT_ACC"] == cre["_ccode"], "left").drop("_ccode")


def _amount(c: str):
    return F.coalesce(F.col(c).try_cast(MONEY), F.lit(0).cast(MONEY))


SUMMARY_KEYS = ["DEBIT_ACC", "DEBIT_SM", "DEBIT_BS", "DEBIT_PL", "CREDIT_SM", "CREDIT_PL"]


def ledger_summary(gl_mapped: DataFrame, period: tuple[dt.date, dt.date], ytd: tuple[dt.date, dt.date]) -> DataFrame:
    """One pass over the mapped ledger down to (account pair codes, in-period, in-year-to-date)
    with every sum the statements need: trial-balance debit/credit (null → 0), net D−C, and the
    per-row positive / negative parts used by the cash flow. The key space is bounded by the
    chart of accounts, so all six statements can be derived from this small table."""
    d = F.col("INVOICE_DATE").cast("date")
    deb, cre = F.col("DEBIT_AMT").try_cast(MONEY), F.col("CREDIT_AMT").try_cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return (gl_mapped.groupBy(*SUMMARY_KEYS, d.between(F.lit(period[0]), F.lit(period[1])).alias("IN_PERIOD"),
                              d.between(F.lit(ytd[0]), F.lit(ytd[1])).alias("IN_YTD"))
            .agg(F.sum(F.coalesce(deb, zero)).alias("SUM_TB_DEBIT"), F.sum(F.coalesce(cre, zero)).alias("SUM_TB_CREDIT"),
                 F.sum(deb - cre).alias("SUM_NET"), F.sum(F.greatest(deb - cre, zero)).alias("SUM_POS"),
                 F.sum(-F.greatest(cre - deb, zero)).alias("SUM_NEG")))


def is_summary(df: DataFrame) -> bool:
    return "SUM_NET" in df.columns


def trial_balance(gl_mapped: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """period debit/credit per (DEBIT_ACC, SM, BS, PL) (null keys dropped, text amounts
    coerced, null → 0); opening from a prior balance's closing columns (full join);
    CLOSING_DEBIT = max(OD+PD-OC-PC, 0), CLOSING_CREDIT = max(OC+PC-OD-PD, 0), NET = difference.
    Fixed: accounts present only in the opening balance get closing amounts (not NaN).
    Accepts the mapped ledger or its ``ledger_summary``."""
    summary = is_summary(gl_mapped)
    dsum = F.sum("SUM_TB_DEBIT") if summary else F.sum(_amount("DEBIT_AMT"))
    csum = F.sum("SUM_TB_CREDIT") if summary else F.sum(_amount("CREDIT_AMT"))
    g = (gl_mapped.filter(F.col("DEBIT_ACC").isNotNull() & F.col("DEBIT_SM").isNotNull()
                          & F.col("DEBIT_BS").isNotNull() & F.col("DEBIT_PL").isNotNull())
         .groupBy(F.col("DEBIT_ACC").alias("ACCOUNT"), F.col("DEBIT_SM").alias("AG_CODE"),
                  F.col("DEBIT_BS").alias("BS_CODE"), F.col("DEBIT_PL").alias("PL_CODE"))
         .agg(dsum.alias("PERIOD_DEBIT_AMOUNT"), csum.alias("PERIOD_CREDIT_AMOUNT")))
    zero = F.lit(0).cast(MONEY)
    if opening is not None:
        op = opening.select(*TB_KEYS, F.col("CLOSING_DEBIT_AMOUNT").cast(MONEY).alias("OPENING_DEBIT_AMOUNT"),
                            F.col("CLOSING_CREDIT_AMOUNT").cast(MONEY).alias("OPENING_CREDIT_AMOUNT"))
        g = g.join(op, TB_KEYS, "full")
    else:
        g = g.withColumns({"OPENING_DEBIT_AMOUNT": zero, "OPENING_CREDIT_AMOUNT": zero})
    g = g.withColumns({c: F.coalesce(F.col(c).cast(MONEY), zero) for c in
                       ["OPENING_DEBIT_AMOUNT", "OPENING_CREDIT_AMOUNT", "PERIOD_DEBIT_AMOUNT", "PERIOD_CREDIT_AMOUNT"]})
    net = (F.col("OPENING_DEBIT_AMOUNT") + F.col("PERIOD_DEBIT_AMOUNT")) - (F.col("OPENING_CREDIT_AMOUNT") + F.col("PERIOD_CREDIT_AMOUNT"))
    g = g.withColumns({"CLOSING_DEBIT_AMOUNT": F.greatest(net, zero).cast(MONEY),
                       "CLOSING_CREDIT_AMOUNT": F.greatest(-net, zero).cast(MONEY)})
    g = g.withColumn("CLOSING_NET_AMOUNT", (F.col("CLOSING_DEBIT_AMOUNT") - F.col("CLOSING_CREDIT_AMOUNT")).cast(MONEY))
    return g.select(*TB_COLUMNS)


def check_balanced(tb: DataFrame, tolerance: float = 1e-6) -> None:
    """Σ CLOSING_NET must be 0 (exact with decimals)."""
    total = tb.agg(F.sum("CLOSING_NET_AMOUNT")).first()[0] or 0
    if abs(float(total)) > tolerance:
        raise ValueError(f"closing balances do not sum to zero: {total}")
