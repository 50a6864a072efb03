"""Financial statements from formula templates.

A template is a few hundred lines at most; it is read on the driver (with a hard bound) and
compiled into a coefficient table ``(line, atom kind, atom key, coef)``:

* detail lines contribute their formula's atoms (e.g. ``-PhatSinhNO`` on line 12 gives
  ``(PLNO, '12', -1)``);
* total lines reference other lines (``±[code]`` / ``±(code)``, summing every line carrying the
  code) and are expanded in the reference's evaluation order, so a reference to a total that is
  not yet evaluated contributes nothing — the one-pass rule, reproduced exactly.

The ledger side is reduced in Spark to one small table of atom values per statement (one
``groupBy`` over the ledger or the trial balance); the coefficient table is joined to it and
summed per line. No ledger data ever reaches the driver.
"""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(38,4)"
# Formula token patterns and dash characters normalised in total formulas.
SQUARE_REF = re.compile(r"([+\-]?)\[([^\]]+)\]")
ROUND_REF = re.compile(r"([+\-]?)\(([^\)]+)\)")
DASHES = ("–", "—", "−")
PL_CO = re.compile(r"([+\-]?)PhatSinhCO")
PL_NO = re.compile(r"([+\-]?)PhatSinhNO")
CF_PL = re.compile(r"([+\-]?)PL\((\d+)\)")
CF_NO = re.compile(r"([+\-]?)PhatSinhNO\(11/(\d+)\)")
CF_CO = re.compile(r"([+\-]?)PhatSinhCO\(11/(\d+)\)")
BS_DUNO = re.compile(r"([+\-]?)DUNO\((\d+)\)")
BS_DUCO = re.compile(r"([+\-]?)DUCO\((\d+)\)")


def _sign(s: str) -> int:
    return -1 if s == "-" else 1


def _num(x) -> float | None:
    try:
        return float(str(x).strip())
    except (TypeError, ValueError):
        return None


def read_template(template: DataFrame, type_: str | None = None) -> list[dict]:
    """A7 + I2: template lines (optionally of one ``type``) sorted by numeric lineCode, unparsable last."""
    if type_ is not None and "type" in template.columns:
        template = template.filter(F.col("type") == type_)
    rows = [r.asDict() for r in template.collect()]  # settings: the formulas make the plan
    keyed = [(0 if _num(r.get("lineCode")) is not None else 1, _num(r.get("lineCode")) or 0.0, i, r)
             for i, r in enumerate(rows)]
    out = []
    for pos, (_, _, _, r) in enumerate(sorted(keyed)):
        r = dict(r)
        r["_line"] = pos
        r["code"] = None if r.get("code") is None else str(r["code"])
        r["_formula"] = "" if r.get("calculationFormula") is None else str(r["calculationFormula"]).replace(" ", "")
        r["_kind"] = str(r.get("isTotalLine")).upper()
        out.append(r)
    return out


Vec = dict[tuple[str, str], int]


def _add(acc: Vec, vec: Vec, k: int) -> None:
    for key, c in vec.items():
        acc[key] = acc.get(key, 0) + k * c


def compile_template(lines: list[dict], detail: Callable[[dict], Vec], total_order: list[int],
                     outside: dict[str, Vec] | None = None, detail_refs_outside: bool = False) -> dict[int, Vec]:
    """Coefficient vectors per line. ``detail`` maps a detail line to its atoms; totals are
    expanded in ``total_order``. With ``detail_refs_outside`` detail lines are ``±[code]``
    references into another statement (``outside``: code → vector), as in PL02."""
    vec: dict[int, Vec] = {}
    for ln in lines:
        if ln["_kind"] == "FALSE":
            vec[ln["_line"]] = (_refs(ln["_formula"], outside if outside is not None else {})
                                 if detail_refs_outside else detail(ln))
    by_code: dict[str, list[int]] = defaultdict(list)
    for ln in lines:
        by_code[ln["code"]].append(ln["_line"])
    for idx in total_order:
        ln = lines[idx]
        current = {}
        for code, members in by_code.items():
            acc: Vec = {}
            for m in members:
                _add(acc, vec.get(m, {}), 1)
            current[code] = acc
        vec[idx] = _refs(ln["_formula"], current)
    return vec


def _refs(formula: str, current: dict[str, Vec]) -> Vec:
    if not formula:
        return {}
    f = formula
    for d in DASHES:
        f = f.replace(d, "-")
    out: Vec = {}
    for pattern in (SQUARE_REF, ROUND_REF):
        for s, code in pattern.findall(f):
            _add(out, current.get(code, {}), _sign(s))
    return out


class _EveryCode(dict):
    """code → {(kind, code): 1} for any code; codes absent from the atoms contribute 0."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def get(self, code, default=None):
        return {(self.kind, code): 1}


def _coef_frame(spark: SparkSession, vec: dict[int, Vec]) -> DataFrame:
    rows = [(line, kind, key, c) for line, v in vec.items() for (kind, key), c in v.items() if c != 0]
    schema = T.StructType([T.StructField("_line", T.IntegerType()), T.StructField("_atom", T.StringType()),
                           T.StructField("_key", T.StringType()), T.StructField("_coef", T.LongType())])
    return spark.createDataFrame(rows, schema)


def _template_frame(spark: SparkSession, lines: list[dict], cols: list[str]) -> DataFrame:
    data = [(ln["_line"], *[ln.get(c) for c in cols]) for ln in lines]
    sample = {c: next((ln.get(c) for ln in lines if ln.get(c) is not None), "") for c in cols}
    fields = [T.StructField("_line", T.IntegerType())]
    for c in cols:
        v = sample[c]
        fields.append(T.StructField(c, T.LongType() if isinstance(v, int) and not isinstance(v, bool) else T.StringType()))
    return spark.createDataFrame([tuple(str(x) if (f.dataType == T.StringType() and x is not None) else x
                                        for x, f in zip(r, fields)) for r in data], T.StructType(fields))


def evaluate(spark: SparkSession, lines: list[dict], vec: dict[int, Vec], atoms: DataFrame,
             measures: list[str], out_cols: list[str], template_types: dict[str, str] | None = None) -> DataFrame:
    """Σ coef × atom value per line, template columns first; lines without atoms give 0.

    ``atoms`` = (_atom, _key, *measures). Both join partners are bounded by the template and
    the code space, so the planner can broadcast either."""
    coef = _coef_frame(spark, vec)
    j = coef.join(atoms, ["_atom", "_key"], "inner")
    sums = j.groupBy("_line").agg(*[F.sum(F.col("_coef").cast("decimal(10,0)") * F.col(m)).alias(m) for m in measures])
    tmpl = _template_frame(spark, lines, [c for c in out_cols if c not in measures])
    res = tmpl.join(sums, "_line", "left")
    res = res.withColumns({m: F.coalesce(F.col(m), F.lit(0)).cast(MONEY) for m in measures})
    if "noteRef" in res.columns:
        res = res.withColumn("noteRef", F.coalesce(F.col("noteRef").cast("string"), F.lit("")))
    # template columns keep the template's own types
    keep = {c: F.col(c).cast(t) for c, t in (template_types or {}).items() if c in res.columns and c not in measures
            and c != "noteRef"}
    return res.withColumns(keep).orderBy("_line").select(*out_cols)


# ----------------------------------------------------------------------------- atom tables
def _atoms(df: DataFrame, kind: str, key, value_cols: dict) -> DataFrame:
    return (df.groupBy(F.col(key).cast("string").alias("_key") if isinstance(key, str) else key.alias("_key"))
              .agg(*[F.sum(v).cast(MONEY).alias(m) for m, v in value_cols.items()])
              .withColumn("_atom", F.lit(kind)))


def bs_atoms(tb: DataFrame) -> DataFrame:
    a = tb.groupBy(F.col("BS_CODE").cast("string").alias("_key")).agg(
        F.sum("CLOSING_NET_AMOUNT").cast(MONEY).alias("BS"), F.sum("CLOSING_DEBIT_AMOUNT").cast(MONEY).alias("DUNO"),
        F.sum("CLOSING_CREDIT_AMOUNT").cast(MONEY).alias("DUCO"))
    return a.selectExpr("_key", "stack(3, 'BS', BS, 'DUNO', DUNO, 'DUCO', DUCO) AS (_atom, CURRENT_AMOUNT)")


def _summary(src: DataFrame, period: tuple[dt.date, dt.date], ytd: tuple[dt.date, dt.date]) -> DataFrame:
    from riskframe.operators.ledger import is_summary, ledger_summary
    return src if is_summary(src) else ledger_summary(src, period, ytd)


def pl_atoms(src: DataFrame, period: tuple[dt.date, dt.date], ytd: tuple[dt.date, dt.date]) -> DataFrame:
    """PhatSinhCO: Σ(DEBIT−CREDIT) where DEBIT_SM = 911, by CREDIT_PL; PhatSinhNO: where
    CREDIT_SM = 911, by DEBIT_PL. CURRENT over the period, ACCUMULATED over the year to date.
    ``src`` is the mapped ledger or its summary (built for the same period)."""
    g = _summary(src, period, ytd).filter(F.col("IN_YTD"))
    sides = [F.when(F.col(own) == "911", F.struct(F.lit(atom).alias("_atom"), F.col(other).cast("string").alias("_key")))
             for atom, own, other in (("PLCO", "DEBIT_SM", "CREDIT_PL"), ("PLNO", "CREDIT_SM", "DEBIT_PL"))]
    # both atoms from one pass over the summary
    both = g.withColumn("_side", F.explode(F.array_compact(F.array(*sides)))).select("*", "_side.*")
    return both.groupBy("_key", "_atom").agg(
        F.sum(F.when(F.col("IN_PERIOD"), F.col("SUM_NET"))).cast(MONEY).alias("CURRENT_AMOUNT"),
        F.sum("SUM_NET").cast(MONEY).alias("ACCUMULATED_AMOUNT"))


def cf_atoms(src: DataFrame, ytd: tuple[dt.date, dt.date], pl01: DataFrame | None = None) -> DataFrame:
    """PhatSinhNO(11/c) = Σ max(D−C, 0), PhatSinhCO(11/c) = −Σ max(C−D, 0), over rows whose
    DEBIT_SM starts with 11 and CREDIT_SM = c; PL(n) = CURRENT_AMOUNT of P&L line n."""
    g = _summary(src, ytd, ytd).filter(F.col("IN_YTD") & (F.substring("DEBIT_SM", 1, 2) == "11"))
    a = g.groupBy(F.col("CREDIT_SM").cast("string").alias("_key")).agg(
        F.sum("SUM_POS").cast(MONEY).alias("NO"), F.sum("SUM_NEG").cast(MONEY).alias("CO"))
    out = a.selectExpr("_key", "stack(2, 'PSNO11', NO, 'PSCO11', CO) AS (_atom, CURRENT_AMOUNT)")
    if pl01 is not None:
        out = out.unionByName(_atoms(pl01, "PL", "code", {"CURRENT_AMOUNT": F.col("CURRENT_AMOUNT")})
                              .select("_key", "_atom", "CURRENT_AMOUNT"))
    return out


# ----------------------------------------------------------------------------- statements
def _bs_sign(code) -> int:
    n = _num(code)
    return 1 if (n is None or n < 300) else -1


def _bs_priority(code) -> int:
    c = str(code)
    return 3 if c in ("270", "440") else 2 if c in ("100", "200", "300", "400") else 1


def balance_sheet(tb: DataFrame, template: DataFrame, type_: str | None = None, check: bool = False) -> DataFrame:
    """G1 + G6: detail = ±Σ CLOSING_NET by BS code (+ below 300 or non-numeric, − from 300);
    totals by priority (others, then 100/200/300/400, then 270/440), numeric code descending."""
    spark = tb.sparkSession
    lines = read_template(template, type_)
    totals = [ln for ln in lines if ln["_kind"] == "TRUE"]
    order = [ln["_line"] for ln in sorted(totals, key=lambda ln: (_bs_priority(ln["code"]),
                                                                  -(_num(ln["code"]) if _num(ln["code"]) is not None else float("-inf"))))]
    vec = compile_template(lines, lambda ln: {("BS", ln["code"]): _bs_sign(ln["code"])}, order)
    out = evaluate(spark, lines, vec, bs_atoms(tb), ["CURRENT_AMOUNT"],
                   ["lineCode", "lineName", "code", "noteRef", "CURRENT_AMOUNT"], dict(template.dtypes))
    if check:
        r = out.agg(F.sum(F.when(F.col("code") == "270", F.col("CURRENT_AMOUNT"))).alias("a"),
                    F.sum(F.when(F.col("code") == "440", F.col("CURRENT_AMOUNT"))).alias("c")).first()
        if (r["a"] or 0) != (r["c"] or 0):
            raise ValueError(f"assets {r['a']} differ from capital {r['c']}")
    return out


def duno_duco(tb: DataFrame, template: DataFrame, type_: str | None = None) -> DataFrame:
    """``±DUNO(code)`` → +Σ CLOSING_DEBIT, ``±DUCO(code)`` → −Σ CLOSING_CREDIT, by BS code."""
    spark = tb.sparkSession
    lines = read_template(template, type_)

    def detail(ln):
        v: Vec = {}
        for s, c in BS_DUNO.findall(ln["_formula"]):
            _add(v, {("DUNO", c): 1}, _sign(s))
        for s, c in BS_DUCO.findall(ln["_formula"]):
            _add(v, {("DUCO", c): -1}, _sign(s))
        return v
    order = [ln["_line"] for ln in lines if ln["_kind"] == "TRUE"]
    vec = compile_template(lines, detail, order)
    return evaluate(spark, lines, vec, bs_atoms(tb), ["CURRENT_AMOUNT"],
                    ["lineCode", "lineName", "code", "noteRef", "CURRENT_AMOUNT"], dict(template.dtypes))


def profit_loss(gl_mapped: DataFrame, template: DataFrame, period: tuple[dt.date, dt.date],
                ytd: tuple[dt.date, dt.date], type_: str | None = None) -> DataFrame:
    """G3 + G7: detail lines count each ``±PhatSinhCO`` / ``±PhatSinhNO`` of their formula with the
    line's own code; totals in line order. CURRENT = period, ACCUMULATED = year to date."""
    spark = gl_mapped.sparkSession
    lines = read_template(template, type_)

    def detail(ln):
        v: Vec = {}
        if not ln["_formula"]:
            return v
        for s in PL_CO.findall(ln["_formula"]):
            _add(v, {("PLCO", ln["code"]): 1}, _sign(s))
        for s in PL_NO.findall(ln["_formula"]):
            _add(v, {("PLNO", ln["code"]): 1}, _sign(s))
        return v
    order = [ln["_line"] for ln in lines if ln["_kind"] == "TRUE"]
    vec = compile_template(lines, detail, order)
    return evaluate(spark, lines, vec, pl_atoms(gl_mapped, period, ytd), ["CURRENT_AMOUNT", "ACCUMULATED_AMOUNT"],
                    ["lineCode", "lineName", "code", "noteRef", "CURRENT_AMOUNT", "ACCUMULATED_AMOUNT"],
                    dict(template.dtypes))


def profit_loss_summary(pl01: DataFrame, template: DataFrame, type_: str | None = None) -> DataFrame:
    """Detail lines reference P&L 01 lines by code; totals reference this template's lines."""
    spark = pl01.sparkSession
    lines = read_template(template, type_)
    outside = _EveryCode("PL01")  # each P&L 01 code is an atom (summed over all lines carrying it)
    order = [ln["_line"] for ln in lines if ln["_kind"] == "TRUE"]
    vec = compile_template(lines, lambda ln: {}, order, outside=outside, detail_refs_outside=True)
    atoms = (pl01.groupBy(F.col("code").cast("string").alias("_key"))
                 .agg(F.sum("CURRENT_AMOUNT").cast(MONEY).alias("CURRENT_AMOUNT"),
                      F.sum("ACCUMULATED_AMOUNT").cast(MONEY).alias("ACCUMULATED_AMOUNT"))
                 .withColumn("_atom", F.lit("PL01")))
    return evaluate(spark, lines, vec, atoms, ["CURRENT_AMOUNT", "ACCUMULATED_AMOUNT"],
                    ["lineCode", "lineName", "code", "CURRENT_AMOUNT", "ACCUMULATED_AMOUNT"], dict(template.dtypes))


def cash_flow(gl_mapped: DataFrame, template: DataFrame, ytd: tuple[dt.date, dt.date],
              pl01: DataFrame | None = None, type_: str | None = None) -> DataFrame:
    """G4 + G9/G10: direct (``PhatSinhNO/CO(11/c)``) and indirect (``PL(n)``) cash-flow lines over
    the year to date; totals in line order. Without ``pl01`` the ``PL(n)`` terms are 0."""
    spark = gl_mapped.sparkSession
    lines = read_template(template, type_)

    def detail(ln):
        v: Vec = {}
        f = ln["_formula"]
        if not f:
            return v
        if pl01 is not None:
            for s, c in CF_PL.findall(f):
                _add(v, {("PL", c): 1}, _sign(s))
        for s, c in CF_NO.findall(f):
            _add(v, {("PSNO11", c): 1}, _sign(s))
        for s, c in CF_CO.findall(f):
            _add(v, {("PSCO11", c): 1}, _sign(s))
        return v
    order = [ln["_line"] for ln in lines if ln["_kind"] == "TRUE"]
    vec = compile_template(lines, detail, order)
    return evaluate(spark, lines, vec, cf_atoms(gl_mapped, ytd, pl01), ["CURRENT_AMOUNT"],
                    ["lineCode", "lineName", "code", "noteRef", "CURRENT_AMOUNT"], dict(template.dtypes))


def financial_report(gl: DataFrame, accounts: DataFrame, templates: dict[str, DataFrame], year: int,
                     period_code: str, period_value: int, opening: DataFrame | None = None,
                     type_: str | None = None, check: bool = True,
                     mapping_status: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The six tables. The mapped ledger is the shared input of five of them. With
    ``mapping_status`` the G13 guard runs first."""
    from riskframe.operators.ledger import (check_balanced, ledger_summary, map_accounts, report_period,
                                            require_validated, trial_balance)
    if mapping_status is not None:
        require_validated(mapping_status)
    period = report_period(year, period_code, period_value, False)
    ytd = report_period(year, period_code, period_value, True)
    from riskframe.session import cut_lineage
    mapped = map_accounts(gl, accounts, check=check, start=ytd[0], end=ytd[1])
    # one scan of the ledger; the small summary is checkpointed to the shared folder and every
    # statement is derived from it
    summary = cut_lineage(ledger_summary(mapped, period, ytd))
    tb = trial_balance(summary, opening)
    if check:
        check_balanced(tb)
    pl01 = profit_loss(summary, templates["pl01"], period, ytd, type_)
    return {
        "trial_balance": tb,
        "balance_sheet": balance_sheet(tb, templates["bs"], type_, check=check),
        "pl01": pl01,
        "pl02": profit_loss_summary(pl01, templates["pl02"], type_),
        "cf01": cash_flow(summary, templates["cf01"], ytd, None, type_),
        "cf02": cash_flow(summary, templates["cf02"], ytd, pl01, type_),
    }
