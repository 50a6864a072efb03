"""DuckDB oracle SQL for every registered query, written from the semantics contract.

Each statement inlines the derived views as CTEs (``oracle_with``) and recomputes the result
with plain SQL: per-combination ``GROUP BY`` + ``UNION ALL`` instead of grouping sets,
``ROW_NUMBER`` instead of the first-row aggregate, list folds instead of Spark arrays.
"""

from __future__ import annotations

import math
import re
import unicodedata

from riskframe.functions.money import money_sql
from riskframe.functions.numeric import round_sql
from riskframe.plans.quality import PLATE_FORMS
from riskframe.sources.fixtures import oracle_with

ORACLE: dict[str, str] = {}


def _q(name: str, views: tuple[str, ...], body: str) -> None:
    """Prefix the view CTEs; a body may add CTEs of its own (starting with ``name AS`` or ``,``)."""
    head = oracle_with(*views)
    b = body.lstrip()
    if not head:
        ORACLE[name] = ("WITH " + b.lstrip(",")) if not (b.upper().startswith("SELECT") or b.startswith("(")) else b
    elif b.startswith(","):
        ORACLE[name] = head + b
    elif b.upper().startswith("SELECT") or b.startswith("("):
        ORACLE[name] = head + b
    else:
        ORACLE[name] = head + ", " + b


def _case(expr: str, edges, labels) -> str:
    parts = []
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = f"{expr} >= {float(lo)!r}" if i == 0 else f"{expr} > {float(lo)!r}"
        cond = lower if math.isinf(hi) else f"{lower} AND {expr} <= {float(hi)!r}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'NaN' END"


# Written out, not taken from the engine: cut points (right-closed) and labels of the buckets.
INF = math.inf
AGE_CUTS, AGE_LABELS = [0, 2, 5, 9, INF], ["01-Under 3 years", "02-From 3 to 5 years", "03-From 6 to 9 years", "04-From 10 years and above"]
SEAT_CUTS, SEAT_LABELS = [0, 5, 8, INF], ["01-Under 6 seats", "02-From 6 to 8 seats", "03-From 9 seats and above"]
VALUE_CUTS, VALUE_LABELS = [0, 4e8, 8e8, 1.2e9, INF], ["01-From 0 to 400m", "02-Above 400m to 800m", "03-Above 800m to 1.20bn", "04-Above 1.20bn"]
AGE_VI = ["Dưới 3 năm", "Từ 3 đến 5 năm", "Từ 6 đến 9 năm", "Từ 10 năm trở lên"]
AGE_VI_CODES = ["01", "02", "03", "04"]
IMPORT_FORMATS = ["%d/%m/%Y %H:%M", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"]
ACCEPTED_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d.%m.%Y", "%m.%d.%Y", "%d %b %Y", "%d %B %Y",
                    "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m-%d-%Y %I:%M %p"]


def _amount(expr):
    return _case(f"CAST({expr} AS DOUBLE)", VALUE_CUTS, VALUE_LABELS)


def _unit(expr, cuts, labels):
    return _case(f"CAST({expr} AS DOUBLE)", cuts, labels)


# ---------------------------------------------------------------- exposure
EXPOSURE_CTES = f"""
p0 AS (SELECT *, year(START_DATE) AS ys, year(EXPIRY_DATE) AS ye, year(EXPIRY_DATE) - year(START_DATE) AS NB_YEAR FROM v_policy),
p1 AS (SELECT *, unnest(CASE WHEN START_DATE <= EXPIRY_DATE THEN range(ys, ye + 1) ELSE [ye] END) AS CL_YEAR FROM p0),
p2 AS (SELECT *,
    CASE WHEN CL_YEAR = ys THEN START_DATE ELSE make_date(CAST(CL_YEAR AS INT), 1, 1) END AS START_SEQ,
    CASE WHEN CL_YEAR = ys OR CL_YEAR < ye THEN make_date(CAST(CL_YEAR AS INT), 12, 31) ELSE EXPIRY_DATE END AS END_SEQ,
    CASE WHEN CL_YEAR = ys OR CL_YEAR < ye THEN 1 ELSE 0 END AS plus_one,
    dayofyear(make_date(CAST(CL_YEAR AS INT), 12, 31)) AS DAYS_OF_YEAR,
    (NB_YEAR = 1 AND ((ye % 4 = 0 AND ye % 100 <> 0) OR ye % 400 = 0)) AS one_leap
  FROM p1),
p3 AS (SELECT *, CAST(END_SEQ - START_SEQ + plus_one AS INT) AS EXPOSURE_DAY,
    CASE WHEN one_leap THEN (CASE WHEN EXPIRY_DATE > make_date(CAST(ye AS INT), 2, 28) THEN 366 ELSE 365 END) ELSE DAYS_OF_YEAR END AS denom
  FROM p2),
p4 AS (SELECT *, CAST(EXPOSURE_DAY AS DOUBLE) / CAST(denom AS DOUBLE) AS EXPOSURE_YEAR FROM p3),
ptot AS (SELECT POLICY_ID, CERTIFICATE_ID,
    (max(EXPOSURE_YEAR) FILTER (WHERE CL_YEAR = min_y) + CAST(greatest(max(NB_YEAR) - 1, 0) AS DOUBLE))
      + coalesce(max(EXPOSURE_YEAR) FILTER (WHERE CL_YEAR = max_y AND max_y > min_y), 0.0) AS TOTAL_EXPOSURE
  FROM (SELECT *, min(CL_YEAR) OVER w AS min_y, max(CL_YEAR) OVER w AS max_y FROM p4
        WINDOW w AS (PARTITION BY POLICY_ID, CERTIFICATE_ID)) GROUP BY POLICY_ID, CERTIFICATE_ID),
p5 AS (SELECT p4.*, ptot.TOTAL_EXPOSURE, CAST(GWP AS DOUBLE) * (EXPOSURE_YEAR / ptot.TOTAL_EXPOSURE) AS EXPOSURE_PREM_D
  FROM p4 JOIN ptot USING (POLICY_ID, CERTIFICATE_ID)),
py AS (SELECT *, CAST(row_number() OVER (PARTITION BY POLICY_ID, CERTIFICATE_ID ORDER BY CL_YEAR) AS INT) AS YEAR_SEQ,
    {money_sql("EXPOSURE_PREM_D")} AS EXPOSURE_PREM
  FROM p5 WHERE EXPOSURE_PREM_D > 0)"""

_q("exposure_split", ("v_policy",), EXPOSURE_CTES + """
SELECT POLICY_ID, CERTIFICATE_ID, START_DATE, EXPIRY_DATE, CAST(NB_YEAR AS INT) AS NB_YEAR, CAST(CL_YEAR AS INT) AS CL_YEAR,
  YEAR_SEQ, START_SEQ, END_SEQ, EXPOSURE_DAY, CAST(DAYS_OF_YEAR AS INT) AS DAYS_OF_YEAR, EXPOSURE_YEAR, TOTAL_EXPOSURE, EXPOSURE_PREM
FROM py""")

_q("exposure_total_by_year", ("v_policy",), EXPOSURE_CTES + """
SELECT CAST(CL_YEAR AS INT) AS CL_YEAR, count(*) AS NUM_ROWS, count(DISTINCT POLICY_ID) AS NUM_POLS,
  CAST(sum(EXPOSURE_DAY) AS BIGINT) AS EXPOSURE_DAYS, CAST(sum(EXPOSURE_PREM) AS DECIMAL(38,4)) AS EXPOSURE_PREM
FROM py GROUP BY CL_YEAR""")

_q("exposure_reconcile", ("v_policy",), EXPOSURE_CTES + f"""
SELECT count(*) AS rows_after_split,
  CAST((SELECT sum(year(EXPIRY_DATE) - year(START_DATE) + 1) FROM v_policy WHERE START_DATE IS NOT NULL AND EXPIRY_DATE IS NOT NULL) AS BIGINT) AS rows_expected,
  count(*) - count(DISTINCT {{'a': POLICY_ID, 'b': CERTIFICATE_ID, 'c': CL_YEAR}}) AS dup_policy_years,
  CAST((SELECT sum(GWP) FROM v_policy WHERE START_DATE IS NOT NULL AND EXPIRY_DATE IS NOT NULL) AS DECIMAL(38,4)) AS premium_of_original,
  CAST({money_sql("sum(EXPOSURE_PREM_D)", 2, 36)} AS DECIMAL(38,2)) AS premium_after_exposure,
  count(*) FILTER (WHERE EXPOSURE_PREM_D > 0) AS rows_positive,
  count(*) FILTER (WHERE EXPOSURE_PREM_D <= 0) AS rows_non_positive,
  count(*) FILTER (WHERE EXPOSURE_PREM_D IS NULL) AS rows_null_premium
FROM p5""")

# ---------------------------------------------------------------- claims
CLAIM_CTES = """
cl AS (SELECT *, year(OCCURENCE_DATE) AS LD_YEAR FROM v_claim
  WHERE CLAIM_PMT >= 0 AND POLICY_ID IS NOT NULL AND CERTIFICATE_ID IS NOT NULL AND OCCURENCE_DATE IS NOT NULL),
cg AS (SELECT POLICY_ID, CERTIFICATE_ID, CAST(LD_YEAR AS INT) AS LD_YEAR, count(CLAIM_ID) AS NUM_CLAIMS, sum(CLAIM_PMT) AS CLAIM_PMT,
    count(CLAIM_ID) FILTER (WHERE CAST(split_part(CLAIM_ID, '-', 4) AS BIGINT) % 2 = 1) AS NUM_CLAIMS_AC01,
    sum(CLAIM_PMT) FILTER (WHERE CAST(split_part(CLAIM_ID, '-', 4) AS BIGINT) % 2 = 1) AS CLAIM_PMT_AC01,
    count(CLAIM_ID) FILTER (WHERE CAST(split_part(CLAIM_ID, '-', 4) AS BIGINT) % 2 = 0) AS NUM_CLAIMS_AC02,
    sum(CLAIM_PMT) FILTER (WHERE CAST(split_part(CLAIM_ID, '-', 4) AS BIGINT) % 2 = 0) AS CLAIM_PMT_AC02
  FROM cl GROUP BY POLICY_ID, CERTIFICATE_ID, LD_YEAR)"""

_q("claims_grouped", ("v_claim",), CLAIM_CTES + """
SELECT POLICY_ID, CERTIFICATE_ID, LD_YEAR, NUM_CLAIMS, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT FROM cg""")

SEQ_CTES = """,
cseq AS (SELECT cl.CLAIM_ID, cl.POLICY_ID, cl.CERTIFICATE_ID, CAST(cl.LD_YEAR AS INT) AS LD_YEAR, cl.OCCURENCE_DATE, iv.START_SEQ, iv.END_SEQ, cl.CLAIM_PMT,
    (cl.OCCURENCE_DATE >= iv.START_SEQ AND cl.OCCURENCE_DATE <= iv.END_SEQ) AS IN_SEQ
  FROM cl JOIN (SELECT DISTINCT POLICY_ID, CERTIFICATE_ID, CL_YEAR, START_SEQ, END_SEQ FROM py) iv
    ON cl.POLICY_ID = iv.POLICY_ID AND cl.CERTIFICATE_ID = iv.CERTIFICATE_ID AND cl.LD_YEAR = iv.CL_YEAR)"""

_q("claims_in_sequence", ("v_policy", "v_claim"), EXPOSURE_CTES + "," + CLAIM_CTES + SEQ_CTES + """
SELECT CLAIM_ID, POLICY_ID, CERTIFICATE_ID, LD_YEAR, OCCURENCE_DATE, START_SEQ, END_SEQ, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT, IN_SEQ FROM cseq""")

_q("claims_attached", ("v_policy", "v_claim"), EXPOSURE_CTES + "," + CLAIM_CTES + SEQ_CTES + """,
sagg AS (SELECT POLICY_ID, CERTIFICATE_ID, LD_YEAR, START_SEQ, END_SEQ,
    count(*) FILTER (WHERE IN_SEQ) AS NUM_CLAIMS_SEQ, count(*) FILTER (WHERE NOT IN_SEQ) AS NUM_CLAIMS_NOT_SEQ,
    sum(CLAIM_PMT) FILTER (WHERE IN_SEQ) AS CLAIM_PMT_SEQ, sum(CLAIM_PMT) FILTER (WHERE NOT IN_SEQ) AS CLAIM_PMT_NOT_SEQ
  FROM cseq GROUP BY ALL)
SELECT py.POLICY_ID, py.CERTIFICATE_ID, CAST(py.CL_YEAR AS INT) AS CL_YEAR, py.START_SEQ, py.END_SEQ,
  cg.NUM_CLAIMS, CAST(cg.CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT,
  coalesce(sagg.NUM_CLAIMS_SEQ, 0) AS NUM_CLAIMS_SEQ, coalesce(sagg.NUM_CLAIMS_NOT_SEQ, 0) AS NUM_CLAIMS_NOT_SEQ,
  CAST(sagg.CLAIM_PMT_SEQ AS DECIMAL(38,4)) AS CLAIM_PMT_SEQ, CAST(sagg.CLAIM_PMT_NOT_SEQ AS DECIMAL(38,4)) AS CLAIM_PMT_NOT_SEQ
FROM py LEFT JOIN cg ON py.POLICY_ID = cg.POLICY_ID AND py.CERTIFICATE_ID = cg.CERTIFICATE_ID AND py.CL_YEAR = cg.LD_YEAR
LEFT JOIN sagg ON py.POLICY_ID = sagg.POLICY_ID AND py.CERTIFICATE_ID = sagg.CERTIFICATE_ID AND py.CL_YEAR = sagg.LD_YEAR
  AND py.START_SEQ = sagg.START_SEQ AND py.END_SEQ = sagg.END_SEQ""")

_q("claims_unmatched", ("v_policy", "v_claim", "v_claim_ext"), EXPOSURE_CTES + "," + CLAIM_CTES.replace("v_claim", "v_claim_ext") + """
SELECT POLICY_ID, CERTIFICATE_ID, LD_YEAR, NUM_CLAIMS, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT FROM cg
WHERE POLICY_ID NOT IN (SELECT POLICY_ID FROM py WHERE POLICY_ID IS NOT NULL)""")

# ---------------------------------------------------------------- buckets
_AGE, _SEATS = (AGE_CUTS, AGE_LABELS), (SEAT_CUTS, SEAT_LABELS)

_q("bucket_amount", ("v_policy",), f"""
SELECT {_amount('VEHICLE_VALUE')} AS VEHICLE_VALUE_GROUP, count(*) AS NUM_POLICIES, CAST(sum(GWP) AS DECIMAL(38,4)) AS GWP
FROM v_policy GROUP BY 1""")

_q("bucket_unit", ("v_policy",), f"""
SELECT {_unit('VEHICLE_AGE', *_AGE)} AS VEHICLE_AGE_GROUP, {_unit('VEHICLE_SEATS', *_SEATS)} AS VEHICLE_SEATS_GROUP, count(*) AS NUM_POLICIES
FROM v_policy GROUP BY 1, 2""")

# ---------------------------------------------------------------- n-way
GLM_CTE = f""",
glm AS (SELECT py.*, CAST(py.CL_YEAR AS INT) AS CAL_YEAR, cg.NUM_CLAIMS, cg.CLAIM_PMT,
    cg.NUM_CLAIMS_AC01, cg.CLAIM_PMT_AC01, cg.NUM_CLAIMS_AC02, cg.CLAIM_PMT_AC02,
    {_unit('VEHICLE_AGE', *_AGE)} AS VEHICLE_AGE_GROUP,
    {_unit('VEHICLE_SEATS', *_SEATS)} AS VEHICLE_SEATS_GROUP,
    {_amount('VEHICLE_VALUE')} AS VEHICLE_VALUE_GROUP
  FROM py LEFT JOIN cg ON py.POLICY_ID = cg.POLICY_ID AND py.CERTIFICATE_ID = cg.CERTIFICATE_ID AND py.CL_YEAR = cg.LD_YEAR)"""

FACTORS = ["VEHICLE_AGE_GROUP", "VEHICLE_SEATS_GROUP", "VEHICLE_VALUE_GROUP", "TYPE_VEHICLE", "USAGE_CODE", "PROVINCE"]


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) IS NULL OR CAST({b} AS DOUBLE) = 0 OR ({a}) IS NULL THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def nway_sql(combos, years, code=None, desc=None) -> str:
    """One SELECT per (combination, year), each a plain GROUP BY (all rows) joined to a plain
    GROUP BY over the first row of each policy (ROW_NUMBER by CAL_YEAR)."""
    n = len(combos[0])
    num = f"NUM_CLAIMS_{code}" if code else "NUM_CLAIMS"
    pmt = f"CLAIM_PMT_{code}" if code else "CLAIM_PMT"
    suffix = f": {code}" if code else ""
    dsuffix = f": {desc}" if code else ""
    parts = []
    for idx, combo in enumerate(combos):
        label = f"{idx + 1:03d}_{combo[0]}" if n == 1 else f"{idx + 1:03d}: {' & '.join(combo)}"
        fl = ", ".join(combo)
        notnull = " AND ".join(f"{f} IS NOT NULL" for f in combo)
        for y in years:
            where = "TRUE" if y == 0 else f"CAL_YEAR = {y}"
            if n == 1:
                labels = f"'{combo[0]}{dsuffix}' AS VAR_NAME, CAST(a.{combo[0]} AS VARCHAR) || '{dsuffix}' AS VAR_DETAIL"
            else:
                labels = ", ".join(f"'{f}{dsuffix}' AS VAR_NAME{i + 1}" for i, f in enumerate(combo)) + ", " + \
                    ", ".join(f"CAST(a.{f} AS VARCHAR) || '{dsuffix}' AS VAR_DETAIL{i + 1}" for i, f in enumerate(combo))
            join = " AND ".join(f"a.{f} = e.{f}" for f in combo)
            parts.append(f"""
SELECT {y} AS VAR_YEAR, '{label}{suffix}' AS VAR_NAME_CODE, {labels},
  a.NUM_POLS, a.NUM_CLAIMS, e.EXPOSURE_YEAR, e.EXPOSURE_PREM, a.CLAIM_PMT, e.SUM_ASSURED
FROM (SELECT {fl}, count(DISTINCT POLICY_ID) AS NUM_POLS, sum({num}) AS NUM_CLAIMS, sum({pmt}) AS CLAIM_PMT
      FROM glm WHERE {where} AND {notnull} GROUP BY {fl}) a
LEFT JOIN (SELECT {fl}, CAST(sum(CAST(EXPOSURE_YEAR AS DECIMAL(20,12))) AS DOUBLE) AS EXPOSURE_YEAR, sum(EXPOSURE_PREM) AS EXPOSURE_PREM, sum(VEHICLE_VALUE) AS SUM_ASSURED
      FROM (SELECT *, row_number() OVER (PARTITION BY POLICY_ID ORDER BY CAL_YEAR) AS rn FROM glm WHERE {where})
      WHERE rn = 1 AND {notnull} GROUP BY {fl}) e ON {join}""")
    body = "\nUNION ALL".join(parts)
    ey, ep, nc, cp = "coalesce(EXPOSURE_YEAR, 0.0)", "coalesce(EXPOSURE_PREM, 0)", "coalesce(NUM_CLAIMS, 0)", "coalesce(CLAIM_PMT, 0)"
    names = "VAR_NAME, VAR_DETAIL" if n == 1 else ", ".join(
        [f"VAR_NAME{i + 1}" for i in range(n)] + [f"VAR_DETAIL{i + 1}" for i in range(n)])
    return f"""
SELECT CAST(VAR_YEAR AS INT) AS VAR_YEAR, VAR_NAME_CODE, {names},
  CAST(NUM_POLS AS BIGINT) AS NUM_POLS, CAST({nc} AS BIGINT) AS NUM_CLAIMS,
  {round_sql(ey, 6)} AS EXPOSURE_YEAR, CAST({ep} AS DECIMAL(38,4)) AS EXPOSURE_PREM,
  CAST(round_even(CAST({cp} AS DECIMAL(38,4)), 0) AS DECIMAL(38,0)) AS CLAIM_PMT,
  {round_sql(_div(nc, ey), 6)} AS FREQUENCY, {round_sql(_div(cp, nc), 6)} AS SEVERITY,
  {round_sql(_div(ep, ey), 6)} AS AVG_PREMIUM, {round_sql(_div(nc, ey) + ' * ' + _div(cp, nc), 6)} AS PURE_PREMIUM,
  {round_sql(_div(cp, ep), 6)} AS LOSS_RATIO,
  {round_sql(_div(ep, f'sum({ep}) OVER (PARTITION BY VAR_YEAR, VAR_NAME_CODE)'), 6)} AS "GWP_%",
  CAST(coalesce(SUM_ASSURED, 0) AS DECIMAL(38,4)) AS SUM_ASSURED,
  {round_sql(_div('SUM_ASSURED', ey), 2)} AS AVG_SUM_ASSURED
FROM ({body}) t"""


def _glm(name, combos, years, code=None, desc=None, wrap=None):
    body = nway_sql(combos, years, code, desc)
    sql = (EXPOSURE_CTES + "," + CLAIM_CTES + GLM_CTE + "\n" + (wrap(body) if wrap else body))
    _q(name, ("v_policy", "v_claim"), sql)


def _pairs(factors):
    import itertools
    return list(itertools.combinations(factors, 2))


_glm("nway_1", [(f,) for f in FACTORS], [1997])
_glm("nway_2", [("VEHICLE_AGE_GROUP", "TYPE_VEHICLE"), ("VEHICLE_VALUE_GROUP", "PROVINCE")], [0])
_glm("nway_3", [("VEHICLE_AGE_GROUP", "VEHICLE_SEATS_GROUP", "USAGE_CODE")], [1996, 1997])
_glm("nway_4", [("VEHICLE_AGE_GROUP", "VEHICLE_VALUE_GROUP", "TYPE_VEHICLE", "PROVINCE")], [1997])
_glm("nway_all_pairs", _pairs(FACTORS), [1996, 1998])
_glm("nway_coverage_code", [(f,) for f in FACTORS], [1997],
     wrap=lambda b: b.replace("SELECT CAST(VAR_YEAR", "SELECT CAST(VAR_YEAR", 1))
# coverage codes: AC01, AC02 and the all-benefit table, stacked
ORACLE["nway_coverage_code"] = (oracle_with("v_policy", "v_claim") + ", " + EXPOSURE_CTES + "," + CLAIM_CTES + GLM_CTE
                                + "\n" + "\nUNION ALL\n".join(
                                    f"({nway_sql([(f,) for f in FACTORS], [1997], c, d)})"
                                    for c, d in [("AC01", "Odd supplier benefit"), ("AC02", "Even supplier benefit"),
                                                 (None, None)]))
_glm("gwp_share", [("PROVINCE",)], [0],
     wrap=lambda b: f"SELECT VAR_YEAR, VAR_NAME_CODE, VAR_DETAIL, EXPOSURE_PREM, \"GWP_%\" FROM ({b}) s")


def _complete(b: str) -> str:
    grid = ", ".join(f"('{s}', '{v}')" for s in SEAT_LABELS for v in VALUE_LABELS)
    return f"""
SELECT 1997 AS VAR_YEAR, '001: VEHICLE_SEATS_GROUP & VEHICLE_VALUE_GROUP' AS VAR_NAME_CODE,
  'VEHICLE_SEATS_GROUP' AS VAR_NAME1, 'VEHICLE_VALUE_GROUP' AS VAR_NAME2, coalesce(g.d1, r.VAR_DETAIL1) AS VAR_DETAIL1, coalesce(g.d2, r.VAR_DETAIL2) AS VAR_DETAIL2,
  coalesce(r.NUM_POLS, 0) AS NUM_POLS, coalesce(r.NUM_CLAIMS, 0) AS NUM_CLAIMS, coalesce(r.EXPOSURE_YEAR, 0.0) AS EXPOSURE_YEAR,
  coalesce(r.EXPOSURE_PREM, CAST(0 AS DECIMAL(38,4))) AS EXPOSURE_PREM, coalesce(r.CLAIM_PMT, CAST(0 AS DECIMAL(38,0))) AS CLAIM_PMT,
  coalesce(r.FREQUENCY, 0.0) AS FREQUENCY, coalesce(r.SEVERITY, 0.0) AS SEVERITY, coalesce(r.AVG_PREMIUM, 0.0) AS AVG_PREMIUM,
  coalesce(r.PURE_PREMIUM, 0.0) AS PURE_PREMIUM, coalesce(r.LOSS_RATIO, 0.0) AS LOSS_RATIO, coalesce(r."GWP_%", 0.0) AS "GWP_%",
  coalesce(r.SUM_ASSURED, CAST(0 AS DECIMAL(38,4))) AS SUM_ASSURED, coalesce(r.AVG_SUM_ASSURED, 0.0) AS AVG_SUM_ASSURED
FROM (VALUES {grid}) g(d1, d2) FULL JOIN ({b}) r ON r.VAR_DETAIL1 = g.d1 AND r.VAR_DETAIL2 = g.d2"""


_glm("nway_complete", [("VEHICLE_SEATS_GROUP", "VEHICLE_VALUE_GROUP")], [1997], wrap=_complete)


# ---------------------------------------------------------------- PNT-11
def _age_vi(expr: str) -> tuple[str, str]:
    x = f"CAST({expr} AS DOUBLE)"
    return _case(x, AGE_CUTS, AGE_VI), _case(x, AGE_CUTS, AGE_VI_CODES)


def _mapped(view: str, cov: str) -> str:
    grp, code = _age_vi("s.VEHICLE_AGE")
    return f"""SELECT s.*, coalesce(mc.PROD_MOF_CODE, '') AS PROD_MOF_CODE, coalesce(mc.PROD_MOF_NAME, '') AS PROD_MOF_NAME,
  coalesce(mv.PNT_11_CODE, '') AS PNT_11_CODE, coalesce(mv.PNT_11_NAME, '') AS PNT_11_NAME,
  coalesce(mv.SUB_PNT_11_CODE, '') AS SUB_PNT_11_CODE, coalesce(mv.SUB_PNT_11_NAME, '') AS SUB_PNT_11_NAME,
  {grp} AS VEHICLE_AGE_GROUP, {code} AS AGE_PNT_11_CODE
FROM {view} s LEFT JOIN m_coverage mc ON CAST(s.{cov} AS VARCHAR) = mc.cols LEFT JOIN m_vehicle mv ON CAST(s.TYPE_VEHICLE AS VARCHAR) = mv.cols"""


KEYS8 = "PROD_MOF_CODE, PROD_MOF_NAME, PNT_11_CODE, PNT_11_NAME, SUB_PNT_11_CODE, SUB_PNT_11_NAME, VEHICLE_AGE_GROUP, AGE_PNT_11_CODE"
MOF_VIEWS = ("v_mof_premium", "v_mof_claim", "v_reserve", "m_coverage", "m_vehicle")
MOF_CTES = f"""
mp AS ({_mapped('v_mof_premium', 'COVERAGE_ID')}),
mc8 AS ({_mapped('v_mof_claim', 'COVERAGE_ID')}),
mr AS ({_mapped('v_reserve', 'USAGE_CODE')}),
sg AS (SELECT {KEYS8}, count(DISTINCT REG_NO) AS NUM_CARS, sum(VEHICLE_VALUE) AS SUM_ASSURED, sum(GWP) AS GROSS_PREMIUM FROM mp GROUP BY ALL),
sc AS (SELECT {KEYS8}, count(DISTINCT CLAIM_ID) AS NUM_CLAIMS, sum(CLAIM_PMT) AS CLAIM_PMT FROM mc8 GROUP BY ALL),
sr AS (SELECT {KEYS8}, sum(UPR_END) AS UPR_END, sum(OSC_END) AS OSC_END, sum(LARC_RES_END) AS LARC_RES_END,
  sum(UPR_BEG) AS UPR_BEG, sum(OSC_BEG) AS OSC_BEG, sum(LARC_RES_BEG) AS LARC_RES_BEG FROM mr GROUP BY ALL)"""

_q("apply_mapping", MOF_VIEWS, MOF_CTES + f"""
SELECT POLICY_ID, COVERAGE_ID, TYPE_VEHICLE, VEHICLE_AGE, {KEYS8} FROM mp""")
_q("pnt11_gwp", MOF_VIEWS, MOF_CTES + f"""
SELECT {KEYS8}, NUM_CARS, CAST(SUM_ASSURED AS DECIMAL(38,4)) AS SUM_ASSURED, CAST(GROSS_PREMIUM AS DECIMAL(38,4)) AS GROSS_PREMIUM FROM sg""")
_q("pnt11_claims", MOF_VIEWS, MOF_CTES + f"""
SELECT {KEYS8}, NUM_CLAIMS, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT FROM sc""")
_RES = ["UPR_END", "OSC_END", "LARC_RES_END", "UPR_BEG", "OSC_BEG", "LARC_RES_BEG"]
_q("pnt11_reserves", MOF_VIEWS, MOF_CTES + f"""
SELECT {KEYS8}, {', '.join(f'CAST({c} AS DECIMAL(38,4)) AS {c}' for c in _RES)} FROM sr""")
_q("pnt11_opening", MOF_VIEWS, MOF_CTES + f"""
SELECT {KEYS8}, CAST(sum(UPR_END) AS DECIMAL(38,4)) AS UPR_BEG, CAST(sum(OSC_END) AS DECIMAL(38,4)) AS OSC_BEG,
  CAST(sum(LARC_RES_END) AS DECIMAL(38,4)) AS LARC_RES_BEG FROM mr GROUP BY ALL""")
_q("pnt11_combined", MOF_VIEWS, MOF_CTES + f""",
j AS (SELECT * FROM sc JOIN sg USING ({KEYS8}) JOIN sr USING ({KEYS8}))
SELECT {KEYS8}, CAST(NUM_CARS AS BIGINT) AS NUM_CARS, CAST(NUM_CLAIMS AS BIGINT) AS NUM_CLAIMS,
  CAST(SUM_ASSURED AS DECIMAL(38,4)) AS SUM_ASSURED, CAST(GROSS_PREMIUM AS DECIMAL(38,4)) AS GROSS_PREMIUM,
  CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT,
  {', '.join(f'CAST({c} AS DECIMAL(38,4)) AS {c}' for c in _RES)},
  CAST(UPR_END - UPR_BEG AS DECIMAL(38,4)) AS UPR_PERIOD, CAST(OSC_END - OSC_BEG AS DECIMAL(38,4)) AS OSC_PERIOD,
  CAST(LARC_RES_END - LARC_RES_BEG AS DECIMAL(38,4)) AS LARC_RES_PERIOD,
  CAST(UPR_END + OSC_END + LARC_RES_END AS DECIMAL(38,4)) AS RES_END, CAST(UPR_BEG + OSC_BEG + LARC_RES_BEG AS DECIMAL(38,4)) AS RES_BEG,
  CAST((UPR_END + OSC_END + LARC_RES_END) - (UPR_BEG + OSC_BEG + LARC_RES_BEG) AS DECIMAL(38,4)) AS RES_PERIOD
FROM j""")

# ---------------------------------------------------------------- ledger and statements
GL_CTES = """
glm_map AS (SELECT g.*, d.accountSM AS DEBIT_SM, d.accountBS AS DEBIT_BS, d.accountPL AS DEBIT_PL,
    c.accountSM AS CREDIT_SM, c.accountBS AS CREDIT_BS, c.accountPL AS CREDIT_PL
  FROM v_gl g LEFT JOIN v_account d ON g.DEBIT_ACC = d.code LEFT JOIN v_account c ON g.CREDIT_ACC = c.code
  WHERE g.INVOICE_DATE BETWEEN DATE '1997-01-01' AND DATE '1997-09-30'),
glm_map96 AS (SELECT g.*, d.accountSM AS DEBIT_SM, d.accountBS AS DEBIT_BS, d.accountPL AS DEBIT_PL
  FROM v_gl g LEFT JOIN v_account d ON g.DEBIT_ACC = d.code
  WHERE g.INVOICE_DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
tbp AS (SELECT DEBIT_ACC AS ACCOUNT, DEBIT_SM AS AG_CODE, DEBIT_BS AS BS_CODE, DEBIT_PL AS PL_CODE,
    sum(coalesce(DEBIT_AMT, 0)) AS PD, sum(coalesce(CREDIT_AMT, 0)) AS PC FROM glm_map
  WHERE DEBIT_ACC IS NOT NULL AND DEBIT_SM IS NOT NULL AND DEBIT_BS IS NOT NULL AND DEBIT_PL IS NOT NULL GROUP BY ALL),
tb96 AS (SELECT DEBIT_ACC AS ACCOUNT, DEBIT_SM AS AG_CODE, DEBIT_BS AS BS_CODE, DEBIT_PL AS PL_CODE,
    greatest(sum(DEBIT_AMT) - sum(CREDIT_AMT), 0) AS OD, greatest(sum(CREDIT_AMT) - sum(DEBIT_AMT), 0) AS OC FROM glm_map96
  WHERE DEBIT_ACC IS NOT NULL AND DEBIT_SM IS NOT NULL AND DEBIT_BS IS NOT NULL AND DEBIT_PL IS NOT NULL GROUP BY ALL),
tb AS (SELECT ACCOUNT, AG_CODE, BS_CODE, PL_CODE, 0 AS OD, 0 AS OC, PD, PC,
    greatest(PD - PC, 0) AS CD, greatest(PC - PD, 0) AS CC FROM tbp),
tbo AS (SELECT ACCOUNT, AG_CODE, BS_CODE, PL_CODE, coalesce(OD, 0) AS OD, coalesce(OC, 0) AS OC, coalesce(PD, 0) AS PD, coalesce(PC, 0) AS PC,
    greatest(coalesce(OD, 0) + coalesce(PD, 0) - coalesce(OC, 0) - coalesce(PC, 0), 0) AS CD,
    greatest(coalesce(OC, 0) + coalesce(PC, 0) - coalesce(OD, 0) - coalesce(PD, 0), 0) AS CC
  FROM tbp FULL OUTER JOIN tb96 USING (ACCOUNT, AG_CODE, BS_CODE, PL_CODE))"""
LEDGER_VIEWS = ("v_gl", "v_account", "t_bs", "t_pl01", "t_pl02", "t_cf01", "t_cf02", "t_duno")


def _tb_select(src: str) -> str:
    m = "DECIMAL(38,4)"
    return f"""SELECT ACCOUNT, AG_CODE, BS_CODE, PL_CODE, CAST(OD AS {m}) AS OPENING_DEBIT_AMOUNT, CAST(OC AS {m}) AS OPENING_CREDIT_AMOUNT,
  CAST(PD AS {m}) AS PERIOD_DEBIT_AMOUNT, CAST(PC AS {m}) AS PERIOD_CREDIT_AMOUNT, CAST(CD AS {m}) AS CLOSING_DEBIT_AMOUNT,
  CAST(CC AS {m}) AS CLOSING_CREDIT_AMOUNT, CAST(CD - CC AS {m}) AS CLOSING_NET_AMOUNT FROM {src}"""


_q("period_filter", ("v_gl",), """
SELECT * FROM v_gl WHERE INVOICE_DATE BETWEEN DATE '1997-07-01' AND DATE '1997-09-30'""")
_q("account_mapping", LEDGER_VIEWS, GL_CTES + "\nSELECT * FROM glm_map")
_q("gl_checks", ("v_gl",), """
SELECT count(*) FILTER (WHERE INVOICE_DATE < DATE '1997-01-01' OR INVOICE_DATE > DATE '1997-09-30') AS ROWS_OUTSIDE_PERIOD,
  bool_or(DEBIT_ACC = '911' OR CREDIT_ACC = '911') AS HAS_CLOSING_ACCOUNT FROM v_gl""")
_q("trial_balance", LEDGER_VIEWS, GL_CTES + "\n" + _tb_select("tb"))
_q("trial_balance_opening", LEDGER_VIEWS, GL_CTES + "\n" + _tb_select("tbo"))

# detail amounts written out line by line from the templates' formulas
STMT_CTES = GL_CTES + """,
bsd AS (SELECT BS_CODE AS code, sum(CD - CC) AS net, sum(CD) AS duno, sum(CC) AS duco FROM tb GROUP BY BS_CODE),
bsv AS (SELECT code, CASE WHEN TRY_CAST(code AS DOUBLE) IS NULL OR TRY_CAST(code AS DOUBLE) < 300 THEN net ELSE -net END AS amt FROM bsd),
b(c, amt) AS (SELECT code, amt FROM bsv),
ytd AS (SELECT * FROM glm_map WHERE INVOICE_DATE BETWEEN DATE '1997-01-01' AND DATE '1997-09-30'),
pco AS (SELECT CREDIT_PL AS code, sum(DEBIT_AMT - CREDIT_AMT) FILTER (WHERE INVOICE_DATE >= DATE '1997-07-01') AS cur,
    sum(DEBIT_AMT - CREDIT_AMT) AS acc FROM ytd WHERE DEBIT_SM = '911' GROUP BY CREDIT_PL),
pno AS (SELECT DEBIT_PL AS code, sum(DEBIT_AMT - CREDIT_AMT) FILTER (WHERE INVOICE_DATE >= DATE '1997-07-01') AS cur,
    sum(DEBIT_AMT - CREDIT_AMT) AS acc FROM ytd WHERE CREDIT_SM = '911' GROUP BY DEBIT_PL),
l01 AS (SELECT coalesce((SELECT cur FROM pco WHERE code = '01'), 0) AS cur, coalesce((SELECT acc FROM pco WHERE code = '01'), 0) AS acc),
l02 AS (SELECT coalesce((SELECT cur FROM pco WHERE code = '02'), 0) AS cur, coalesce((SELECT acc FROM pco WHERE code = '02'), 0) AS acc),
l11 AS (SELECT coalesce((SELECT cur FROM pno WHERE code = '11'), 0) AS cur, coalesce((SELECT acc FROM pno WHERE code = '11'), 0) AS acc),
l12 AS (SELECT -coalesce((SELECT cur FROM pno WHERE code = '12'), 0) AS cur, -coalesce((SELECT acc FROM pno WHERE code = '12'), 0) AS acc),
l10 AS (SELECT l01.cur + l02.cur AS cur, l01.acc + l02.acc AS acc FROM l01, l02),
l20 AS (SELECT l11.cur + l12.cur AS cur, l11.acc + l12.acc AS acc FROM l11, l12),
l50 AS (SELECT l10.cur - l20.cur AS cur, l10.acc - l20.acc AS acc FROM l10, l20),
pl01 AS (SELECT '01' AS code, cur, acc FROM l01 UNION ALL SELECT '02', cur, acc FROM l02 UNION ALL SELECT '10', cur, acc FROM l10
  UNION ALL SELECT '11', cur, acc FROM l11 UNION ALL SELECT '12', cur, acc FROM l12 UNION ALL SELECT '20', cur, acc FROM l20
  UNION ALL SELECT '50', cur, acc FROM l50 UNION ALL SELECT '60', 0, 0 UNION ALL SELECT '70', cur, acc FROM l50),
cf AS (SELECT CREDIT_SM AS code, sum(greatest(DEBIT_AMT - CREDIT_AMT, 0)) AS no_amt, sum(-greatest(CREDIT_AMT - DEBIT_AMT, 0)) AS co_amt
  FROM ytd WHERE substr(DEBIT_SM, 1, 2) = '11' GROUP BY CREDIT_SM)"""


def _stmt(template: str, values: str, cols: str) -> str:
    return f"""
SELECT t.{cols.replace(', ', ', t.')}, {values} FROM {template} t"""


def _money(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS DECIMAL(38,4))"


_q("balance_sheet", LEDGER_VIEWS, STMT_CTES + """,
v AS (SELECT
  coalesce((SELECT amt FROM b WHERE c = '110'), 0) AS a110, coalesce((SELECT amt FROM b WHERE c = '120'), 0) AS a120,
  coalesce((SELECT amt FROM b WHERE c = '130'), 0) AS a130, coalesce((SELECT amt FROM b WHERE c = '220'), 0) AS a220,
  coalesce((SELECT amt FROM b WHERE c = '310'), 0) AS a310, coalesce((SELECT amt FROM b WHERE c = '320'), 0) AS a320,
  coalesce((SELECT amt FROM b WHERE c = '410'), 0) AS a410, coalesce((SELECT amt FROM b WHERE c = '420'), 0) AS a420),
w AS (SELECT *, a110 + a120 + a130 AS a100, a220 AS a200, a310 + a320 AS a300, a410 + a420 AS a400 FROM v),
x AS (SELECT *, a100 + a200 AS a270, a300 + a400 AS a440 FROM w)
SELECT t.lineCode, t.lineName, t.code, t.noteRef, CAST(CASE t.code
  WHEN '100' THEN a100 WHEN '110' THEN a110 WHEN '120' THEN a120 WHEN '130' THEN a130 WHEN '200' THEN a200 WHEN '220' THEN a220
  WHEN '270' THEN a270 WHEN '300' THEN a300 WHEN '310' THEN a310 WHEN '320' THEN a320 WHEN '400' THEN a400 WHEN '410' THEN a410
  WHEN '420' THEN a420 WHEN '440' THEN a440 END AS DECIMAL(38,4)) AS CURRENT_AMOUNT FROM t_bs t, x""")

_q("duno_duco", LEDGER_VIEWS, STMT_CTES + """
SELECT t.lineCode, t.lineName, t.code, t.noteRef, CAST(CASE t.code
  WHEN '900' THEN coalesce((SELECT duno FROM bsd WHERE code = '130'), 0) - (-coalesce((SELECT duco FROM bsd WHERE code = '310'), 0))
  WHEN '901' THEN coalesce((SELECT duno FROM bsd WHERE code = '110'), 0) + coalesce((SELECT duno FROM bsd WHERE code = '120'), 0)
  WHEN '902' THEN -(-coalesce((SELECT duco FROM bsd WHERE code = '420'), 0)) END AS DECIMAL(38,4)) AS CURRENT_AMOUNT FROM t_duno t""")

_q("profit_loss", LEDGER_VIEWS, STMT_CTES + """
SELECT t.lineCode, t.lineName, t.code, t.noteRef, CAST(p.cur AS DECIMAL(38,4)) AS CURRENT_AMOUNT, CAST(p.acc AS DECIMAL(38,4)) AS ACCUMULATED_AMOUNT
FROM t_pl01 t JOIN pl01 p ON t.code = p.code""")

_q("profit_loss_summary", LEDGER_VIEWS, STMT_CTES + """,
q AS (SELECT (SELECT cur FROM pl01 WHERE code = '50') AS c1, (SELECT acc FROM pl01 WHERE code = '50') AS a1,
  (SELECT cur FROM pl01 WHERE code = '10') - (SELECT cur FROM pl01 WHERE code = '20') AS c2,
  (SELECT acc FROM pl01 WHERE code = '10') - (SELECT acc FROM pl01 WHERE code = '20') AS a2)
SELECT t.lineCode, t.lineName, t.code,
  CAST(CASE t.code WHEN '1' THEN c1 WHEN '2' THEN c2 ELSE c1 + c2 END AS DECIMAL(38,4)) AS CURRENT_AMOUNT,
  CAST(CASE t.code WHEN '1' THEN a1 WHEN '2' THEN a2 ELSE a1 + a2 END AS DECIMAL(38,4)) AS ACCUMULATED_AMOUNT
FROM t_pl02 t, q""")

_q("cash_flow", LEDGER_VIEWS, STMT_CTES + """,
q AS (SELECT coalesce((SELECT no_amt FROM cf WHERE code = '131'), 0) AS v01, coalesce((SELECT co_amt FROM cf WHERE code = '331'), 0) AS v02,
  coalesce((SELECT no_amt FROM cf WHERE code = '511'), 0) - coalesce((SELECT no_amt FROM cf WHERE code = '515'), 0) AS v03)
SELECT t.lineCode, t.lineName, t.code, t.noteRef,
  CAST(CASE t.code WHEN '01' THEN v01 WHEN '02' THEN v02 WHEN '03' THEN v03 ELSE v01 + v02 + v03 END AS DECIMAL(38,4)) AS CURRENT_AMOUNT
FROM t_cf01 t, q""")

_q("cash_flow_indirect", LEDGER_VIEWS, STMT_CTES + """,
q AS (SELECT (SELECT cur FROM pl01 WHERE code = '50') AS v01, coalesce((SELECT co_amt FROM cf WHERE code = '334'), 0) AS v02)
SELECT t.lineCode, t.lineName, t.code, t.noteRef,
  CAST(CASE t.code WHEN '01' THEN v01 WHEN '02' THEN v02 ELSE v01 + v02 END AS DECIMAL(38,4)) AS CURRENT_AMOUNT
FROM t_cf02 t, q""")


# ---------------------------------------------------------------- text, periods, quality, ingest
PLATE_PATTERN, FOREIGN_PLATE_PATTERN = r"^[A-Z0-9]{1,2}[A-Z]{1,3}\d{3,6}[A-Z]?$", r"^\d{5}(NN|NG|QT|CV)\d{2}$"
from riskframe.plans.quality import DIRTY_SETTINGS, EXPECTED_COLUMNS, MOF_GWP_SETTINGS  # noqa: E402

# v_dirty holds ASCII text only, where NFKC is the identity, so the oracle needs no NFKC.
_q("reg_no_standardized", ("v_dirty",), """,
r AS (SELECT event_id, REG_NO, regexp_replace(regexp_replace(upper(regexp_replace(REG_NO, '^\\s+|\\s+$', '', 'g')),
    '[-‐‑–‒—―.]', '', 'g'), '\\s+', '', 'g') AS x FROM v_dirty)
SELECT event_id, REG_NO, CASE WHEN REG_NO IS NULL OR regexp_replace(REG_NO, '^\\s+|\\s+$', '', 'g') = '' THEN 'ERROR_REG_NO'
  WHEN regexp_full_match(x, '""" + PLATE_PATTERN + """') OR regexp_full_match(x, '""" + FOREIGN_PLATE_PATTERN + """') THEN x
  ELSE 'ERROR_REG_NO' END AS REG_NO_STD FROM r""")

_q("coverage_prefix", ("v_dirty",), """
SELECT event_id, COVERAGE_ID, CASE WHEN regexp_matches(COVERAGE_ID, '^0.') THEN COVERAGE_ID ELSE '0' || COVERAGE_ID END AS COVERAGE_ID_STD FROM v_dirty""")

_q("report_period", ("v_gl",), """,
ym AS (SELECT DISTINCT CAST(year(INVOICE_DATE) AS INT) AS y, CAST(month(INVOICE_DATE) AS INT) AS m FROM v_gl),
yq AS (SELECT y, m, CAST(floor((m + 2) / 3) AS INT) AS q FROM ym)
SELECT y AS REPORT_YEAR, m AS REPORT_MONTH, make_date(y, m, 1) AS MONTH_START, CAST(last_day(make_date(y, m, 1)) AS DATE) AS MONTH_END,
  q AS REPORT_QUARTER, make_date(y, 3 * q - 2, 1) AS QUARTER_START, CAST(last_day(make_date(y, 3 * q, 1)) AS DATE) AS QUARTER_END,
  make_date(y, 1, 1) AS YTD_START, make_date(y, 12, 31) AS YEAR_END FROM yq""")


def _vals(c: str) -> str:
    return f"list_filter(list_transform(string_split(trim(CAST({c} AS VARCHAR)), ','), lambda x: trim(x)), lambda x: x <> '')"


def _fmt_ok(c: str, fmt: str) -> str:
    present = f"(CAST({c} AS VARCHAR) IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')"
    return (f"coalesce(bool_and(CASE WHEN {present} THEN list_bool_and(list_transform({_vals(c)}, "
            f"lambda x: try_strptime(x, '{fmt}') IS NOT NULL)) END), false)")


def _validate_sql(settings=DIRTY_SETTINGS, view="v_dirty",
                  present=("event_id", "CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"),
                  dup_keys=(("CLAIM_ID",),), info_only=True, unknown="always") -> str:
    """C9 written per column from the settings: INFO columns only, unknown check always, the
    given unique keys (standard names) reported on each of their columns."""
    std = {s.standard_name: s.import_name for s in settings if s.import_name in present}
    keys = [k for k in dup_keys if all(c in std for c in k)]
    parts = []
    for s in settings:
        if info_only and s.variable_type != "INFO":
            continue
        if s.import_name not in present:
            parts.append(f"""SELECT '{s.standard_name}' AS COLUMN, CAST(NULL AS VARCHAR) AS TYPE, CAST(NULL AS BIGINT) AS MISSING_COUNT,
  CAST(NULL AS DOUBLE) AS MISSING_PCT, CAST(NULL AS BIGINT) AS UNKNOWN_COUNT, CAST(NULL AS DOUBLE) AS UNKNOWN_PCT,
  CAST(NULL AS BOOLEAN) AS TYPE_OK, CAST(NULL AS BOOLEAN) AS MISSING_OK, CAST(NULL AS BOOLEAN) AS UNKNOWN_OK, CAST(NULL AS BOOLEAN) AS DUP_OK,
  CAST(NULL AS DOUBLE) AS MIN_VALUE, CAST(NULL AS DOUBLE) AS MAX_VALUE, CAST(NULL AS DOUBLE) AS AVG_VALUE, 'Column not found' AS "CHECK\"""")
            continue
        c = s.import_name
        v = f"CAST({c} AS VARCHAR)"
        numeric = s.data_type in ("Double", "Integer")
        if s.data_type == "Date":
            has = f"(count(*) FILTER (WHERE {v} IS NOT NULL AND len({_vals(c)}) > 0) > 0)"
            type_ok = has + " AND (" + " OR ".join(_fmt_ok(c, f) for f in ACCEPTED_FORMATS) + ")"
        elif numeric:
            type_ok = f"(count(*) FILTER (WHERE {v} IS NOT NULL AND {v} <> '' AND TRY_CAST({v} AS DOUBLE) IS NULL) = 0 AND count(*) > 0)"
        else:
            type_ok = "(count(*) > 0)"
        miss = f"count(*) FILTER (WHERE {c} IS NULL)"
        unk = f"count(*) FILTER (WHERE starts_with(coalesce({v}, 'None'), 'Unknown'))"
        miss_ok = "true" if s.allow_null else f"({miss} = 0)"
        unk_ok = "true" if unknown == "never" or (unknown == "if_not_null_allowed" and s.allow_null) else f"({unk} = 0)"
        dup_ok = " AND ".join(
            ["true"] + [f"(count(*) = count(DISTINCT {{{', '.join(f'{chr(39)}k{i}{chr(39)}: {std[kc]}' for i, kc in enumerate(k))}}}))"
                        for k in keys if s.standard_name in k])
        num = lambda f: f"{f}(TRY_CAST({v} AS DOUBLE))" if numeric else "CAST(NULL AS DOUBLE)"
        avg = round_sql(f"avg(TRY_CAST({v} AS DOUBLE))", 6) if numeric else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{s.standard_name}' AS COLUMN, '{s.data_type}' AS TYPE, {miss} AS MISSING_COUNT,
  {round_sql(f"{miss} * 100.0 / count(*)", 2)} AS MISSING_PCT, {unk} AS UNKNOWN_COUNT, {round_sql(f"{unk} * 100.0 / count(*)", 2)} AS UNKNOWN_PCT,
  {type_ok} AS TYPE_OK, {miss_ok} AS MISSING_OK, {unk_ok} AS UNKNOWN_OK, ({dup_ok}) AS DUP_OK,
  {num('min')} AS MIN_VALUE, {num('max')} AS MAX_VALUE, {avg} AS AVG_VALUE,
  CASE WHEN {type_ok} AND {miss_ok} AND ({dup_ok}) AND {unk_ok} THEN 'Pass' ELSE 'Fail' END AS "CHECK" FROM {view}""")
    return "\nUNION ALL\n".join(parts)


def _status_sql(report: str, with_unknown: bool) -> str:
    fams = [("type", "TYPE_OK", "wrong type"), ("missing", "MISSING_OK", "missing")]
    if with_unknown:
        fams.append(("unknown", "UNKNOWN_OK", "unknown"))
    fams.append(("duplicate", "DUP_OK", "duplicate"))
    cnt = {n: f"count(*) FILTER (WHERE {c} = false)" for n, c, _ in fams}
    cols = {n: f"""coalesce(string_agg("COLUMN", ', ' ORDER BY "COLUMN") FILTER (WHERE {c} = false), '')""" for n, c, _ in fams}
    first = "CASE " + " ".join(f"WHEN {cnt[n]} > 0 THEN '{n}'" for n, _, _ in fams) + " END"
    msg = ("CASE " + " ".join(f"WHEN {cnt[n]} > 0 THEN 'Data validation failed! Due to {w}: ' || {cols[n]}"
                              for n, _, w in fams) + " ELSE 'Data validation completed successfully' END")
    ok = " AND ".join(f"{cnt[n]} = 0" for n, _, _ in fams)
    counts = ", ".join(f"{cnt[n]} AS {n.upper()}_ERRORS" for n, _, _ in fams)
    return f"""
SELECT ({ok}) AS STATUS, {first} AS FIRST_FAILURE, {msg} AS MESSAGE, {counts},
  count(*) FILTER (WHERE "CHECK" = 'Column not found') AS COLUMNS_NOT_FOUND FROM ({report}) rep"""


_q("validate_columns", ("v_dirty",), _validate_sql())
_q("validate_status", ("v_dirty",), _status_sql(_validate_sql(), False))
_MOF_ARGS = dict(settings=MOF_GWP_SETTINGS, view="v_policy",
                 present=("POLICY_ID", "CERTIFICATE_ID", "START_DATE", "EXPIRY_DATE", "GWP", "VEHICLE_AGE",
                          "TYPE_VEHICLE", "USAGE_CODE"),
                 dup_keys=(("POLICY_ID", "CERTIFICATE_ID"),))
_q("validate_mof_gwp", ("v_policy",), _validate_sql(**_MOF_ARGS))
_q("validate_mof_status", ("v_policy",), _status_sql(_validate_sql(**_MOF_ARGS), True))

_dates = []
for _col, _src in (("DATE_TXT", "v_dirty"), ("START_DATE_TXT", "(SELECT strftime(START_DATE, '%Y-%m-%d') AS START_DATE_TXT FROM v_policy)")):
    for _j, _f in enumerate(ACCEPTED_FORMATS):
        _dates.append(f"SELECT '{_col}' AS COLUMN, {_j + 1} AS FORMAT_NO, '{_f}' AS FORMAT, {_fmt_ok(_col, _f)} AS PARSES_ALL FROM {_src}")
_q("validate_dates", ("v_dirty", "v_policy"), "\n" + "\nUNION ALL\n".join(_dates))

_q("validate_duplicates", ("v_claim",), """,
c AS (SELECT *, split_part(CLAIM_ID, '-', 1) || '-' || split_part(CLAIM_ID, '-', 2) AS CLAIM_KEY2 FROM v_claim)
SELECT 'CLAIM_ID' AS KEY_COLUMNS, count(*) AS NUM_ROWS, count(DISTINCT {'k': CLAIM_ID}) AS DISTINCT_KEYS,
  count(*) - count(DISTINCT {'k': CLAIM_ID}) AS DUPLICATE_ROWS, count(*) = count(DISTINCT {'k': CLAIM_ID}) AS DUP_OK FROM c
UNION ALL
SELECT 'CLAIM_KEY2', count(*), count(DISTINCT {'k': CLAIM_KEY2}), count(*) - count(DISTINCT {'k': CLAIM_KEY2}),
  count(*) = count(DISTINCT {'k': CLAIM_KEY2}) FROM c
UNION ALL
SELECT 'POLICY_ID,CERTIFICATE_ID', count(*), count(DISTINCT {'a': POLICY_ID, 'b': CERTIFICATE_ID}),
  count(*) - count(DISTINCT {'a': POLICY_ID, 'b': CERTIFICATE_ID}), count(*) = count(DISTINCT {'a': POLICY_ID, 'b': CERTIFICATE_ID}) FROM c""")

_cols = ["event_id", "CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"]
_q("profile_table", ("v_dirty",), f"""
SELECT count(*) AS NUM_ROWS, {len(_cols)} AS NUM_COLUMNS, '{",".join(sorted(set(EXPECTED_COLUMNS) - set(_cols)))}' AS MISSING_COLUMNS,
  '{",".join(sorted(set(_cols) - set(EXPECTED_COLUMNS)))}' AS EXTRA_COLUMNS,
  count(*) FILTER (WHERE {' AND '.join(f'{c} IS NULL' for c in _cols)}) AS EMPTY_ROWS FROM v_dirty""")

_MAP_SELECT = ", ".join(f"{s.import_name} AS {s.standard_name}" for s in DIRTY_SETTINGS if s.import_name in _cols)
_q("map_columns", ("v_dirty",), f"\nSELECT {_MAP_SELECT} FROM v_dirty")


def _multi(expr: str, fmts) -> str:
    return "coalesce(" + ", ".join(f"try_strptime(trim({expr}), '{f}')" for f in fmts) + ")"


_q("convert_types", ("v_dirty",), f""",
m AS (SELECT {_MAP_SELECT} FROM v_dirty)
SELECT CAST(TRY_CAST(CAST(CLAIM_ID AS VARCHAR) AS DOUBLE) AS BIGINT) AS CLAIM_ID, coalesce(SALES_CHANNEL, 'Unknown') AS SALES_CHANNEL,
  TRY_CAST(GWP AS DOUBLE) AS GWP, CAST({_multi('START_DATE', IMPORT_FORMATS)} AS DATE) AS START_DATE,
  coalesce(REG_NO, 'Unknown') AS REG_NO,
  CASE WHEN regexp_matches(coalesce(COVERAGE_ID, 'Unknown'), '^0.') THEN coalesce(COVERAGE_ID, 'Unknown') ELSE '0' || coalesce(COVERAGE_ID, 'Unknown') END AS COVERAGE_ID
FROM m""")

_q("date_multi_format", ("v_dirty", "v_policy"), f""",
p AS (SELECT POLICY_ID, strftime(START_DATE, '%-d/%-m/%Y') AS START_TXT FROM v_policy)
SELECT CAST(event_id AS VARCHAR) AS ROW_ID, DATE_TXT AS RAW, CAST({_multi('DATE_TXT', IMPORT_FORMATS)} AS DATE) AS PARSED FROM v_dirty
UNION ALL
SELECT POLICY_ID, START_TXT, CAST(try_strptime(trim(START_TXT), '%d/%m/%Y') AS DATE) FROM p""")

_int_cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_q("narrow_integers", (), "\n" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS COLUMN, CAST(min({c}) AS BIGINT) AS MIN_VALUE, CAST(max({c}) AS BIGINT) AS MAX_VALUE,
  CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
    WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END AS NARROW_TYPE FROM lineitem""" for c in _int_cols))

_q("low_cardinality", ("v_dirty",), "\n" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS COLUMN, count(DISTINCT {c}) AS DISTINCT_VALUES, count(*) AS NUM_ROWS,
  (count(DISTINCT {c}) * 1.0 / count(*)) < 0.5 AS IS_CATEGORICAL FROM v_dirty""" for c in ["CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"]))

_q("clean_table", ("v_dirty",), f"""
SELECT event_id, CHANNEL, TRY_CAST(AMOUNT_TXT AS DOUBLE) AS AMOUNT_TXT, {_multi('DATE_TXT', IMPORT_FORMATS)} AS DATE_TXT,
  REG_NO, TRY_CAST(COVERAGE_ID AS DOUBLE) AS COVERAGE_ID FROM v_dirty""")

_q("snapshot_diff", ("v_policy",), """,
older AS (SELECT * REPLACE (CAST(CASE WHEN CAST(POLICY_ID AS BIGINT) % 9 = 0 THEN VEHICLE_AGE + 1 ELSE VEHICLE_AGE END AS INT) AS VEHICLE_AGE) FROM v_policy WHERE CAST(POLICY_ID AS BIGINT) % 11 <> 0)
(SELECT * REPLACE (CAST(VEHICLE_VALUE AS DECIMAL(38,4)) AS VEHICLE_VALUE), 'new' AS SIDE
 FROM (SELECT * FROM v_policy EXCEPT ALL SELECT * FROM older))
UNION ALL
(SELECT * REPLACE (CAST(VEHICLE_VALUE AS DECIMAL(38,4)) AS VEHICLE_VALUE), 'old' AS SIDE
 FROM (SELECT * FROM older EXCEPT ALL SELECT * FROM v_policy))""")

_q("union_parts", (), """
SELECT c_custkey AS PARTY_KEY, c_name AS NAME, c_nationkey AS NATION_KEY, c_acctbal AS BALANCE, c_mktsegment AS SEGMENT, 'DATA_CUSTOMER' AS SOURCE FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'DATA_SUPPLIER' FROM supplier""")

_q("profile_parts", (), "\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}.parquet' AS FILE_NAME, count(*) AS NUM_ROWS, count(*) > 1 AS HAS_DATA, "
    f"(SELECT count(*) FROM duckdb_columns() WHERE table_name = '{t}') AS NUM_COLUMNS, "
    f"(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() "
    f"WHERE table_name = '{t}' AND column_index <= 10) AS FIRST_COLUMNS FROM {t}"
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]))

_q("claims_reconcile", ("v_policy", "v_claim"), EXPOSURE_CTES + "," + CLAIM_CTES + SEQ_CTES + """,
comb AS (SELECT py.*, cg.CLAIM_PMT, s.pin, s.pout, s.nin, s.nout FROM py
  LEFT JOIN cg ON py.POLICY_ID = cg.POLICY_ID AND py.CERTIFICATE_ID = cg.CERTIFICATE_ID AND py.CL_YEAR = cg.LD_YEAR
  LEFT JOIN (SELECT POLICY_ID, CERTIFICATE_ID, LD_YEAR, START_SEQ, END_SEQ, sum(CLAIM_PMT) FILTER (WHERE IN_SEQ) AS pin,
               sum(CLAIM_PMT) FILTER (WHERE NOT IN_SEQ) AS pout, count(*) FILTER (WHERE IN_SEQ) AS nin,
               count(*) FILTER (WHERE NOT IN_SEQ) AS nout FROM cseq GROUP BY ALL) s
    ON py.POLICY_ID = s.POLICY_ID AND py.CERTIFICATE_ID = s.CERTIFICATE_ID AND py.CL_YEAR = s.LD_YEAR
   AND py.START_SEQ = s.START_SEQ AND py.END_SEQ = s.END_SEQ),
un AS (SELECT * FROM cg WHERE POLICY_ID NOT IN (SELECT POLICY_ID FROM py))
SELECT metric, CAST(value AS DECIMAL(38,4)) AS value FROM (
  SELECT 'claim_negative' AS metric, (SELECT sum(CLAIM_PMT) FROM v_claim WHERE CLAIM_PMT < 0) AS value
  UNION ALL SELECT 'claim_grouped', (SELECT sum(CLAIM_PMT) FROM cg)
  UNION ALL SELECT 'rows_grouped', (SELECT count(*) FROM cg)
  UNION ALL SELECT 'claim_combined', (SELECT sum(CLAIM_PMT) FROM comb)
  UNION ALL SELECT 'claim_in_sequence', (SELECT sum(pin) FROM comb)
  UNION ALL SELECT 'claim_not_in_sequence', (SELECT sum(pout) FROM comb)
  UNION ALL SELECT 'num_in_sequence', (SELECT sum(coalesce(nin, 0)) FROM comb)
  UNION ALL SELECT 'num_not_in_sequence', (SELECT sum(coalesce(nout, 0)) FROM comb)
  UNION ALL SELECT 'premium_in_year', (SELECT sum(EXPOSURE_PREM) FROM py WHERE CL_YEAR = 1997)
  UNION ALL SELECT 'premium_out_of_year', (SELECT sum(EXPOSURE_PREM) FROM py WHERE CL_YEAR <> 1997)
  UNION ALL SELECT 'claim_unmatched', (SELECT sum(CLAIM_PMT) FROM un)
  UNION ALL SELECT 'rows_unmatched', (SELECT count(*) FROM un)
  UNION ALL SELECT 'dup_gwp', (SELECT count(*) - count(DISTINCT {'a': POLICY_ID, 'b': CERTIFICATE_ID, 'c': CL_YEAR}) FROM py)
  UNION ALL SELECT 'dup_claim', (SELECT count(*) - count(DISTINCT {'a': POLICY_ID, 'b': CERTIFICATE_ID, 'c': year(OCCURENCE_DATE)})
                                 FROM v_claim WHERE CLAIM_PMT >= 0)) t""")

_q("coverage_codes", (), r"""
s AS (SELECT 'NUM_CLAIMS_AC' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS standard_name, 'NUM_CLAIMS_' || n_name AS import_name,
    'VARS_AC' AS variable_type, s_suppkey AS ordinal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT regexp_extract(standard_name, '(AC\d+)', 1) AS code, regexp_replace(import_name, '^(NUM_CLAIMS_|CLAIM_PMT_)', '') AS description,
    ordinal FROM s WHERE variable_type = 'VARS_AC')
SELECT code, arg_max(description, ordinal) AS description FROM c WHERE code <> '' AND description <> code GROUP BY code""")


def _complete_text(b: str) -> str:
    return f"""
SELECT 1997 AS VAR_YEAR, '001: TYPE_VEHICLE & USAGE_CODE' AS VAR_NAME_CODE,
  'TYPE_VEHICLE' AS VAR_NAME1, 'USAGE_CODE' AS VAR_NAME2, g.d1 AS VAR_DETAIL1, g.d2 AS VAR_DETAIL2,
  coalesce(r.NUM_POLS, 0) AS NUM_POLS, coalesce(r.NUM_CLAIMS, 0) AS NUM_CLAIMS, coalesce(r.EXPOSURE_YEAR, 0.0) AS EXPOSURE_YEAR,
  coalesce(r.EXPOSURE_PREM, CAST(0 AS DECIMAL(38,4))) AS EXPOSURE_PREM, coalesce(r.CLAIM_PMT, CAST(0 AS DECIMAL(38,0))) AS CLAIM_PMT,
  coalesce(r.FREQUENCY, 0.0) AS FREQUENCY, coalesce(r.SEVERITY, 0.0) AS SEVERITY, coalesce(r.AVG_PREMIUM, 0.0) AS AVG_PREMIUM,
  coalesce(r.PURE_PREMIUM, 0.0) AS PURE_PREMIUM, coalesce(r.LOSS_RATIO, 0.0) AS LOSS_RATIO, coalesce(r."GWP_%", 0.0) AS "GWP_%",
  coalesce(r.SUM_ASSURED, CAST(0 AS DECIMAL(38,4))) AS SUM_ASSURED, coalesce(r.AVG_SUM_ASSURED, 0.0) AS AVG_SUM_ASSURED
FROM (SELECT a.d1, b.d2 FROM (SELECT DISTINCT TYPE_VEHICLE AS d1 FROM glm WHERE TYPE_VEHICLE IS NOT NULL) a,
      (SELECT DISTINCT USAGE_CODE AS d2 FROM glm WHERE USAGE_CODE IS NOT NULL) b) g
LEFT JOIN ({b}) r ON r.VAR_DETAIL1 = g.d1 AND r.VAR_DETAIL2 = g.d2"""


_glm("nway_complete_text", [("TYPE_VEHICLE", "USAGE_CODE")], [1997], wrap=_complete_text)

_q("pnt11_combined_prior", MOF_VIEWS, MOF_CTES + f""",
sr1 AS (SELECT {KEYS8}, sum(UPR_END) AS UPR_END, sum(OSC_END) AS OSC_END, sum(LARC_RES_END) AS LARC_RES_END FROM mr GROUP BY ALL),
op AS (SELECT {KEYS8}, sum(UPR_END) AS UPR_BEG, sum(OSC_END) AS OSC_BEG, sum(LARC_RES_END) AS LARC_RES_BEG FROM mr GROUP BY ALL),
j AS (SELECT * FROM sc JOIN sg USING ({KEYS8}) JOIN sr1 USING ({KEYS8}) JOIN op USING ({KEYS8}))
SELECT {KEYS8}, CAST(NUM_CARS AS BIGINT) AS NUM_CARS, CAST(NUM_CLAIMS AS BIGINT) AS NUM_CLAIMS,
  CAST(SUM_ASSURED AS DECIMAL(38,4)) AS SUM_ASSURED, CAST(GROSS_PREMIUM AS DECIMAL(38,4)) AS GROSS_PREMIUM,
  CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT,
  {', '.join(f'CAST({c} AS DECIMAL(38,4)) AS {c}' for c in _RES)},
  CAST(UPR_END - UPR_BEG AS DECIMAL(38,4)) AS UPR_PERIOD, CAST(OSC_END - OSC_BEG AS DECIMAL(38,4)) AS OSC_PERIOD,
  CAST(LARC_RES_END - LARC_RES_BEG AS DECIMAL(38,4)) AS LARC_RES_PERIOD,
  CAST(UPR_END + OSC_END + LARC_RES_END AS DECIMAL(38,4)) AS RES_END, CAST(UPR_BEG + OSC_BEG + LARC_RES_BEG AS DECIMAL(38,4)) AS RES_BEG,
  CAST((UPR_END + OSC_END + LARC_RES_END) - (UPR_BEG + OSC_BEG + LARC_RES_BEG) AS DECIMAL(38,4)) AS RES_PERIOD
FROM j""")


# ---------------------------------------------------------------- requests, files, other profiles
_MOF_PRESENT = tuple(s.import_name for s in MOF_GWP_SETTINGS)
_q("validate_glm_gwp", ("v_policy",), _validate_sql(MOF_GWP_SETTINGS, "v_policy", _MOF_PRESENT, (("POLICY_ID",),), info_only=False, unknown="never"))
_q("validate_glm_cmb", ("v_dirty",), _validate_sql(dup_keys=(), unknown="if_not_null_allowed"))
_q("validate_mof_reserve", ("v_policy",), _validate_sql(MOF_GWP_SETTINGS, "v_policy", _MOF_PRESENT, ()))
_q("claims_prepared", ("v_claim",), """
SELECT CLAIM_ID, POLICY_ID, CERTIFICATE_ID, OCCURENCE_DATE, CAST(CLAIM_PMT AS DOUBLE) AS CLAIM_COST, CAST(year(OCCURENCE_DATE) AS INT) AS LD_YEAR
FROM v_claim WHERE year(OCCURENCE_DATE) = 1997""")
_glm("rating_request", [("VEHICLE_AGE_GROUP", "TYPE_VEHICLE")], [1996, 1997])
_glm("nway_health", [("USAGE_CODE",), ("PROVINCE",)], [1997],
     wrap=lambda b: b.replace("count(DISTINCT POLICY_ID)", "count(DISTINCT CERTIFICATE_ID)").replace(
         "PARTITION BY POLICY_ID ORDER BY CAL_YEAR", "PARTITION BY CERTIFICATE_ID ORDER BY CAL_YEAR, USAGE_CODE, PROVINCE, EXPOSURE_YEAR, EXPOSURE_PREM, VEHICLE_VALUE"))
_q("read_columns", (), "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
PREVIEW = {  # JSON of a row, as the standard writes it; doubles always have a decimal point
    "orders": "o_orderkey o_custkey o_orderstatus:t o_totalprice:d o_orderdate:m o_orderpriority:t",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:t l_linestatus:t l_shipdate:m",
    "customer": "c_custkey c_name:t c_nationkey c_acctbal:d c_mktsegment:t", "part": "p_partkey p_name:t p_brand:t p_type:t p_size p_retailprice:d",
    "supplier": "s_suppkey s_name:t s_nationkey s_acctbal:d", "nation": "n_nationkey n_name:t n_regionkey", "region": "r_regionkey r_name:t",
}


def _json(columns: str) -> str:
    def value(name: str, kind: str) -> str:
        if kind == "t":
            return f"'\"' || {name} || '\"'"
        return f"'\"' || strftime({name}, '%Y-%m-%dT%H:%M:%S.000') || '\"'" if kind == "m" else f"CAST({name} AS VARCHAR)"

    pairs = [(n, k) for n, _, k in (c.partition(":") for c in columns.split())]
    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {value(n, k)}" for n, k in pairs) + " || '}'"


_q("preview_parts", (), "\nUNION ALL\n".join(
    f"(SELECT '{t}.parquet' AS FILE_NAME, i - 1 AS ROW_INDEX, {_json(c)} AS ROW_JSON FROM (SELECT *, row_number() OVER () AS i FROM {t}) WHERE i <= 3)" for t, c in PREVIEW.items()))
_q("two_header_import", (), "SELECT CAST(s_suppkey AS VARCHAR) AS STD_PARTY_ID, s_name AS STD_PARTY_NAME, CAST(s_nationkey AS VARCHAR) AS STD_NATION FROM supplier")
_q("number_edges", ("v_dirty",), """
SELECT event_id, CASE event_id % 8 WHEN 5 THEN 7 WHEN 6 THEN -25 END::BIGINT AS I,
  CASE event_id % 8 WHEN 2 THEN 1e30 WHEN 5 THEN 7 WHEN 6 THEN -25 END::DOUBLE AS D FROM v_dirty""")
_q("date_all_formats", ("v_policy",), """,
o AS (SELECT POLICY_ID, START_DATE, f, CASE WHEN f IN (1, 2, 12) THEN '-' WHEN f IN (3, 4, 11) THEN '/' WHEN f IN (6, 7) THEN '.' END AS sep, f IN (2, 4, 7, 12) AS mdy
  FROM (SELECT *, CAST(POLICY_ID AS BIGINT) % 13 AS f FROM v_policy)),
e AS (SELECT sep, count(*) FILTER (WHERE mdy AND day(START_DATE) > 12) > count(*) FILTER (WHERE NOT mdy AND day(START_DATE) > 12) AS month_first FROM o WHERE sep IS NOT NULL GROUP BY sep)
SELECT POLICY_ID, CASE WHEN o.sep IS NULL OR day(START_DATE) > 12 OR month_first = mdy THEN START_DATE ELSE make_date(year(START_DATE), day(START_DATE), month(START_DATE)) END AS PARSED
FROM o LEFT JOIN e ON o.sep = e.sep""")
_q("date_columns", ("v_policy",), "SELECT POLICY_ID, " + ", ".join(f"START_DATE AS D{i:02d}" for i in range(13)) + " FROM v_policy")
_q("date_orders", ("v_policy", "v_dirty"), """
SELECT 'START_TXT' AS COLUMN, '/' AS SEPARATOR, count(*) AS NUM_VALUES, 0::BIGINT AS DAY_FIRST, count(*) FILTER (WHERE day(START_DATE) > 12) AS MONTH_FIRST,
  count(*) FILTER (WHERE day(START_DATE) <= 12) AS AMBIGUOUS, 0::BIGINT AS NO_DATE, 'MDY' AS DATE_ORDER FROM v_policy
UNION ALL SELECT 'EXPIRY_TXT', '.', count(*), count(*) FILTER (WHERE day(EXPIRY_DATE) > 12), 0, count(*) FILTER (WHERE day(EXPIRY_DATE) <= 12), 0, 'DMY' FROM v_policy
UNION ALL SELECT 'DATE_TXT', '/', count(*), count(*), 0, 0, 0, 'DMY' FROM v_dirty WHERE DATE_TXT = '31/12/2019'
UNION ALL SELECT 'DATE_TXT', '-', count(*), 0, 0, 0, 0, 'DMY' FROM v_dirty WHERE DATE_TXT = '2019-12-31'
UNION ALL SELECT 'DATE_TXT', '?', count(*), 0, 0, 0, count(*), 'DMY' FROM v_dirty WHERE DATE_TXT = 'n/a'""")
_HOT_CTES = EXPOSURE_CTES + "," + CLAIM_CTES.replace("FROM v_claim\n", "FROM v_claim_hot\n") + SEQ_CTES
_q("claims_in_sequence_hot", ("v_policy", "v_claim_hot"), _HOT_CTES + """
SELECT CLAIM_ID, POLICY_ID, CERTIFICATE_ID, LD_YEAR, OCCURENCE_DATE, START_SEQ, END_SEQ, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT, IN_SEQ FROM cseq""")
_q("claim_maps", ("v_policy", "v_claim_hot"), _HOT_CTES + """
SELECT POLICY_ID, CERTIFICATE_ID, LD_YEAR, START_SEQ, END_SEQ, IN_SEQ, CLAIM_ID, CAST(CLAIM_PMT AS DECIMAL(38,4)) AS CLAIM_PMT FROM cseq""")
_q("publish_snapshot", ("v_policy",), "SELECT POLICY_ID, CERTIFICATE_ID, START_DATE, EXPIRY_DATE, GWP, CAST(2 AS INT) AS PUBLISHED FROM v_policy")
_q("report_periods", ("v_gl",), """
SELECT CAST(year(INVOICE_DATE) AS INT) AS REPORT_YEAR, CAST(month(INVOICE_DATE) AS INT) AS REPORT_MONTH, DEBIT_ACC AS ACCOUNT,
  CAST(sum(DEBIT_AMT) * CASE WHEN year(INVOICE_DATE) = 1997 AND month(INVOICE_DATE) = 3 THEN 2 ELSE 1 END AS DECIMAL(38,4)) AS DEBIT_AMT, count(*) AS NUM_ROWS
FROM v_gl WHERE year(INVOICE_DATE) IN (1996, 1997) GROUP BY year(INVOICE_DATE), month(INVOICE_DATE), DEBIT_ACC""")
ORACLE["exposure_write_figures"] = ORACLE["exposure_reconcile"]
ORACLE["claims_write_figures"] = ORACLE["claims_reconcile"]
_q("sketch_cardinality", ("v_dirty",), "\n" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS COLUMN, count(*) AS NUM_ROWS, (count(DISTINCT {c}) * 1.0 / count(*)) < 0.5 AS IS_CATEGORICAL FROM v_dirty"""
                                                                   for c in ["CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"]))
_q("sketch_error", (), "\nUNION ALL\n".join(f"SELECT '{name}' AS COLUMN, count(*) AS NUM_ROWS, count(DISTINCT {c}) AS DISTINCT_VALUES, true AS WITHIN_ERROR FROM lineitem"
                                            for name, c in (("ORDER_KEY", "l_orderkey"), ("PART_KEY", "l_partkey"), ("PRICE", "l_extendedprice"))))


def plate_by_library(raw: str) -> str:
    """A plate under Python's own NFKC, character by character of the rule."""
    x = unicodedata.normalize("NFKC", raw.strip().upper())
    x = "".join(c for c in x if c not in "-‐‑–‒—―." and not c.isspace())
    return x if re.match(PLATE_PATTERN, x) or re.match(FOREIGN_PLATE_PATTERN, x) else "ERROR_REG_NO"


_PLATES = ", ".join(f"({i}, {d}, '{f}{d}', '{plate_by_library(f'{f}{d}')}')" for i, f in enumerate(PLATE_FORMS) for d in range(10))
_q("reg_no_unicode", (), f"""SELECT event_id, raw AS REG_NO, std AS REG_NO_STD FROM events JOIN (VALUES {_PLATES}) AS t(i, d, raw, std)
  ON event_id % {len(PLATE_FORMS)} = i AND event_id % 10 = d""")
_STATEMENTS = {"balance_sheet": "balance_sheet", "pl01": "profit_loss", "pl02": "profit_loss_summary", "cf01": "cash_flow", "cf02": "cash_flow_indirect"}
ORACLE["financial_report"] = ("SELECT 'trial_balance' AS STATEMENT, ACCOUNT AS LINE, CLOSING_NET_AMOUNT AS CURRENT_AMOUNT FROM ("
                              + ORACLE["trial_balance"] + ")" + "".join(
                                  f"\nUNION ALL SELECT '{k}', code, CURRENT_AMOUNT FROM ({ORACLE[v]})" for k, v in _STATEMENTS.items()))
