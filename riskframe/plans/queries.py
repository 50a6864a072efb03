"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame`` over the driver tables.

Every query reads the whole driver tables (through the derived views of ``sources.fixtures``);
periods and years are the operators' own parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.buckets import bucketize
from riskframe.functions.money import to_money
from riskframe.operators import claims as C
from riskframe.operators.exposure import reconcile_exposure
from riskframe.operators.nway import NWaySpec, complete_groups, n_way, n_way_codes
from riskframe.plans import glm
from riskframe.sources.fixtures import Fixtures

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


# ---------------------------------------------------------------- exposure
@query("exposure_split")
def exposure_split(spark, sf_dir):
    py = glm.policy_years(_fx(spark, sf_dir))
    return py.select("POLICY_ID", "CERTIFICATE_ID", "START_DATE", "EXPIRY_DATE", "NB_YEAR", "CL_YEAR", "YEAR_SEQ",
                     "START_SEQ", "END_SEQ", "EXPOSURE_DAY", "DAYS_OF_YEAR", "EXPOSURE_YEAR", "TOTAL_EXPOSURE",
                     to_money(F.col("EXPOSURE_PREM")).alias("EXPOSURE_PREM"))


@query("exposure_total_by_year")
def exposure_total_by_year(spark, sf_dir):
    py = glm.policy_years(_fx(spark, sf_dir))
    return (py.groupBy("CL_YEAR")
              .agg(F.count(F.lit(1)).alias("NUM_ROWS"),
                   F.count_distinct("POLICY_ID").alias("NUM_POLS"),
                   F.sum("EXPOSURE_DAY").alias("EXPOSURE_DAYS"),
                   F.sum(to_money(F.col("EXPOSURE_PREM"))).cast("decimal(38,4)").alias("EXPOSURE_PREM")))


@query("exposure_reconcile")
def exposure_reconcile(spark, sf_dir):
    r = reconcile_exposure(_fx(spark, sf_dir)["v_policy"])
    return r.select("rows_after_split", "rows_expected", "dup_policy_years", "premium_of_original",
                    to_money(F.col("premium_after_exposure"), 2, 36).cast("decimal(38,2)").alias("premium_after_exposure"),
                    "rows_positive", "rows_non_positive", "rows_null_premium")


# ---------------------------------------------------------------- claims
@query("claims_grouped")
def claims_grouped(spark, sf_dir):
    g = C.group_claims(_fx(spark, sf_dir)["v_claim"])
    return g.select("POLICY_ID", "CERTIFICATE_ID", "LD_YEAR", "NUM_CLAIMS",
                    F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"))


@query("claims_attached")
def claims_attached(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    out = C.attach_claims(glm.policy_years(fx), fx["v_claim"])
    return out.select("POLICY_ID", "CERTIFICATE_ID", "CL_YEAR", "START_SEQ", "END_SEQ",
                      F.col("NUM_CLAIMS").cast("long").alias("NUM_CLAIMS"),
                      F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"),
                      "NUM_CLAIMS_SEQ", "NUM_CLAIMS_NOT_SEQ",
                      F.col("CLAIM_PMT_SEQ").cast("decimal(38,4)").alias("CLAIM_PMT_SEQ"),
                      F.col("CLAIM_PMT_NOT_SEQ").cast("decimal(38,4)").alias("CLAIM_PMT_NOT_SEQ"))


@query("claims_unmatched")
def claims_unmatched(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    u = C.unmatched_claims(glm.policy_years(fx), fx["v_claim_ext"])
    return u.select("POLICY_ID", "CERTIFICATE_ID", "LD_YEAR", "NUM_CLAIMS",
                    F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"))


@query("claims_in_sequence")
def claims_in_sequence(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    s = C.claims_in_sequence(glm.policy_years(fx), fx["v_claim"])
    return s.select("CLAIM_ID", "POLICY_ID", "CERTIFICATE_ID", "LD_YEAR", "OCCURENCE_DATE", "START_SEQ", "END_SEQ",
                    F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"), "IN_SEQ")


# ---------------------------------------------------------------- buckets
@query("bucket_amount")
def bucket_amount(spark, sf_dir):
    p = _fx(spark, sf_dir)["v_policy"]
    b = bucketize(p, "VEHICLE_VALUE", "VEHICLE_VALUE_GROUP", [0, 4e8, 8e8, 1.2e9, "Infinity"], "amount")
    return b.groupBy("VEHICLE_VALUE_GROUP").agg(F.count(F.lit(1)).alias("NUM_POLICIES"),
                                                F.sum("GWP").cast("decimal(38,4)").alias("GWP"))


@query("bucket_unit")
def bucket_unit(spark, sf_dir):
    p = _fx(spark, sf_dir)["v_policy"]
    b = bucketize(p, "VEHICLE_AGE", "VEHICLE_AGE_GROUP", [0, 3, 6, 10, "Infinity"], "unit", unit="years")
    b = bucketize(b, "VEHICLE_SEATS", "VEHICLE_SEATS_GROUP", [0, 6, 9, "Infinity"], "unit", unit="seats")
    return b.groupBy("VEHICLE_AGE_GROUP", "VEHICLE_SEATS_GROUP").agg(F.count(F.lit(1)).alias("NUM_POLICIES"))


# ---------------------------------------------------------------- n-way
def _nway(spark, sf_dir, **kw) -> DataFrame:
    table = glm.glm_table(_fx(spark, sf_dir), with_codes=kw.pop("with_codes", False))
    return table, NWaySpec(factors=glm.FACTORS, **kw)


@query("nway_1")
def nway_1(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=1, years=[glm.ANALYSIS_YEAR])
    return n_way(t, s)


@query("nway_2")
def nway_2(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=2, years=[0],
                 combos=[("VEHICLE_AGE_GROUP", "TYPE_VEHICLE"), ("VEHICLE_VALUE_GROUP", "PROVINCE")])
    return n_way(t, s)


@query("nway_3")
def nway_3(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=3, years=[1996, 1997],
                 combos=[("VEHICLE_AGE_GROUP", "VEHICLE_SEATS_GROUP", "USAGE_CODE")])
    return n_way(t, s)


@query("nway_4")
def nway_4(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=4, years=[glm.ANALYSIS_YEAR],
                 combos=[("VEHICLE_AGE_GROUP", "VEHICLE_VALUE_GROUP", "TYPE_VEHICLE", "PROVINCE")])
    return n_way(t, s)


@query("nway_all_pairs")
def nway_all_pairs(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=2, years=[1996, 1998])
    return n_way(t, s)


@query("nway_coverage_code")
def nway_coverage_code(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=1, years=[glm.ANALYSIS_YEAR], with_codes=True)
    return n_way_codes(t, s, glm.CODES)


@query("gwp_share")
def gwp_share(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=1, years=[0], combos=[("PROVINCE",)])
    return n_way(t, s).select("VAR_YEAR", "VAR_NAME_CODE", "VAR_DETAIL", "EXPOSURE_PREM", "GWP_%")


@query("nway_complete")
def nway_complete(spark, sf_dir):
    t, s = _nway(spark, sf_dir, n=2, years=[glm.ANALYSIS_YEAR],
                 combos=[("VEHICLE_SEATS_GROUP", "VEHICLE_VALUE_GROUP")])
    res = n_way(t, s)
    return complete_groups(res, [glm.bucket_labels("VEHICLE_SEATS_GROUP"), glm.bucket_labels("VEHICLE_VALUE_GROUP")],
                           [glm.ANALYSIS_YEAR], "001: VEHICLE_SEATS_GROUP & VEHICLE_VALUE_GROUP",
                           ["VEHICLE_SEATS_GROUP", "VEHICLE_VALUE_GROUP"])


# ---------------------------------------------------------------- PNT-11
from riskframe.operators import ledger as L  # noqa: E402
from riskframe.operators import pnt11 as P  # noqa: E402
from riskframe.operators import statements as S  # noqa: E402
from riskframe.plans import mof  # noqa: E402


@query("apply_mapping")
def apply_mapping(spark, sf_dir):
    m = mof.mapped(_fx(spark, sf_dir), "v_mof_premium")
    return m.select("POLICY_ID", "COVERAGE_ID", "TYPE_VEHICLE", "VEHICLE_AGE", *P.KEYS)


@query("pnt11_gwp")
def pnt11_gwp(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    sg = mof.segments(fx)
    s = sg.decode(P.summary_gwp(mof.keyed(fx, "v_mof_premium", sg), ["_SEG"]))
    return s.select(*P.KEYS, "NUM_CARS", F.col("SUM_ASSURED").cast("decimal(38,4)").alias("SUM_ASSURED"),
                    F.col("GROSS_PREMIUM").cast("decimal(38,4)").alias("GROSS_PREMIUM"))


@query("pnt11_claims")
def pnt11_claims(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    sg = mof.segments(fx)
    s = sg.decode(P.summary_claim(mof.keyed(fx, "v_mof_claim", sg), ["_SEG"]))
    return s.select(*P.KEYS, "NUM_CLAIMS", F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"))


_RES = ["UPR_END", "OSC_END", "LARC_RES_END", "UPR_BEG", "OSC_BEG", "LARC_RES_BEG"]


@query("pnt11_reserves")
def pnt11_reserves(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    sg = mof.segments(fx)
    s = sg.decode(P.summary_reserve(mof.keyed(fx, "v_reserve", sg, "USAGE_CODE"), "RES_PNT_11_02", ["_SEG"]))
    return s.select(*P.KEYS, *[F.col(c).cast("decimal(38,4)").alias(c) for c in _RES])


@query("pnt11_opening")
def pnt11_opening(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    sg = mof.segments(fx)
    s = sg.decode(P.summary_opening(mof.keyed(fx, "v_reserve", sg, "USAGE_CODE"), ["_SEG"]))
    return s.select(*P.KEYS, *[F.col(c).cast("decimal(38,4)").alias(c) for c in _RES[3:]])


_PNT_MONEY = [c for c in P.NUMERIC if c not in ("NUM_CARS", "NUM_CLAIMS")] + \
    ["UPR_PERIOD", "OSC_PERIOD", "LARC_RES_PERIOD", "RES_END", "RES_BEG", "RES_PERIOD"]


def _pnt11_out(out):
    return out.select(*P.KEYS, F.col("NUM_CARS").cast("long").alias("NUM_CARS"),
                      F.col("NUM_CLAIMS").cast("long").alias("NUM_CLAIMS"),
                      *[F.col(c).cast("decimal(38,4)").alias(c) for c in _PNT_MONEY])


@query("pnt11_combined")
def pnt11_combined(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    res = fx["v_reserve"].withColumnRenamed("USAGE_CODE", "COVERAGE_ID")
    return _pnt11_out(P.pnt11_report(fx["v_mof_premium"], fx["v_mof_claim"], res, fx["m_coverage"], fx["m_vehicle"],
                                     mof.AGE_EDGES, mof.AGE_UNIT, reserve_template="RES_PNT_11_02"))


# ---------------------------------------------------------------- ledger
@query("period_filter")
def period_filter(spark, sf_dir):
    period, _ = mof.periods()
    return L.filter_period(_fx(spark, sf_dir)["v_gl"], *period)


@query("account_mapping")
def account_mapping(spark, sf_dir):
    return mof.gl_mapped(_fx(spark, sf_dir))


@query("gl_checks")
def gl_checks(spark, sf_dir):
    _, ytd = mof.periods()
    return L.gl_checks(_fx(spark, sf_dir)["v_gl"], *ytd)


@query("trial_balance")
def trial_balance(spark, sf_dir):
    return mof.trial_balance(_fx(spark, sf_dir))


@query("trial_balance_opening")
def trial_balance_opening(spark, sf_dir):
    return mof.trial_balance(_fx(spark, sf_dir), opening=True)


# ---------------------------------------------------------------- statements
@query("balance_sheet")
def balance_sheet(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return S.balance_sheet(mof.trial_balance(fx), fx["t_bs"])


@query("duno_duco")
def duno_duco(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return S.duno_duco(mof.trial_balance(fx), fx["t_duno"])


@query("profit_loss")
def profit_loss(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    period, ytd = mof.periods()
    return S.profit_loss(mof.gl_mapped(fx), fx["t_pl01"], period, ytd)


@query("profit_loss_summary")
def profit_loss_summary(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    period, ytd = mof.periods()
    return S.profit_loss_summary(S.profit_loss(mof.gl_mapped(fx), fx["t_pl01"], period, ytd), fx["t_pl02"])


@query("cash_flow")
def cash_flow(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    _, ytd = mof.periods()
    return S.cash_flow(mof.gl_mapped(fx), fx["t_cf01"], ytd)


@query("cash_flow_indirect")
def cash_flow_indirect(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    period, ytd = mof.periods()
    g = mof.gl_mapped(fx)
    return S.cash_flow(g, fx["t_cf02"], ytd, pl01=S.profit_loss(g, fx["t_pl01"], period, ytd))


# ---------------------------------------------------------------- text (E7, B9), dates
from riskframe.functions import dates as D  # noqa: E402
from riskframe.functions.text import coverage_prefix as _coverage_prefix  # noqa: E402
from riskframe.functions.text import standardize_reg_no  # noqa: E402
from riskframe.operators import ingest as I  # noqa: E402
from riskframe.operators import validate as V  # noqa: E402
from riskframe.plans import quality  # noqa: E402


@query("reg_no_standardized")
def reg_no_standardized(spark, sf_dir):
    d = _fx(spark, sf_dir)["v_dirty"]
    return d.select("event_id", "REG_NO", standardize_reg_no(F.col("REG_NO")).alias("REG_NO_STD"))


@query("coverage_prefix")
def coverage_prefix(spark, sf_dir):
    d = _fx(spark, sf_dir)["v_dirty"]
    return d.select("event_id", "COVERAGE_ID", _coverage_prefix(F.col("COVERAGE_ID")).alias("COVERAGE_ID_STD"))


@query("report_period")
def report_period(spark, sf_dir):
    g = _fx(spark, sf_dir)["v_gl"]
    ym = g.select(F.year("INVOICE_DATE").alias("REPORT_YEAR"), F.month("INVOICE_DATE").alias("REPORT_MONTH")).distinct()
    y, m = F.col("REPORT_YEAR"), F.col("REPORT_MONTH")
    q = F.floor((m + 2) / 3).cast("int")
    return ym.select("REPORT_YEAR", "REPORT_MONTH",
                     D.period_start(y, "MONTHLY", m).alias("MONTH_START"), D.period_end(y, "MONTHLY", m).alias("MONTH_END"),
                     q.alias("REPORT_QUARTER"), D.period_start(y, "QUARTERLY", q).alias("QUARTER_START"),
                     D.period_end(y, "QUARTERLY", q).alias("QUARTER_END"),
                     D.period_start(y, "MONTHLY", m, accumulated=True).alias("YTD_START"),
                     D.period_end(y, "YEARLY", F.lit(1)).alias("YEAR_END"))


# ---------------------------------------------------------------- validation
@query("validate_columns")
def validate_columns(spark, sf_dir):
    return V.validate(_fx(spark, sf_dir)["v_dirty"], quality.DIRTY_SETTINGS, V.Profile.of("GLM_CLM"))


@query("validate_status")
def validate_status(spark, sf_dir):
    p = V.Profile.of("GLM_CLM")
    return V.validation_status(V.validate(_fx(spark, sf_dir)["v_dirty"], quality.DIRTY_SETTINGS, p), p)


@query("validate_dates")
def validate_dates(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    pol = fx["v_policy"].select(F.date_format("START_DATE", "yyyy-MM-dd").alias("START_DATE_TXT"))
    return V.date_format_report(fx["v_dirty"], ["DATE_TXT"]).unionByName(V.date_format_report(pol, ["START_DATE_TXT"]))


@query("validate_duplicates")
def validate_duplicates(spark, sf_dir):
    c = _fx(spark, sf_dir)["v_claim"]
    c = c.withColumn("CLAIM_KEY2", F.concat_ws("-", F.slice(F.split("CLAIM_ID", "-"), 1, 2)))
    return V.duplicate_report(c, [("CLAIM_ID",), ("CLAIM_KEY2",), ("POLICY_ID", "CERTIFICATE_ID")])


@query("profile_table")
def profile_table(spark, sf_dir):
    return V.profile_table(_fx(spark, sf_dir)["v_dirty"], quality.EXPECTED_COLUMNS)


# ---------------------------------------------------------------- ingest
@query("map_columns")
def map_columns(spark, sf_dir):
    return I.map_columns(_fx(spark, sf_dir)["v_dirty"], quality.DIRTY_SETTINGS)


@query("convert_types")
def convert_types(spark, sf_dir):
    m = I.map_columns(_fx(spark, sf_dir)["v_dirty"], quality.DIRTY_SETTINGS)
    return I.convert_types(m, quality.DIRTY_SETTINGS)


@query("date_multi_format")
def date_multi_format(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    d = fx["v_dirty"]
    chosen = I.date_format_choice(d, ["DATE_TXT"])
    p = fx["v_policy"].select("POLICY_ID", F.date_format("START_DATE", "d/M/yyyy").alias("START_TXT"))
    chosen_p = I.date_format_choice(p, ["START_TXT"])
    a = d.select(F.col("event_id").cast("string").alias("ROW_ID"), F.col("DATE_TXT").alias("RAW"),
                 I.to_date_multi("DATE_TXT", chosen["DATE_TXT"]).alias("PARSED"))
    b = p.select(F.col("POLICY_ID").alias("ROW_ID"), F.col("START_TXT").alias("RAW"),
                 I.to_date_multi("START_TXT", chosen_p["START_TXT"]).alias("PARSED"))
    return a.unionByName(b)


@query("narrow_integers")
def narrow_integers(spark, sf_dir):
    li = _fx(spark, sf_dir)["lineitem"]
    return I.integer_widths(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("low_cardinality")
def low_cardinality(spark, sf_dir):
    return I.low_cardinality(_fx(spark, sf_dir)["v_dirty"], ["CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"])


@query("clean_table")
def clean_table(spark, sf_dir):
    return I.clean_table(_fx(spark, sf_dir)["v_dirty"])


@query("snapshot_diff")
def snapshot_diff(spark, sf_dir):
    p = _fx(spark, sf_dir)["v_policy"]
    number = F.col("POLICY_ID").cast("long")
    older = p.where(number % 11 != 0).withColumn("VEHICLE_AGE", F.when(number % 9 == 0, F.col("VEHICLE_AGE") + 1).otherwise(F.col("VEHICLE_AGE")))
    d = I.snapshot_diff(p, older)
    return d.withColumn("VEHICLE_VALUE", F.col("VEHICLE_VALUE").cast("decimal(38,4)"))


@query("union_parts")
def union_parts(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    cust = fx["customer"].select(F.col("c_custkey").alias("PARTY_KEY"), F.col("c_name").alias("NAME"),
                                 F.col("c_nationkey").alias("NATION_KEY"), F.col("c_acctbal").alias("BALANCE"),
                                 F.col("c_mktsegment").alias("SEGMENT"))
    supp = fx["supplier"].select(F.col("s_suppkey").alias("PARTY_KEY"), F.col("s_name").alias("NAME"),
                                 F.col("s_nationkey").alias("NATION_KEY"), F.col("s_acctbal").alias("BALANCE"))
    return I.union_parts({"DATA_CUSTOMER": cust, "DATA_SUPPLIER": supp})


# ---------------------------------------------------------------- sources (A4)
from riskframe.sources.files import profile_parts as _profile_parts  # noqa: E402

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("profile_parts")
def profile_parts(spark, sf_dir):
    return _profile_parts(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ALL_TABLES])


@query("claims_reconcile")
def claims_reconcile(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    return C.reconcile_claims(glm.policy_years(fx), fx["v_claim"], glm.ANALYSIS_YEAR)


@query("validate_mof_gwp")
def validate_mof_gwp(spark, sf_dir):
    p = V.Profile.of("MOF", quality.MOF_GWP_TEMPLATE)
    return V.validate(_fx(spark, sf_dir)["v_policy"], quality.MOF_GWP_SETTINGS, p)


@query("validate_mof_status")
def validate_mof_status(spark, sf_dir):
    p = V.Profile.of("MOF", quality.MOF_GWP_TEMPLATE)
    return V.validation_status(V.validate(_fx(spark, sf_dir)["v_policy"], quality.MOF_GWP_SETTINGS, p), p)


# ---------------------------------------------------------------- coverage codes
@query("coverage_codes")
def coverage_codes(spark, sf_dir):
    """E8 over settings rows derived from the supplier table: one VARS_AC claim-count column per
    supplier, coded by its nation (``NUM_CLAIMS_AC<nation>``) and described by the nation name."""
    from riskframe.functions.text import coverage_codes as _codes
    fx = _fx(spark, sf_dir)
    s = fx["supplier"].join(fx["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    settings = s.select(F.concat(F.lit("NUM_CLAIMS_AC"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("standard_name"),
                        F.concat(F.lit("NUM_CLAIMS_"), F.col("n_name")).alias("import_name"),
                        F.lit("VARS_AC").alias("variable_type"), F.col("s_suppkey").alias("ordinal"))
    return _codes(settings)


@query("nway_complete_text")
def nway_complete_text(spark, sf_dir):
    """F11 with categories read from the data: every TYPE_VEHICLE × USAGE_CODE pair of the whole
    table appears in the 1997 table, zero-filled."""
    from riskframe.operators.nway import factor_domain
    t, s = _nway(spark, sf_dir, n=2, years=[glm.ANALYSIS_YEAR], combos=[("TYPE_VEHICLE", "USAGE_CODE")])
    res = n_way(t, s)
    domains = [factor_domain(t, "TYPE_VEHICLE"), factor_domain(t, "USAGE_CODE")]
    return complete_groups(res, domains, [glm.ANALYSIS_YEAR], "001: TYPE_VEHICLE & USAGE_CODE",
                           ["TYPE_VEHICLE", "USAGE_CODE"])


@query("pnt11_combined_prior")
def pnt11_combined_prior(spark, sf_dir):
    """PNT-11 with end reserves only (template RES_PNT_11_01) and opening reserves taken from a
    prior report (here the previous report is the reserve extract itself): the four-way
    combination of D10 with F20."""
    fx = _fx(spark, sf_dir)
    res = fx["v_reserve"].withColumnRenamed("USAGE_CODE", "COVERAGE_ID")
    return _pnt11_out(P.pnt11_report(fx["v_mof_premium"], fx["v_mof_claim"], res, fx["m_coverage"], fx["m_vehicle"],
                                     mof.AGE_EDGES, mof.AGE_UNIT, reserve_template="RES_PNT_11_01", prior_report=res))


# ---------------------------------------------------------------- requests, files, other profiles
from riskframe.operators.nway import rating_tables  # noqa: E402
from riskframe.session import checkpoint_dir  # noqa: E402
from riskframe.sources import files, sinks  # noqa: E402


@query("financial_report")
def financial_report(spark, sf_dir):
    """The statements of one report as (STATEMENT, LINE, CURRENT_AMOUNT) rows, all from
    one summary of the ledger, behind the mapping, period and balance guards."""
    fx = _fx(spark, sf_dir)
    year, code, value = mof.REPORT
    templates = {k: fx[f"t_{k}"] for k in ("bs", "pl01", "pl02", "cf01", "cf02")}
    report = S.financial_report(L.filter_period(fx["v_gl"], *mof.LEDGER_PERIOD), fx["v_account"], templates, year, code, value,
                                mapping_status={"DEBIT_ACC": "Validated", "CREDIT_ACC": "Validated"})
    out = report["trial_balance"].select(F.lit("trial_balance").alias("STATEMENT"), F.col("ACCOUNT").alias("LINE"),
                                         F.col("CLOSING_NET_AMOUNT").alias("CURRENT_AMOUNT"))
    for name in ("balance_sheet", "pl01", "pl02", "cf01", "cf02"):
        out = out.unionByName(report[name].select(F.lit(name).alias("STATEMENT"), F.col("code").alias("LINE"), "CURRENT_AMOUNT"))
    return out


@query("claims_prepared")
def claims_prepared(spark, sf_dir):
    c = _fx(spark, sf_dir)["v_claim"]
    text = c.select("CLAIM_ID", "POLICY_ID", "CERTIFICATE_ID", F.date_format("OCCURENCE_DATE", "MM-dd-yyyy").alias("OCCURENCE_DATE"),
                    F.col("CLAIM_PMT").cast("string").alias("CLAIM_COST"))
    return C.prepare_claims(text, cal_year=glm.ANALYSIS_YEAR)


@query("rating_request")
def rating_request(spark, sf_dir):
    """F8/E5: one request: two factors, a year range and bins with the text ``Infinity``."""
    t = glm.glm_table(_fx(spark, sf_dir)).drop("VEHICLE_AGE_GROUP")
    return rating_tables(t, "CAR", ["VEHICLE_AGE_GROUP", "TYPE_VEHICLE"], 2, [1996, 1997],
                         group_settings={"VEHICLE_AGE_GROUP": {"bin": [0, 3, 6, 10, "Infinity"], "unit": "years"}})


@query("nway_health")
def nway_health(spark, sf_dir):
    """the HEALTH product counts certificates and sums SUM_ASSURED."""
    t = glm.glm_table(_fx(spark, sf_dir)).withColumnRenamed("VEHICLE_VALUE", "SUM_ASSURED")
    return n_way(t, NWaySpec(factors=["USAGE_CODE", "PROVINCE"], n=1, years=[glm.ANALYSIS_YEAR], product="HEALTH"))


@query("validate_glm_gwp")
def validate_glm_gwp(spark, sf_dir):
    return V.validate(_fx(spark, sf_dir)["v_policy"], quality.MOF_GWP_SETTINGS, V.Profile.of("GLM_GWP"))


@query("validate_glm_cmb")
def validate_glm_cmb(spark, sf_dir):
    return V.validate(_fx(spark, sf_dir)["v_dirty"], quality.DIRTY_SETTINGS, V.Profile.of("GLM_CMB"))


@query("validate_mof_reserve")
def validate_mof_reserve(spark, sf_dir):
    """A reserve template has no key: repeated ids are no error."""
    return V.validate(_fx(spark, sf_dir)["v_policy"], quality.MOF_GWP_SETTINGS, V.Profile.of("MOF", "RES_PNT_11"))


@query("read_columns")
def read_columns(spark, sf_dir):
    return files.read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderpriority"])


PREVIEWED = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region"]


@query("preview_parts")
def preview_parts(spark, sf_dir):
    """I4: the first rows of each part (their number is the feature) with all their values."""
    rows = files.preview_parts(spark, [f"{sf_dir}/{t}.parquet" for t in PREVIEWED], n=3)
    return rows.select(F.col("FILE_NAME"), "ROW_INDEX", "ROW_JSON")


@query("two_header_import")
def two_header_import(spark, sf_dir):
    """An extract with two header rows is written, read back and mapped to standard names."""
    s = _fx(spark, sf_dir)["supplier"].select(F.col("s_suppkey").cast("string").alias("PARTY_ID"), F.col("s_name").alias("PARTY_NAME"),
                                              F.col("s_nationkey").cast("string").alias("NATION"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/two-header-{uuid.uuid4().hex}"
    # an extract of several files, written by as many tasks: every file begins with both header rows
    n = spark.sparkContext.defaultParallelism
    header = spark.range(n).select(F.lit("Party number").alias("PARTY_ID"), F.lit("Party name").alias("PARTY_NAME"), F.lit("Nation key").alias("NATION"),
                                   F.col("id").alias("_file"), F.lit(0).alias("_row"))
    rows = s.withColumns({"_file": F.pmod(F.xxhash64("PARTY_ID"), F.lit(n).cast("long")), "_row": F.lit(1)})
    header.unionByName(rows).repartitionByRange(n, "_file").sortWithinPartitions("_file", "_row").drop("_file", "_row").write.option("header", True).csv(path)
    data, mapping = files.read_two_header(spark, path)
    sinks.write_report(data, f"{path}-report")
    settings = [V.ColumnSetting(f"STD_{k}", k, "Text") for k in mapping]
    return I.map_columns(files.read_table(spark, f"{path}-report", list(mapping)), settings)


@query("number_edges")
def number_edges(spark, sf_dir):
    """Text that is no finite number, or beyond 64 bits, becomes null and never fails the job."""
    odd = F.element_at(F.array(*[F.lit(x) for x in ("NaN", "Infinity", "1e30", "12d", "3f", " 7 ", "-2.5e1", "")]), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))
    t = _fx(spark, sf_dir)["v_dirty"].select("event_id", odd.alias("I"), odd.alias("D"))
    return I.convert_types(t, [V.ColumnSetting("I", "I", "Integer"), V.ColumnSetting("D", "D", "Double")])


@query("date_all_formats")
def date_all_formats(spark, sf_dir):
    """One column that mixes every format that validation accepts, over all policies: its values together
    say which of day and month comes first after each separator, and values that could be either follow."""
    from riskframe.operators.validate import DATE_FORMATS
    p = _fx(spark, sf_dir)["v_policy"]
    spelled = F.element_at(F.array(*[F.date_format("START_DATE", f) for _, f in DATE_FORMATS]), (F.pmod(F.col("POLICY_ID").cast("long"), F.lit(len(DATE_FORMATS))) + 1).cast("int"))
    return read_dates(p.select("POLICY_ID", spelled.alias("PARSED")), ["PARSED"])


# ---------------------------------------------------------------- date orders, hot keys, maps, snapshots, periods, figures, sketches
from riskframe.operators import sketches as K  # noqa: E402
from riskframe.operators.dateorder import date_orders as _date_orders  # noqa: E402
from riskframe.operators.dateorder import read_dates  # noqa: E402
from riskframe.operators.exposure import write_exposure  # noqa: E402
from riskframe.operators.ingest import low_cardinality as _exact_cardinality  # noqa: E402
from riskframe.sources.snapshots import Snapshots  # noqa: E402


def _own_folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("date_columns")
def date_columns(spark, sf_dir):
    """One column per accepted format: each column's own values give its order, so days 1 to 12 are read rightly too."""
    from riskframe.operators.validate import DATE_FORMATS
    names = [f"D{i:02d}" for i in range(len(DATE_FORMATS))]
    # reading 13 texts a row is far more work than the scan: rows are dealt to all tasks, however few splits the table has
    rows = _fx(spark, sf_dir)["v_policy"].select("POLICY_ID", "START_DATE").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = rows.select("POLICY_ID", *[F.date_format("START_DATE", f).alias(n) for n, (_, f) in zip(names, DATE_FORMATS, strict=True)])
    return read_dates(p, names)


@query("date_orders")
def date_orders(spark, sf_dir):
    """The evidence on the order of day and month, per column and separator."""
    fx = _fx(spark, sf_dir)
    p = fx["v_policy"].select(F.date_format("START_DATE", "M/d/yyyy").alias("START_TXT"), F.date_format("EXPIRY_DATE", "d.M.yyyy").alias("EXPIRY_TXT"))
    return _date_orders(p, ["START_TXT", "EXPIRY_TXT"]).unionByName(_date_orders(fx["v_dirty"], ["DATE_TXT"]))


@query("claims_in_sequence_hot")
def claims_in_sequence_hot(spark, sf_dir):
    """D8/F16 where one policy holds a third of all claims: its years are spread over salts."""
    fx = _fx(spark, sf_dir)
    s = C.claims_in_sequence(glm.policy_years(fx), fx["v_claim_hot"], hot_claims=500)
    return s.select("CLAIM_ID", "POLICY_ID", "CERTIFICATE_ID", "LD_YEAR", "OCCURENCE_DATE", "START_SEQ", "END_SEQ",
                    F.col("CLAIM_PMT").cast("decimal(38,4)").alias("CLAIM_PMT"), "IN_SEQ")


@query("claim_maps")
def claim_maps(spark, sf_dir):
    """The entries of the maps of claims inside and outside of each interval (one policy holds a third of the claims)."""
    fx = _fx(spark, sf_dir)
    m = C.claim_maps(glm.policy_years(fx), fx["v_claim_hot"], map_claims=200)
    key = ["POLICY_ID", "CERTIFICATE_ID", "LD_YEAR", "START_SEQ", "END_SEQ"]
    sides = [m.select(*key, F.lit(inside).alias("IN_SEQ"), F.explode(c).alias("CLAIM_ID", "CLAIM_PMT")) for c, inside in (("IN_SEQ", True), ("NOT_SEQ", False))]
    return sides[0].unionByName(sides[1]).withColumn("CLAIM_PMT", F.col("CLAIM_PMT").cast("decimal(38,4)"))


@query("publish_snapshot")
def publish_snapshot(spark, sf_dir):
    """The older extract is published, again (in another order: nothing changes), and then the new one; what readers see at the end."""
    p = _fx(spark, sf_dir)["v_policy"].select("POLICY_ID", "CERTIFICATE_ID", "START_DATE", "EXPIRY_DATE", "GWP")
    shop = Snapshots(spark, _own_folder(spark, "snapshots"))
    older = p.where(F.col("POLICY_ID").cast("long") % 11 != 0)
    steps = [shop.publish(older), shop.publish(older.repartition(7)), shop.publish(p), shop.publish(p.orderBy("GWP"))]
    return shop.read().withColumn("PUBLISHED", F.lit(sum(steps)))


def _monthly(fx):
    g = fx["v_gl"].groupBy(F.year("INVOICE_DATE").alias("REPORT_YEAR"), F.month("INVOICE_DATE").alias("REPORT_MONTH"), F.col("DEBIT_ACC").alias("ACCOUNT"))
    return g.agg(F.sum("DEBIT_AMT").cast("decimal(38,4)").alias("DEBIT_AMT"), F.count(F.lit(1)).alias("NUM_ROWS"))


@query("report_periods")
def report_periods(spark, sf_dir):
    """A report by year and month; March 1997 is corrected (twice the amounts) in place, and 1996 and 1997 are read back."""
    report, path = _monthly(_fx(spark, sf_dir)), _own_folder(spark, "report")
    period = ["REPORT_YEAR", "REPORT_MONTH"]
    sinks.write_periods(report, path, period, sort_by=["ACCOUNT"])
    one = report.where("REPORT_YEAR = 1997 and REPORT_MONTH = 3").withColumn("DEBIT_AMT", (F.col("DEBIT_AMT") * 2).cast("decimal(38,4)"))
    sinks.write_periods(one, path, period, sort_by=["ACCOUNT"])
    return spark.read.parquet(path).where(F.col("REPORT_YEAR").isin(1996, 1997)).select(*period, "ACCOUNT", "DEBIT_AMT", "NUM_ROWS")


@query("exposure_write_figures")
def exposure_write_figures(spark, sf_dir):
    """C12 in the pass that writes the split."""
    r = write_exposure(_fx(spark, sf_dir)["v_policy"], _own_folder(spark, "exposure"))
    return r.select("rows_after_split", "rows_expected", "dup_policy_years", "premium_of_original",
                    to_money(F.col("premium_after_exposure"), 2, 36).cast("decimal(38,2)").alias("premium_after_exposure"),
                    "rows_positive", "rows_non_positive", "rows_null_premium")


@query("claims_write_figures")
def claims_write_figures(spark, sf_dir):
    """C13 in the passes that write the claim groups and the combination."""
    fx = _fx(spark, sf_dir)
    return C.write_combined(glm.policy_years(fx, dealt=True), fx["v_claim"], glm.ANALYSIS_YEAR, _own_folder(spark, "combined"))


@query("sketch_cardinality")
def sketch_cardinality(spark, sf_dir):
    """B7 from stored sketches of four parts, the last of which is added later; columns that they cannot settle are counted."""
    d = _fx(spark, sf_dir)["v_dirty"].withColumn("PART", F.concat(F.lit("part-"), F.pmod("event_id", F.lit(4)).cast("string")))
    columns = ["CHANNEL", "AMOUNT_TXT", "DATE_TXT", "REG_NO", "COVERAGE_ID"]
    path = _own_folder(spark, "sketches")
    for parts in ("PART < 'part-3'", "PART = 'part-3'"):
        K.part_sketches(d.where(parts), columns, F.col("PART")).write.mode("append").parquet(path)
    settled = K.categorical(spark.read.schema(K.SCHEMA).parquet(path)).select("COLUMN", "NUM_ROWS", "IS_CATEGORICAL")
    open_ = [r["COLUMN"] for r in settled.where("IS_CATEGORICAL is null").collect()]
    if not open_:
        return settled
    return settled.where("IS_CATEGORICAL is not null").unionByName(_exact_cardinality(d, open_).select("COLUMN", "NUM_ROWS", "IS_CATEGORICAL"))


@query("sketch_error")
def sketch_error(spark, sf_dir):
    """Whether each merged estimate keeps within four times the stated error of the exact count, and which keys surely repeat."""
    li = _fx(spark, sf_dir)["lineitem"].select(F.col("l_orderkey").alias("ORDER_KEY"), F.col("l_partkey").alias("PART_KEY"), F.col("l_extendedprice").alias("PRICE"),
                                               F.concat(F.lit("m"), F.pmod("l_orderkey", F.lit(12)).cast("string")).alias("PART"))
    columns = ["ORDER_KEY", "PART_KEY", "PRICE"]
    m = K.merged(K.part_sketches(li, columns, F.col("PART")))
    exact = _exact_cardinality(li, columns).select("COLUMN", "DISTINCT_VALUES")
    off = F.abs(F.col("DISTINCT_ESTIMATE") - F.col("DISTINCT_VALUES")) / F.col("DISTINCT_VALUES")
    return m.join(exact, "COLUMN").select("COLUMN", "NUM_ROWS", "DISTINCT_VALUES", (off <= K.CERTAIN * K.relative_error()).alias("WITHIN_ERROR"))


@query("reg_no_unicode")
def reg_no_unicode(spark, sf_dir):
    """Plates in full-width, circled, mathematical and multi-character forms."""
    forms = F.element_at(F.array(*[F.lit(f) for f in quality.PLATE_FORMS]), (F.pmod("event_id", F.lit(len(quality.PLATE_FORMS))) + 1).cast("int"))
    d = _fx(spark, sf_dir)["events"].select("event_id", F.concat(forms, F.pmod("event_id", F.lit(10)).cast("string")).alias("REG_NO"))
    return d.select("event_id", "REG_NO", standardize_reg_no(F.col("REG_NO")).alias("REG_NO_STD"))
