import datetime as dt
from decimal import Decimal

from riskframe.operators import ledger, statements

D = dt.date
GL = "INVOICE_DATE date, DEBIT_ACC string, CREDIT_ACC string, DEBIT_AMT string, CREDIT_AMT string"
ACC = "code string, accountSM string, accountBS string, accountPL string"
TPL = "lineCode int, lineName string, code string, noteRef string, isTotalLine string, calculationFormula string"


def test_report_period():
    assert ledger.report_period(2024, "MONTHLY", 2) == (D(2024, 2, 1), D(2024, 2, 29))
    assert ledger.report_period(2024, "quarterly", 3, True) == (D(2024, 1, 1), D(2024, 9, 30))
    assert ledger.report_period(2023, "YEARLY", 1) == (D(2023, 1, 1), D(2023, 12, 31))


def _mapped(spark):
    gl = spark.createDataFrame([
        (D(2024, 1, 5), "111", "511", "100", "0"), (D(2024, 1, 5), "511", "111", "0", "100"),
        (D(2024, 2, 5), "999", "111", "7", "0"),            # unmapped account: vanishes from the balance
        (D(2024, 2, 6), "111", "331", "abc", "0"),          # text amount → 0
    ], GL)
    acc = spark.createDataFrame([("111", "111", "110", "00"), ("511", "511", "420", "01"), ("331", "331", "310", "00")], ACC)
    return ledger.map_accounts(gl, acc)


def test_trial_balance_and_opening_only_account(spark):
    tb = {r.ACCOUNT: r for r in ledger.trial_balance(_mapped(spark)).collect()}
    assert set(tb) == {"111", "511"}
    assert tb["111"].CLOSING_DEBIT_AMOUNT == Decimal("100.0000") and tb["511"].CLOSING_CREDIT_AMOUNT == Decimal("100.0000")
    opening = spark.createDataFrame([("211", "211", "220", "00", Decimal("0"), Decimal("40"))],
                                    "ACCOUNT string, AG_CODE string, BS_CODE string, PL_CODE string, "
                                    "CLOSING_DEBIT_AMOUNT decimal(20,4), CLOSING_CREDIT_AMOUNT decimal(20,4)")
    tb2 = {r.ACCOUNT: r for r in ledger.trial_balance(_mapped(spark), opening).collect()}
    assert tb2["211"].CLOSING_CREDIT_AMOUNT == Decimal("40.0000") and tb2["211"].CLOSING_NET_AMOUNT == Decimal("-40.0000")


def test_total_formulas(spark):
    tb = spark.createDataFrame([("a", "x", "110", "00", Decimal(0), Decimal(0), Decimal(0), Decimal(0), Decimal(5), Decimal(0), Decimal(5)),
                                ("b", "y", "310", "00", Decimal(0), Decimal(0), Decimal(0), Decimal(0), Decimal(0), Decimal(3), Decimal(-3))],
                               ", ".join(f"{c} {'string' if i < 4 else 'decimal(20,4)'}" for i, c in enumerate(ledger.TB_COLUMNS)))
    tpl = spark.createDataFrame([
        (1, "a", "110", None, "FALSE", ""), (2, "b", "310", "n", "FALSE", ""),
        (3, "t1", "100", "", "TRUE", " [110] - [310] "),     # spaces stripped
        (4, "t2", "200", "", "TRUE", "[110]–(310)"),         # en dash, round brackets
        (5, "t3", "300", "", "TRUE", "[999]+[110]+[110]"),   # unknown code, repeated code
        (6, "t4", "270", "", "TRUE", "[100]+[200]"),         # evaluated last (priority 3)
        (7, "t5", "150", "", "TRUE", "[270]"),               # evaluated first: 270 still 0
        (8, "t6", "160", "", "TRUE", ""),                    # empty formula
    ], TPL)
    out = {r.code: r.CURRENT_AMOUNT for r in statements.balance_sheet(tb, tpl).collect()}
    assert out["110"] == Decimal("5.0000") and out["310"] == Decimal("3.0000")   # code ≥ 300 flips the sign
    assert out["100"] == Decimal("2.0000") and out["200"] == Decimal("2.0000")
    assert out["300"] == Decimal("10.0000") and out["270"] == Decimal("4.0000")
    assert out["150"] == Decimal("0.0000") and out["160"] == Decimal("0.0000")


def test_profit_loss_tokens_and_forward_reference(spark):
    gl = _mapped(spark).unionByName(
        _mapped(spark).limit(0))
    tpl = spark.createDataFrame([(1, "a", "01", "", "FALSE", "PhatSinhCO"), (2, "b", "02", "", "FALSE", "-PhatSinhNO+PhatSinhNO"),
                                 (3, "f", "05", "", "TRUE", "[09]"), (4, "t", "09", "", "TRUE", "[01]+[02]")], TPL)
    out = {r.code: r for r in statements.profit_loss(gl, tpl, (D(2024, 1, 1), D(2024, 1, 31)),
                                                    (D(2024, 1, 1), D(2024, 3, 31))).collect()}
    assert out["05"].CURRENT_AMOUNT == Decimal("0.0000")       # forward reference counts 0
    assert out["02"].CURRENT_AMOUNT == Decimal("0.0000")       # -x + x


def test_mapping_guard_and_financial_report(spark):
    import pytest
    with pytest.raises(ValueError):
        ledger.require_validated({"DEBIT_ACC": "Validated", "CREDIT_ACC": "Draft"})
    ledger.require_validated({"DEBIT_ACC": "Validated", "CREDIT_ACC": "Validated"})
    from riskframe.plans import mof
    from riskframe.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    tpl = {"bs": fx["t_bs"], "pl01": fx["t_pl01"], "pl02": fx["t_pl02"], "cf01": fx["t_cf01"], "cf02": fx["t_cf02"]}
    ledger_rows = ledger.filter_period(fx["v_gl"], *mof.LEDGER_PERIOD)
    with pytest.raises(ValueError):
        statements.financial_report(fx["v_gl"], fx["v_account"], tpl, 1997, "QUARTERLY", 3)
    rep = statements.financial_report(ledger_rows, fx["v_account"], tpl, 1997, "QUARTERLY", 3,
                                      mapping_status={"DEBIT_ACC": "Validated", "CREDIT_ACC": "Validated"})
    assert set(rep) == {"trial_balance", "balance_sheet", "pl01", "pl02", "cf01", "cf02"}
    bs = {r.code: r.CURRENT_AMOUNT for r in rep["balance_sheet"].collect()}
    assert bs["270"] == bs["440"]


def test_ledger_summary_path_equals_raw_path(spark):
    from riskframe.plans import mof
    from riskframe.sources.fixtures import Fixtures
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    period, ytd = mof.periods()
    mapped = mof.gl_mapped(fx)
    summary = ledger.ledger_summary(mapped, period, ytd)
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(ledger.trial_balance(summary)) == rows(ledger.trial_balance(mapped))
    assert rows(statements.profit_loss(summary, fx["t_pl01"], period, ytd)) == \
        rows(statements.profit_loss(mapped, fx["t_pl01"], period, ytd))
    assert rows(statements.cash_flow(summary, fx["t_cf01"], ytd)) == rows(statements.cash_flow(mapped, fx["t_cf01"], ytd))
