"""MOF report plans over the driver tables: PNT-11 and the financial statements.

Parameters follow FIXTURES.md: report period QUARTERLY 3 of 1997 (YTD Jan 1 … Sep 30), PNT-11
vehicle-age bins [0,3,6,10,inf] in years (Vietnamese labels), opening balance = trial balance of
the 1996 journal, reserves from template RES_PNT_11_02 (with opening columns).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from riskframe.functions.buckets import INF
from riskframe.operators import ledger, pnt11
from riskframe.sources.fixtures import Fixtures

# Report parameters of the registered queries.
AGE_EDGES = [0, 3, 6, 10, INF]
AGE_UNIT = "năm"
REPORT = (1997, "QUARTERLY", 3)


def mapped(fx: Fixtures, view: str, coverage_col: str = "COVERAGE_ID") -> DataFrame:
    return pnt11.apply_mapping(fx[view], fx["m_coverage"], fx["m_vehicle"], AGE_EDGES, AGE_UNIT,
                               coverage_col=coverage_col)


def segments(fx: Fixtures) -> pnt11.Segments:
    return pnt11.Segments(fx["m_coverage"], fx["m_vehicle"], AGE_EDGES, AGE_UNIT)


def keyed(fx: Fixtures, view: str, sg: pnt11.Segments, coverage_col: str = "COVERAGE_ID") -> DataFrame:
    return fx[view].withColumn("_SEG", sg.seg(coverage_col))


def periods():
    y, code, v = REPORT
    return ledger.report_period(y, code, v, False), ledger.report_period(y, code, v, True)


# The ledger periods of the statements: the year to the report's end, and the year before it.
LEDGER_PERIOD = (dt.date(1997, 1, 1), dt.date(1997, 9, 30))
OPENING_PERIOD = (dt.date(1996, 1, 1), dt.date(1996, 12, 31))


def gl_mapped(fx: Fixtures, period: tuple[dt.date, dt.date] = LEDGER_PERIOD) -> DataFrame:
    return ledger.map_accounts(ledger.filter_period(fx["v_gl"], *period), fx["v_account"])


def trial_balance(fx: Fixtures, opening: bool = False) -> DataFrame:
    op = ledger.trial_balance(gl_mapped(fx, OPENING_PERIOD)) if opening else None
    return ledger.trial_balance(gl_mapped(fx), op)
