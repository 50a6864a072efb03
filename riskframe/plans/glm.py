"""GLM rating plan over the driver tables: policies → exposure → claims → buckets → n-way.

Parameters follow FIXTURES.md: VEHICLE_AGE bins [0,3,6,10,inf] (years), VEHICLE_SEATS bins
[0,6,9,inf] (seats), VEHICLE_VALUE bins [0,4e8,8e8,1.2e9,inf] (amount labels); text factors
TYPE_VEHICLE, USAGE_CODE, PROVINCE; coverage codes AC01 (odd supplier) / AC02 (even supplier).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.buckets import INF, amount_labels, bucketize_all, unit_labels
from riskframe.functions.money import to_money
from riskframe.operators.claims import KEYS, attach_claims
from riskframe.operators.exposure import split_exposure
from riskframe.sources.fixtures import Fixtures

# Analysis parameters of the registered queries.
BUCKETS = [
    ("VEHICLE_AGE", "VEHICLE_AGE_GROUP", [0, 3, 6, 10, INF], "unit", "years"),
    ("VEHICLE_SEATS", "VEHICLE_SEATS_GROUP", [0, 6, 9, INF], "unit", "seats"),
    ("VEHICLE_VALUE", "VEHICLE_VALUE_GROUP", [0, 4e8, 8e8, 1.2e9, INF], "amount", ""),
]
TEXT_FACTORS = ["TYPE_VEHICLE", "USAGE_CODE", "PROVINCE"]
FACTORS = ["VEHICLE_AGE_GROUP", "VEHICLE_SEATS_GROUP", "VEHICLE_VALUE_GROUP", *TEXT_FACTORS]
CODES = [("AC01", "Odd supplier benefit"), ("AC02", "Even supplier benefit")]
ANALYSIS_YEAR = 1997


def bucket_labels(target: str) -> list[str]:
    for _, tgt, edges, kind, unit in BUCKETS:
        if tgt == target:
            return (amount_labels(edges) if kind == "amount" else unit_labels(edges, unit))[1]
    raise KeyError(target)


def code_conditions() -> dict:
    supp = F.element_at(F.split(F.col("CLAIM_ID"), "-"), 4).cast("long")
    return {"AC01": supp % 2 == 1, "AC02": supp % 2 == 0}


def policy_years(fx: Fixtures, years=None, dealt: bool = False) -> DataFrame:
    """``dealt``: policies are partitioned by their keys before they are split, so the rows of their years need no shuffle by key."""
    return split_exposure(fx["v_policy"].repartition(*KEYS) if dealt else fx["v_policy"], years)


def glm_table(fx: Fixtures, with_codes: bool = False) -> DataFrame:
    """The combined GLM table: one row per kept policy-year with claim totals and factor labels.

    Money stays exact: EXPOSURE_PREM is rounded half-up to 4 decimals (the ledger's unit) and
    kept as DECIMAL(20,4), so every later sum is exact and independent of partitioning.
    """
    py = policy_years(fx)
    comb = attach_claims(py, fx["v_claim"], codes=code_conditions() if with_codes else None, with_sequence=False)
    comb = comb.withColumns({
        "CAL_YEAR": F.col("CL_YEAR"),
        "EXPOSURE_PREM": to_money(F.col("EXPOSURE_PREM")),
    })
    return bucketize_all(comb, BUCKETS)
