from decimal import Decimal

from pyspark.sql import functions as F

from riskframe.operators.nway import NWaySpec, combinations, n_way, year_list

SCHEMA = ("CAL_YEAR int, POLICY_ID string, A string, B string, NUM_CLAIMS long, CLAIM_PMT decimal(20,4), "
          "EXPOSURE_YEAR double, EXPOSURE_PREM decimal(20,4), VEHICLE_VALUE decimal(20,4)")


def test_year_list_and_combinations():
    assert year_list([2015, 2017]) == [2015, 2016, 2017]
    assert year_list([2017, 2015]) == [2017]
    assert year_list([2016, 2015, 2016]) == [2015, 2016]
    assert combinations(["a", "b", "c"], 2) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert combinations(["a", "b"], 1) == [("a",), ("b",)]


def _table(spark):
    rows = [
        (2020, "p1", "x", "u", 1, Decimal("100"), 0.5, Decimal("50"), Decimal("1000")),
        (2021, "p1", "y", "u", 0, None, 0.5, Decimal("50"), Decimal("1000")),     # same policy, other group
        (2020, "p2", "x", "v", 2, Decimal("300"), 1.0, Decimal("200"), Decimal("2000")),
        (2020, "p3", "y", None, 0, None, 0.0, Decimal("0"), Decimal("10")),         # zero exposure
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_one_way_all_years_first_row_dedup(spark):
    out = {r.VAR_DETAIL: r for r in n_way(_table(spark), NWaySpec(factors=["A"], years=[0])).collect()}
    x, y = out["x"], out["y"]
    # p1's exposure goes only to the group of its first row (2020 → x); claims count everywhere
    assert (x.NUM_POLS, x.NUM_CLAIMS, x.EXPOSURE_YEAR, x.EXPOSURE_PREM) == (2, 3, 1.5, Decimal("250.0000"))
    assert (y.NUM_POLS, y.NUM_CLAIMS, y.EXPOSURE_YEAR, y.EXPOSURE_PREM) == (2, 0, 0.0, Decimal("0.0000"))
    assert x.FREQUENCY == 2.0 and x.SEVERITY == round(400 / 3, 6) and x.LOSS_RATIO == 1.6
    assert y.FREQUENCY == 0.0 and y.AVG_PREMIUM == 0.0          # 0/0 → 0
    assert x["GWP_%"] == 1.0 and y["GWP_%"] == 0.0
    assert x.VAR_NAME_CODE == "001_A" and x.VAR_YEAR == 0 and x.CLAIM_PMT == Decimal("400")


def test_null_factor_dropped_and_labels(spark):
    res = n_way(_table(spark), NWaySpec(factors=["A", "B"], n=2, years=[2020])).collect()
    assert {(r.VAR_DETAIL1, r.VAR_DETAIL2) for r in res} == {("x", "u"), ("x", "v")}
    assert {r.VAR_NAME_CODE for r in res} == {"001: A & B"}


def test_code_suffix(spark):
    t = _table(spark).withColumns({"NUM_CLAIMS_AC01": F.col("NUM_CLAIMS"), "CLAIM_PMT_AC01": F.col("CLAIM_PMT")})
    r = n_way(t, NWaySpec(factors=["A"], years=[2020], code="AC01", description="Glass")).collect()
    assert {x.VAR_NAME_CODE for x in r} == {"001_A: AC01"} and {x.VAR_NAME for x in r} == {"A: Glass"}


def test_grouping_sets_equal_per_combination(spark):
    """The single GROUPING SETS plan gives the same rows as one plan per combination."""
    t = _table(spark)
    together = n_way(t, NWaySpec(factors=["A", "B"], n=1, years=[2020, 2021]))
    one_by_one = [n_way(t, NWaySpec(factors=["A", "B"], combos=[c], years=[y])) for c in [("A",), ("B",)]
                  for y in (2020, 2021)]
    cols = [c for c in together.columns if c != "VAR_NAME_CODE"]
    a = sorted(tuple(r) for r in together.select(*cols).collect())
    b = sorted(tuple(r) for df in one_by_one for r in df.select(*cols).collect())
    assert a == b


def test_rating_tables_request(spark):
    from riskframe.operators.nway import rating_tables
    t = _table(spark).withColumn("VEHICLE_AGE", F.lit(4)).withColumn("NUM_CLAIMS_AC01", F.col("NUM_CLAIMS")) \
        .withColumn("CLAIM_PMT_AC01", F.col("CLAIM_PMT"))
    out = rating_tables(t, "CAR", ["A", "VEHICLE_AGE_GROUP"], 2, [2020, 2021],
                        group_settings={"VEHICLE_AGE_GROUP": {"bin": [0, 3, 6, "Infinity"], "unit": "years"}},
                        codes=[("AC01", "Glass")]).collect()
    assert {r.VAR_YEAR for r in out} == {2020, 2021}
    assert {r.VAR_NAME_CODE for r in out} == {"001: A & VEHICLE_AGE_GROUP: AC01", "001: A & VEHICLE_AGE_GROUP"}
    assert {r.VAR_DETAIL2 for r in out} == {"02-From 3 to 5 years: Glass", "02-From 3 to 5 years"}


def test_policies_of_few_and_of_many_tuples_count_once_a_group(spark, monkeypatch):
    """Policies of one, of several and of very many factor tuples, and a null policy, against the definition;
    with one tuple each, nothing is grouped by policy after the policies' own shuffle."""
    import random

    from riskframe.operators import nway
    rnd = random.Random(3)
    rows = [(2020 + rnd.randint(0, 1), f"p{p}" if p else None, rnd.choice(["x", "y", None]), rnd.choice("uvw"), 1, Decimal(rnd.randint(1, 9)), 0.5, Decimal("50"), Decimal("10"))
            for p in range(60) for _ in range(rnd.choice([1, 2, 3, 40]))]
    t = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for y, p, a, b, *_ in rows:
        for scope in (0, y):
            for combo, v in (("001_A", a), ("002_B", b)):
                if v is not None:
                    want.setdefault((scope, combo, v), set()).add(p)
    for most in (1, 3, 64):
        monkeypatch.setattr(nway, "OWN_TUPLES", most)
        got = n_way(t, NWaySpec(factors=["A", "B"], years=[0, 2020, 2021])).collect()
        assert {(r.VAR_YEAR, r.VAR_NAME_CODE, r.VAR_DETAIL): r.NUM_POLS for r in got} == {k: len(v - {None}) for k, v in want.items()}
        assert sum(r.NUM_CLAIMS for r in got if r.VAR_YEAR == 0 and r.VAR_NAME_CODE == "002_B") == len(rows)


def test_rows_are_added_up_before_they_are_expanded(spark):
    from pyspark.sql import functions as F
    t = spark.range(2000).select(F.lit(2020).alias("CAL_YEAR"), F.col("id").cast("string").alias("POLICY_ID"), F.lit("x").alias("A"), F.lit("u").alias("B"), F.lit(1).cast("long").alias("NUM_CLAIMS"),
                                 F.lit(1).cast("decimal(20,4)").alias("CLAIM_PMT"), F.lit(0.5).alias("EXPOSURE_YEAR"), F.lit(1).cast("decimal(20,4)").alias("EXPOSURE_PREM"), F.lit(1).cast("decimal(20,4)").alias("VEHICLE_VALUE"))
    plan = n_way(t, NWaySpec(factors=["A", "B"], years=[2020]))._jdf.queryExecution().optimizedPlan().toString()
    steps = [x.strip(" :+-") for x in plan.splitlines()]
    generate = next(i for i, x in enumerate(steps) if x.startswith("Generate explode") and "_combo" in x)
    below = next(x for x in steps[generate + 1:] if x.startswith(("Aggregate", "Window")))
    assert below.startswith("Aggregate")
