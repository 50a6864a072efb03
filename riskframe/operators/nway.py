"""One- to four-way rating-factor tables.

Per (year, combination of factors, factor values):

* NUM_POLS = distinct policies, NUM_CLAIMS = Σ claims, CLAIM_PMT = Σ payments, over all rows;
* EXPOSURE_YEAR, EXPOSURE_PREM, SUM_ASSURED = sums over the *first* row of each policy in the
  year scope (so a policy with rows in two groups gives its exposure to the group of its first row);
* FREQUENCY, SEVERITY, AVG_PREMIUM, AVG_SUM_ASSURED, PURE_PREMIUM, LOSS_RATIO and GWP_% (share of
  the exposure premium of this (year, combination)); half-even rounding as the reference.

Plan shape (one job and one scan for every combination × year):

1. ``groupBy(scope, policy, factor tuple)``: claim sums and the tuple's first row. Partial
   aggregation reduces a policy that holds a third of all rows before the shuffle;
2. in one partitioning by (scope, policy), streamed policy by policy: the first tuple carries the
   policy's exposure, and each tuple is marked with the combinations in which no earlier tuple of the
   policy has its values, so that a policy counts once per group without being expanded. (A policy of
   more than ``OWN_TUPLES`` tuples keeps its name and is counted by it.);
3. rows of equal factor values and marks are added up before ``explode`` emits their (combination,
   values) groups: what a task holds depends on the factor values, not on the number of policies.

Decisions: division by zero gives 0 (the reference keeps ±inf for x/0; inf poisons later sums);
null factor values are dropped per combination (pandas ``dropna``); the order of "first" is
explicit (``order_by``), ties broken by the row's values so results are deterministic.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskframe.functions.numeric import round_half_even

METRIC_COLUMNS = ["NUM_POLS", "NUM_CLAIMS", "EXPOSURE_YEAR", "EXPOSURE_PREM", "CLAIM_PMT", "FREQUENCY",
                  "SEVERITY", "AVG_PREMIUM", "PURE_PREMIUM", "LOSS_RATIO", "GWP_%", "SUM_ASSURED",
                  "AVG_SUM_ASSURED"]


# Exposure is added up in units of 1e-12 years: exact, whatever the partitioning.
YEARS = "decimal(20,12)"

# Tuples of a policy that are compared within its own partition; policies of more keep their name and are counted by it.
OWN_TUPLES = 64
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


@dataclass(frozen=True)
class Product:
    """which column counts policies and which is the sum assured."""
    count_col: str
    sum_assured: str

    @staticmethod
    def of(name: str) -> "Product":
        return {"CAR": Product("POLICY_ID", "VEHICLE_VALUE"),
                "HEALTH": Product("CERTIFICATE_ID", "SUM_ASSURED")}[name.upper()]


@dataclass
class NWaySpec:
    factors: Sequence[str]                  # the candidate rating factors, in list order
    n: int = 1                              # 1..4-way
    years: Sequence[int] = (0,)             # 0 = all years together
    product: str = "CAR"
    code: str | None = None                 # additional coverage code, e.g. "AC01"
    description: str | None = None
    combos: Sequence[Sequence[str]] | None = None   # explicit combinations (3/4-way options)
    order_by: Sequence[str] = field(default_factory=lambda: ["CAL_YEAR"])
    year_col: str = "CAL_YEAR"


def year_list(raw: Sequence[int]) -> list[int]:
    """[a, b] with a < b → a..b; [a, b] otherwise → [a]; anything else → distinct values."""
    raw = [int(x) for x in raw]
    if len(raw) == 2:
        return list(range(raw[0], raw[1] + 1)) if raw[0] < raw[1] else [raw[0]]
    return sorted(set(raw))


def combinations(factors: Sequence[str], n: int) -> list[tuple[str, ...]]:
    """n-combinations in list order (n = 1: the list itself)."""
    if n == 1:
        return [(f,) for f in factors]
    return list(itertools.combinations(factors, n))


def _ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 when the quotient is undefined (0/0, x/0, null)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def n_way(df: DataFrame, spec: NWaySpec, codes: Sequence[tuple[str | None, str | None]] | None = None) -> DataFrame:
    """Rating table for every combination × year in one plan (see module doc).

    Output: VAR_YEAR, VAR_NAME_CODE, VAR_NAME1..n, VAR_DETAIL1..n (VAR_NAME / VAR_DETAIL for n = 1)
    followed by METRIC_COLUMNS. VAR_NAME_CODE numbers combinations ``001``, ``002``, … in order.

    ``codes`` = [(code, description), …] (``None`` code = all benefits) tables several claim
    measures in the same pass: their sums are aggregated side by side, and the result is stacked to one row per code with ``explode``.
    """
    prod = Product.of(spec.product)
    combos = [tuple(c) for c in (spec.combos or combinations(spec.factors, spec.n))]
    if not combos:
        raise ValueError("no factor combination to analyse")
    n = len(combos[0])
    if any(len(c) != n for c in combos):
        raise ValueError("all combinations must have the same size")
    factors = list(dict.fromkeys(f for c in combos for f in c))
    years = list(spec.years)
    specific = [y for y in years if y != 0]
    measures = list(codes) if codes is not None else [(spec.code, spec.description)]
    cols = lambda c: (f"NUM_CLAIMS_{c}", f"CLAIM_PMT_{c}") if c else ("NUM_CLAIMS", "CLAIM_PMT")
    claim_cols = list(dict.fromkeys(x for c, _ in measures for x in cols(c)))
    yc, cnt, sa = spec.year_col, prod.count_col, prod.sum_assured

    base = df.select(F.col(yc).cast("int").alias(yc), *factors, cnt, *claim_cols, F.col("EXPOSURE_YEAR").cast(YEARS).alias("EXPOSURE_YEAR"),
                     "EXPOSURE_PREM", sa, *[c for c in spec.order_by if c not in (yc, *factors, cnt)])
    if 0 not in years:
        base = base.filter(F.col(yc).isin(specific))

    # --- one record per (scope, policy, factor tuple): claim sums and the tuple's first row ------
    scopes = [F.when(F.col(yc).isin(specific), F.col(yc))] if specific else []
    scopes += [F.lit(0)] if 0 in years else []
    scoped = base.withColumn("VAR_YEAR", F.explode(F.array_compact(F.array(*scopes))) if len(scopes) > 1 else scopes[0])
    order_cols = [*spec.order_by, *factors, "EXPOSURE_YEAR", "EXPOSURE_PREM", sa]
    order = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    sums = [f"_s_{x}" for x in claim_cols]
    tuples = scoped.groupBy("VAR_YEAR", cnt, *factors) \
        .agg(F.min(order).alias("_o"), *[F.sum(x).alias(y) for x, y in zip(claim_cols, sums, strict=True)])
    # --- in the policy's own partition: its first tuple gives the exposure, and every tuple learns in which
    # of its groups the policy is new, so it counts there alone; policies of very many tuples keep their name -----
    own = Window.partitionBy("VAR_YEAR", cnt).orderBy("_o")
    vs = [f"_v{i + 1}" for i in range(n)]
    exposure = {c: f"o{len(order_cols) - 3 + i}" for i, c in enumerate(("EXPOSURE_YEAR", "EXPOSURE_PREM", "SUM_ASSURED"))}
    values = F.struct(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)])
    placed = tuples.withColumns({"_rank": F.row_number().over(own), "_tuples": F.count(F.lit(1)).over(own.rowsBetween(*WHOLE))})
    several = F.col("_tuples").between(2, OWN_TUPLES)
    placed = placed.withColumn("_all", F.collect_list(F.when(several, values)).over(own.rowsBetween(*WHOLE)))
    is_new = lambda combo: ~F.exists(F.slice("_all", F.lit(1), F.col("_rank") - 1),
                                     lambda t: _all_of([t[f"f{factors.index(f)}"].eqNullSafe(F.col(f).cast("string")) for f in combo]))
    hot = F.col("_tuples") > OWN_TUPLES
    reduced = placed.select(
        "VAR_YEAR", *factors, *sums, F.col(cnt).alias("_id"), hot.alias("_hot"), F.when(hot, F.col(cnt)).alias("_policy"),
        F.when(several & (F.col("_rank") > 1), F.array(*[is_new(c) for c in combos])).alias("_new"),
        *[F.when(F.col("_rank") == 1, F.col(f"_o.{o}")).alias(c) for c, o in exposure.items()])
    add = [F.sum(c).alias(c) for c in (*sums, *exposure)]
    reduced = reduced.groupBy("VAR_YEAR", *factors, "_hot", "_policy", "_new").agg(F.count("_id").alias("_n"), *add)
    # --- the groups of what is left; a policy that kept its name counts once a group -------------------
    groups = F.array(*[F.struct(F.lit(k).alias("_combo"), *[F.col(c).cast("string").alias(v) for c, v in zip(combo, vs, strict=True)],
                                F.when(F.coalesce(F.col("_new")[k], F.lit(True)), F.col("_n")).otherwise(F.lit(0)).alias("_count"))
                       for k, combo in enumerate(combos)])
    emitted = reduced.select("VAR_YEAR", "_hot", "_policy", *sums, *exposure, F.explode(groups).alias("_g")) \
        .select("*", "_g.*").drop("_g").dropna(subset=vs)
    keys = ["VAR_YEAR", "_combo", *vs]
    pols = F.sum(F.when(F.col("_hot"), F.col("_policy").isNotNull().cast("long")).otherwise(F.col("_count")))
    joined = emitted.groupBy("_hot", "_policy", *keys).agg(F.sum("_count").alias("_count"), *add) \
        .groupBy(*keys).agg(pols.alias("NUM_POLS"), *add).withColumn("EXPOSURE_YEAR", F.col("EXPOSURE_YEAR").cast("double"))

    stacked = F.array(*[F.struct(F.lit(c).cast("string").alias("_code"), F.lit(d).cast("string").alias("_desc"),
                                 F.col(f"_s_{cols(c)[0]}").alias("NUM_CLAIMS"), F.col(f"_s_{cols(c)[1]}").alias("CLAIM_PMT"))
                        for c, d in measures])
    joined = joined.select("*", F.explode(stacked).alias("_m")).select("*", "_m.*").drop("_m")
    return _finish(joined, combos, n, spec)


def _finish(df: DataFrame, combos, n: int, spec: NWaySpec) -> DataFrame:
    suffix = F.when(F.col("_code").isNull(), F.lit("")).otherwise(F.concat(F.lit(": "), F.col("_code")))
    dsuffix = F.when(F.col("_code").isNull(), F.lit("")).otherwise(F.concat(F.lit(": "), F.col("_desc")))
    code_expr = None
    name_exprs = [None] * n
    for idx, combo in enumerate(combos):
        var_code = f"{idx + 1:03d}"
        label = f"{var_code}_{combo[0]}" if n == 1 else f"{var_code}: {' & '.join(combo)}"
        cond = F.col("_combo") == F.lit(idx)
        code_expr = F.when(cond, F.lit(label)) if code_expr is None else code_expr.when(cond, F.lit(label))
        for i in range(n):
            e = F.lit(combo[i])
            name_exprs[i] = F.when(cond, e) if name_exprs[i] is None else name_exprs[i].when(cond, e)
    ey, ep = F.col("EXPOSURE_YEAR"), F.col("EXPOSURE_PREM")
    nc = F.coalesce(F.col("NUM_CLAIMS"), F.lit(0))
    cp = F.coalesce(F.col("CLAIM_PMT"), F.lit(0))
    share_w = Window.partitionBy("VAR_YEAR", "_combo", "_code")
    freq = _ratio(nc, ey)
    sev = _ratio(cp, nc)
    metrics = {
        "NUM_POLS": F.col("NUM_POLS").cast("long"),
        "NUM_CLAIMS": nc.cast("long"),
        "EXPOSURE_YEAR": round_half_even(F.coalesce(ey, F.lit(0.0)), 6),
        # money stays exact: decimal sums, no float rounding noise
        "EXPOSURE_PREM": F.coalesce(ep, F.lit(0)).cast("decimal(38,4)"),
        "CLAIM_PMT": F.bround(cp, 0).cast("decimal(38,0)"),  # exact decimal rounding
        "FREQUENCY": round_half_even(freq, 6),
        "SEVERITY": round_half_even(sev, 6),
        "AVG_PREMIUM": round_half_even(_ratio(ep, ey), 6),
        "PURE_PREMIUM": round_half_even(freq * sev, 6),
        "LOSS_RATIO": round_half_even(_ratio(cp, ep), 6),
        "GWP_%": round_half_even(_ratio(ep, F.sum(ep).over(share_w)), 6),
        "SUM_ASSURED": F.coalesce(F.col("SUM_ASSURED"), F.lit(0)).cast("decimal(38,4)"),
        # unrounded in the reference; 2 decimals keep it independent of float summation order
        "AVG_SUM_ASSURED": round_half_even(_ratio(F.col("SUM_ASSURED"), ey), 2),
    }
    if n == 1:
        labels = [F.concat(name_exprs[0], dsuffix).alias("VAR_NAME"), F.concat(F.col("_v1"), dsuffix).alias("VAR_DETAIL")]
    else:
        labels = [F.concat(name_exprs[i], dsuffix).alias(f"VAR_NAME{i + 1}") for i in range(n)]
        labels += [F.concat(F.col(f"_v{i + 1}"), dsuffix).alias(f"VAR_DETAIL{i + 1}") for i in range(n)]
    return df.select(F.col("VAR_YEAR").cast("int").alias("VAR_YEAR"), F.concat(code_expr, suffix).alias("VAR_NAME_CODE"),
                     *labels, *[v.alias(k) for k, v in metrics.items()])


def n_way_codes(df: DataFrame, spec: NWaySpec, codes: Sequence[tuple[str, str]]) -> DataFrame:
    """the table for each additional coverage code (suffix ``: <code>``) plus the all-benefit
    table without suffix (the reference's ``: None`` label on that run is not reproduced), all
    from one scan and one pair of aggregations."""
    return n_way(df, spec, codes=[*codes, (None, None)])


def factor_domain(df: DataFrame, factor: str, labels: Sequence[str] | None = None) -> DataFrame:
    """The categories of one factor over the whole table (not a year slice) as one column
    ``VALUE``: a bucket's label list, plus whatever other value (``NaN``) the rows have, or the
    distinct values of a text factor."""
    seen = df.select(F.col(factor).cast("string").alias("VALUE")).where(F.col("VALUE").isNotNull()).distinct()
    return seen if labels is None else seen.unionByName(_values(df, labels)).distinct()


def _values(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("VALUE"))


def complete_groups(result: DataFrame, domains: Sequence[DataFrame | Sequence[str]], years: Sequence[int],
                    var_code: str, names: Sequence[str]) -> DataFrame:
    """F11 (pandas categorical ``observed=False``): every label combination of one n-way table
    appears, zero-filled. A domain is a column of categories (:func:`factor_domain`) or a label
    list. The grid, which is the result's own size, is built in Spark by joining the domains on
    the year; groups outside the domains stay."""
    n = len(domains)
    detail_cols = ["VAR_DETAIL"] if n == 1 else [f"VAR_DETAIL{i + 1}" for i in range(n)]
    all_years = F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("VAR_YEAR")
    grid = None
    for domain, col in zip(domains, detail_cols, strict=True):
        values = domain if isinstance(domain, DataFrame) else _values(result, domain)
        side = values.select(all_years, F.col("VALUE").alias(col))
        grid = side if grid is None else grid.join(side, "VAR_YEAR")
    name_cols = {"VAR_NAME": F.lit(names[0])} if n == 1 else {f"VAR_NAME{i + 1}": F.lit(names[i]) for i in range(n)}
    grid = grid.withColumns({"VAR_NAME_CODE": F.lit(var_code), **name_cols})
    cols = result.columns
    out = grid.join(result, ["VAR_YEAR", "VAR_NAME_CODE", *name_cols.keys(), *detail_cols], "full")
    fills = {c: F.coalesce(F.col(c), F.lit(0).cast(dict(result.dtypes)[c])) for c in METRIC_COLUMNS}
    return out.withColumns(fills).select(*cols)


def rating_tables(df: DataFrame, product: str, factors: Sequence[str], n: int, cal_years: Sequence[int],
                  group_settings: dict[str, dict] | None = None, options: Sequence[Sequence[str]] | None = None,
                  codes: Sequence[tuple[str, str]] | None = None, order_by: Sequence[str] = ("CAL_YEAR",)) -> DataFrame:
    """F8/F9/E5 as one call, shaped like a rating request: bucket the ``*_GROUP`` factors from
    their settings, expand the year list ([a, b] → a..b), take all n-combinations of ``factors``
    (or the explicit ``options`` for 3/4-way tables, B19), and table every combination × year —
    per additional coverage code plus all benefits when ``codes`` are given — in one plan."""
    from riskframe.functions.buckets import bucketize_from_settings
    table = bucketize_from_settings(df, group_settings) if group_settings else df
    spec = NWaySpec(factors=list(factors), n=n, years=year_list(cal_years), product=product,
                    combos=[tuple(o) for o in options] if options else None, order_by=list(order_by))
    return n_way_codes(table, spec, codes) if codes else n_way(table, spec)
