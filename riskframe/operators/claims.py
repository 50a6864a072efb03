"""Claim preparation and attachment to policy-year exposure rows.

The reference builds, per (POLICY_ID, CERTIFICATE_ID, LD_YEAR), a dict of all claims and splits it
row by row into in-period / out-of-period dicts. Collecting every claim of a key into one value
breaks on a hot key (a fleet policy can own a third of all claims), so here claims are first
summed per occurrence date (at most 366 per key, year and salt), and the
intervals are matched against those dates inside the joined row. The per-claim table
(``claims_in_sequence``) is the exploded form of the reference's maps.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskframe.functions.money import to_money
from riskframe.operators.skew import SALT, HotKeys
from riskframe.operators.validate import key_counts
from riskframe.session import KEEP_PARTITIONING, RELEASE_SHUFFLES, configured
from riskframe.sources.sinks import remove

KEYS = ["POLICY_ID", "CERTIFICATE_ID"]


def prepare_claims(df: DataFrame, cal_year: int | None = None, date_format: str = "M-d-yyyy") -> DataFrame:
    """Parse text dates (``%m-%d-%Y``, bad → null), numeric CLAIM_COST, LD_YEAR; keep one year.

    Fixed: REG_NO stays text (the reference coerced plates to numbers, i.e. to null).
    """
    out = df
    for c in ("INIT_DATE", "OCCURENCE_DATE", "REPORT_DATE", "PAYMENT_DATE"):
        if c in df.columns and dict(df.dtypes)[c] == "string":
            out = out.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c), F.lit(date_format))))
    if "CLAIM_COST" in df.columns:
        out = out.withColumn("CLAIM_COST", F.col("CLAIM_COST").try_cast("double"))
    for c in ("CLAIM_DESCRIPTION", "TYPE_CAUSE", "POLICY_ID", "CERTIFICATE_ID"):
        if c in df.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    out = out.withColumn("LD_YEAR", F.year("OCCURENCE_DATE"))
    if cal_year is not None:
        out = out.filter(F.col("LD_YEAR") == int(cal_year))
    return out


def _usable(claims: DataFrame, amount: str) -> DataFrame:
    """Non-negative claims with a complete key and year."""
    return claims.filter(F.col(amount) >= 0).withColumn("LD_YEAR", F.year("OCCURENCE_DATE")) \
        .filter(F.col("POLICY_ID").isNotNull() & F.col("CERTIFICATE_ID").isNotNull() & F.col("LD_YEAR").isNotNull())


def claim_rows(claims: DataFrame, amount: str = "CLAIM_PMT") -> DataFrame:
    """Non-negative claims with LD_YEAR and non-null keys, one row per (keys, LD_YEAR, CLAIM_ID).

    A repeated CLAIM_ID within a key keeps one entry (the reference's dict keeps the last one in
    file order; without a file order we keep the latest occurrence, then the largest amount).
    Dedup is a plain aggregation, so partial aggregation absorbs hot keys.
    """
    c = _usable(claims, amount)
    keyed = c.filter(F.col("CLAIM_ID").isNotNull())
    last = F.max_by(F.struct("OCCURENCE_DATE", amount), F.struct("OCCURENCE_DATE", amount))
    dedup = (keyed.groupBy(*KEYS, "LD_YEAR", "CLAIM_ID").agg(last.alias("_v"))
                  .select(*KEYS, "LD_YEAR", "CLAIM_ID", "_v.OCCURENCE_DATE", F.col(f"_v.{amount}").alias(amount)))
    # claims without an id cannot be map keys but still count in the totals (count() skips them)
    return dedup.unionByName(c.filter(F.col("CLAIM_ID").isNull())
                              .select(*KEYS, "LD_YEAR", "CLAIM_ID", "OCCURENCE_DATE", amount))


def group_claims(claims: DataFrame, amount: str = "CLAIM_PMT") -> DataFrame:
    """per (POLICY_ID, CERTIFICATE_ID, LD_YEAR): NUM_CLAIMS = count of non-null CLAIM_ID
    (before dedup, as the reference counts rows), CLAIM_PMT = sum. Null keys are dropped."""
    c = _usable(claims, amount)
    return c.groupBy(*KEYS, "LD_YEAR").agg(F.count("CLAIM_ID").alias("NUM_CLAIMS"),
                                           F.sum(amount).alias(amount))


def _intervals(policy_years: DataFrame) -> DataFrame:
    return policy_years.select(*KEYS, F.col("CL_YEAR").alias("LD_YEAR"), "START_SEQ", "END_SEQ").distinct()


#: Claims of one (policy, certificate, year) that a task reads at most, about; more are spread over salts.
HOT_CLAIMS = 100_000
#: Tasks that the claims of one (policy, certificate, year) are dealt to by their ids when they are summed.
DATE_SALTS = 64
#: Claims in one map, about.
MAP_CLAIMS = 1_000


def _by_claim(amount: str) -> list:
    return ["CLAIM_ID", "OCCURENCE_DATE", amount]


def claims_in_sequence(policy_years: DataFrame, claims: DataFrame, amount: str = "CLAIM_PMT",
                       hot_claims: int = HOT_CLAIMS) -> DataFrame:
    """D8/F16 at claim level: each claim against each exposure interval of its policy-year,
    with ``IN_SEQ`` = START_SEQ <= OCCURENCE_DATE <= END_SEQ (closed both ends).

    A policy-year with more than ``hot_claims`` claims is spread: its claims are dealt to salts by date
    and id, and its intervals alone are repeated per salt."""
    key = [*KEYS, "LD_YEAR"]
    hot = HotKeys(_usable(claims, amount), key, hot_claims)
    j = hot.join(claim_rows(claims, amount), _intervals(policy_years), _by_claim(amount))
    return j.withColumn("IN_SEQ", F.col("OCCURENCE_DATE").between(F.col("START_SEQ"), F.col("END_SEQ")))


def claim_maps(policy_years: DataFrame, claims: DataFrame, amount: str = "CLAIM_PMT",
               map_claims: int = MAP_CLAIMS) -> DataFrame:
    """F14/F16/D7 as maps: per policy-year interval the claims inside and outside of it, as maps from
    CLAIM_ID to the amount (``IN_SEQ``, ``NOT_SEQ``) beside the map of all (``CLAIM_OCCURENCE``: id to
    date and amount).

    A policy-year with more than ``map_claims`` claims has several rows per interval, numbered by
    ``CHUNK``: ids are dealt by hash, so a map holds about that many claims however many the
    policy has, and the maps of all chunks together hold every claim once. Claims without an
    id cannot be map keys and are left out (``claims_in_sequence`` has them).
    """
    key = [*KEYS, "LD_YEAR"]
    rows = claim_rows(claims.where("CLAIM_ID is not null"), amount)
    hot = HotKeys(_usable(claims, amount), key, map_claims)
    entry = F.struct("CLAIM_ID", F.struct("OCCURENCE_DATE", amount).alias("v"))
    maps = hot.dealt(rows, _by_claim(amount)).groupBy(*key, SALT).agg(F.map_from_entries(F.collect_list(entry)).alias("CLAIM_OCCURENCE"))
    j = maps.join(hot.repeated(_intervals(policy_years)), [*key, SALT])

    def amounts(keep):
        return F.transform_values(F.map_filter("CLAIM_OCCURENCE", keep), lambda _, v: v[amount])

    def inside(_, v):
        return v["OCCURENCE_DATE"].between(F.col("START_SEQ"), F.col("END_SEQ"))

    return j.select(*key, F.col(SALT).alias("CHUNK"), "START_SEQ", "END_SEQ", "CLAIM_OCCURENCE",
                    amounts(inside).alias("IN_SEQ"), amounts(lambda k, v: ~inside(k, v)).alias("NOT_SEQ"))


def _totals(amount: str, codes: dict[str, object] | None) -> list:
    """Claim count and sum of the rows, in all and per coverage code."""
    out = [F.count("CLAIM_ID").alias("NUM_CLAIMS"), F.sum(amount).alias(amount)]
    for code, cond in (codes or {}).items():
        out += [F.count(F.when(cond, F.col("CLAIM_ID"))).alias(f"NUM_CLAIMS_{code}"), F.sum(F.when(cond, F.col(amount))).alias(f"{amount}_{code}")]
    return out


def _dealt(claims: DataFrame) -> DataFrame:
    """Claims by key, year and salt, with ``_own``: the date of a claim without an id. A claim id has one of ``DATE_SALTS`` salts, so
    a hot key is spread and all rows of a claim meet. Sums by claim and by date need no further shuffle. The rows
    themselves travel: ids seldom repeat, and a row is narrower than the sums that partial aggregation would make of it."""
    own = F.when(F.col("CLAIM_ID").isNull(), F.col("OCCURENCE_DATE"))
    salt = F.pmod(F.xxhash64("CLAIM_ID", "_own"), F.lit(DATE_SALTS)).cast("int")
    return claims.withColumn("_own", own).withColumn("_salt", salt).repartition(*KEYS, "LD_YEAR", "_salt")


def claims_by_year(claims: DataFrame, amount: str = "CLAIM_PMT", codes: dict[str, object] | None = None) -> DataFrame:
    """Per (POLICY_ID, CERTIFICATE_ID, LD_YEAR): the grouped totals of F14 and ``_DATES``, the
    claims after F16's dedup summed per occurrence date and salt (at most 366 * ``DATE_SALTS`` entries).

    Two shuffles: by key, year and salt (sums by claim id, then by date), and of these by key and year.
    """
    c, raw = _usable(claims, amount), _totals(amount, codes)
    totals = ["NUM_CLAIMS", amount, *[f"{x}_{code}" for code in (codes or {}) for x in ("NUM_CLAIMS", amount)]]
    # a claim without an id is no repetition of another: such claims stay apart by date
    by_claim = _dealt(c).groupBy(*KEYS, "LD_YEAR", "_salt", "CLAIM_ID", "_own") \
        .agg(*raw, F.max(F.struct("OCCURENCE_DATE", amount)).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    has_id = F.col("CLAIM_ID").isNotNull()
    again = [F.sum(x).alias(x) for x in totals]
    by_date = by_claim.groupBy(*KEYS, "LD_YEAR", "_salt", F.col("_last.OCCURENCE_DATE").alias("_date")) \
        .agg(*again, F.sum(F.when(has_id, F.lit(1)).otherwise(F.col("_rows"))).alias("_n"),
             F.sum(F.when(has_id, F.col(f"_last.{amount}")).otherwise(F.col(amount))).alias("_amt"))
    return by_date.groupBy(*KEYS, "LD_YEAR").agg(*again, F.collect_list(F.struct("_date", "_n", "_amt")).alias("_DATES"))


def attach_claims(policy_years: DataFrame, claims: DataFrame, amount: str = "CLAIM_PMT",
                  codes: dict[str, object] | None = None, with_sequence: bool = True) -> DataFrame:
    """policy-year rows ⟕ grouped claims on (POLICY_ID, CERTIFICATE_ID, CL_YEAR = LD_YEAR).

    Adds NUM_CLAIMS, CLAIM_PMT (null when the policy-year has no claim) and NUM_CLAIMS_SEQ,
    NUM_CLAIMS_NOT_SEQ (0 when none), CLAIM_PMT_SEQ, CLAIM_PMT_NOT_SEQ (sums of the in / out of
    interval claims). ``codes`` maps a coverage code (e.g. ``AC01``) to a boolean Column over the
    claim rows; for each code NUM_CLAIMS_<code> and CLAIM_PMT_<code> are added in the same pass.

    One join: claims come as one row per key and year with their dates, and the interval is
    matched inside the row. No raw claim is shuffled by the policy-year key.
    """
    key = [*KEYS, "LD_YEAR"]
    py = policy_years.withColumn("LD_YEAR", F.col("CL_YEAR"))
    if not with_sequence:  # totals alone need one aggregate
        return py.join(_usable(claims, amount).groupBy(*key).agg(*_totals(amount, codes)), key, "left").drop("LD_YEAR")
    years = claims_by_year(claims, amount, codes)
    return _in_sequence(py.join(years, key, "left"), years, amount).drop("LD_YEAR")


def _in_sequence(joined: DataFrame, years: DataFrame, amount: str) -> DataFrame:
    """Replace ``_DATES`` by the counts and sums inside and outside of each row's interval."""
    dates = F.coalesce("_DATES", F.array().cast(years.schema["_DATES"].dataType))
    amount_type = years.schema["_DATES"].dataType.elementType["_amt"].dataType

    def inside(d):
        return d["_date"].between(F.col("START_SEQ"), F.col("END_SEQ"))

    new = {}
    for name, keep in (("SEQ", inside), ("NOT_SEQ", lambda d: ~inside(d))):
        hit = F.filter(dates, keep)
        new[f"NUM_CLAIMS_{name}"] = F.aggregate(hit, F.lit(0).cast("long"), lambda x, d: x + d["_n"])
        new[f"{amount}_{name}"] = F.when(F.size(hit) > 0, F.aggregate(hit, F.lit(0).cast(amount_type), lambda x, d: (x + d["_amt"]).cast(amount_type)))
    return joined.withColumns(new).drop("_DATES")


def unmatched_claims(policy_years: DataFrame, claims: DataFrame, amount: str = "CLAIM_PMT") -> DataFrame:
    """Grouped claims whose POLICY_ID never occurs among the policy-year rows (anti join on
    POLICY_ID only, as the reference)."""
    return group_claims(claims, amount).join(policy_years.select("POLICY_ID").distinct(), "POLICY_ID", "left_anti")


def reconcile_claims(policy_years: DataFrame, claims: DataFrame, cal_year: int,
                     amount: str = "CLAIM_PMT") -> DataFrame:
    """Claim-combine reconciliation figures as (metric, value) rows: negative total, totals
    before/after grouping and joining, unmatched, in/out of sequence, premium in/out of year
    (premium as money, so the figures are exact). The claims are read twice: once for the
    combination, once for all figures about the claims alone."""
    a, positive = F.col(amount), F.col(amount) >= 0
    groups = claims.withColumn("LD_YEAR", F.year("OCCURENCE_DATE")).groupBy(*KEYS, "LD_YEAR") \
        .agg(F.sum(F.when(a < 0, a)).alias("_neg"), F.count_if(positive).alias("_rows"), F.sum(F.when(positive, a)).alias("_sum"))
    known = policy_years.select(F.col("POLICY_ID").alias("_known")).distinct()
    grouped = (F.col("_rows") > 0) & F.col("POLICY_ID").isNotNull() & F.col("CERTIFICATE_ID").isNotNull() & F.col("LD_YEAR").isNotNull()
    lost = grouped & F.col("_known").isNull()
    own = groups.join(known, F.col("POLICY_ID") == F.col("_known"), "left").agg(
        F.sum("_neg").alias("claim_negative"),
        F.sum(F.when(grouped, F.col("_sum"))).alias("claim_grouped"), F.count_if(grouped).alias("rows_grouped"),
        F.sum(F.when(lost, F.col("_sum"))).alias("claim_unmatched"), F.count_if(lost).alias("rows_unmatched"),
        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count_if(F.col("_rows") > 0)).alias("dup_claim"))
    both = attach_claims(policy_years, claims, amount).agg(
        F.sum(amount).alias("claim_combined"),
        F.sum(f"{amount}_SEQ").alias("claim_in_sequence"),
        F.sum(f"{amount}_NOT_SEQ").alias("claim_not_in_sequence"),
        F.sum("NUM_CLAIMS_SEQ").alias("num_in_sequence"),
        F.sum("NUM_CLAIMS_NOT_SEQ").alias("num_not_in_sequence"),
        F.sum(F.when(F.col("CL_YEAR") == cal_year, to_money(F.col("EXPOSURE_PREM")))).alias("premium_in_year"),
        F.sum(F.when(F.col("CL_YEAR") != cal_year, to_money(F.col("EXPOSURE_PREM")))).alias("premium_out_of_year"))
    dup = key_counts(policy_years, [*KEYS, "CL_YEAR"]).select(F.col("DUPLICATE_ROWS").alias("dup_gwp"))
    return metric_rows(own, both, dup)


def _all_claim_groups(claims: DataFrame, amount: str) -> DataFrame:
    """``claims_by_year`` over all claims, negative and incomplete ones too: beside its columns the negative sum
    and the count of the other rows of each group, and whether the group takes part in the combination.

    Claims are dealt by policy, and those of a policy with more than ``HOT_CLAIMS`` claims by salt too. Without such
    a policy all sums need that one shuffle; with one, the sums by date and salt meet in a second.
    """
    a, positive = F.col(amount), F.col(amount) >= 0
    own = F.when(F.col("CLAIM_ID").isNull(), F.col("OCCURENCE_DATE"))
    keyed = claims.withColumn("_key", F.xxhash64(*KEYS))  # of keys with nulls too; two policies with one hash are both salted
    hot = HotKeys(keyed, ["_key"], HOT_CLAIMS)
    by = [*KEYS, *[SALT] * (hot.count > 0)]
    c = hot.dealt(keyed, ["CLAIM_ID", own]).select(*by, "CLAIM_ID", "OCCURENCE_DATE", amount).repartition(*by) \
        .withColumns({"LD_YEAR": F.year("OCCURENCE_DATE"), "_own": own})
    has_id = F.col("CLAIM_ID").isNotNull()
    by_claim = c.groupBy(*by, "LD_YEAR", "CLAIM_ID", "_own") \
        .agg(F.count(F.when(positive, F.col("CLAIM_ID"))).alias("NUM_CLAIMS"), F.sum(F.when(positive, a)).alias(amount), F.sum(F.when(a < 0, a)).alias("_neg"),
             F.count_if(positive).alias("_rows"), F.max(F.when(positive, F.struct("OCCURENCE_DATE", amount))).alias("_last"))
    sums = [F.sum(x).alias(x) for x in ("NUM_CLAIMS", amount, "_neg", "_rows")]
    by_date = by_claim.groupBy(*by, "LD_YEAR", F.col("_last.OCCURENCE_DATE").alias("_date")) \
        .agg(*sums, F.sum(F.when(has_id, F.lit(1)).otherwise(F.col("_rows"))).alias("_n"),
             F.sum(F.when(has_id, F.col(f"_last.{amount}")).otherwise(F.col(amount))).alias("_amt"))
    groups = by_date.groupBy(*KEYS, "LD_YEAR").agg(*sums, F.collect_list(F.when(F.col("_date").isNotNull(), F.struct("_date", "_n", "_amt"))).alias("_DATES"))
    complete = F.col("POLICY_ID").isNotNull() & F.col("CERTIFICATE_ID").isNotNull() & F.col("LD_YEAR").isNotNull()
    return groups.withColumn("_grouped", (F.col("_rows") > 0) & complete)


def _light_dates(groups: DataFrame, amount: str) -> DataFrame:
    """Groups as they travel: a list of one date that holds the group's totals goes as ``_day``, that date alone."""
    first = F.get("_DATES", F.lit(0))
    plain = (F.size("_DATES") == 1) & (first["_n"] == F.col("NUM_CLAIMS")) & (first["_amt"] == F.col(amount))
    return groups.withColumns({"_day": F.when(plain, first["_date"]), "_DATES": F.when(F.coalesce(plain, F.lit(False)), F.lit(None)).otherwise(F.col("_DATES"))})


def _whole_dates(joined: DataFrame, groups: DataFrame, amount: str) -> DataFrame:
    """``_DATES`` of all rows again."""
    kind = groups.schema["_DATES"].dataType
    one = F.array(F.struct(F.col("_day").alias("_date"), F.col("NUM_CLAIMS").alias("_n"), F.col(amount).alias("_amt"))).cast(kind)
    return joined.withColumn("_DATES", F.when(F.col("_day").isNotNull(), one).otherwise(F.col("_DATES"))).drop("_day")


def write_combined(policy_years: DataFrame, claims: DataFrame, cal_year: int, path: str, amount: str = "CLAIM_PMT") -> DataFrame:
    """F15 and C13 in one: write the combined table to ``path``/combined and return the figures of
    ``reconcile_claims`` as (metric, value) rows.

    Claims and policy-years are each read once. The claims' own columns are written aside, the claim groups made of
    them to ``path``/claim_groups and the combination to ``path``/combined; each write gives its shuffle files back
    before the next begins, and the claims aside go once they are grouped, so the disk holds one step's shuffles at
    a time. The writes of claims and combination observe figures of what they write (in the writing stage, whose
    tasks count once even if they are run again). The others are found from columns of what is written.

    Policy-years that are partitioned by ``KEYS`` (policies dealt before they are split) stay there, and the groups go to them.
    """
    spark = policy_years.sparkSession
    a, in_year = F.col(amount), F.col("CL_YEAR") == cal_year
    premium = to_money(F.col("EXPOSURE_PREM"))
    negative, combined = Observation("claims"), Observation("combined")
    aside = f"{path}/claims"
    key = [*KEYS, "LD_YEAR"]

    def write(df: DataFrame, to: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    with configured(spark, RELEASE_SHUFFLES | KEEP_PARTITIONING):
        rows = write(claims.select(*KEYS, *_by_claim(amount)).observe(negative, F.sum(F.when(a < 0, a)).alias("claim_negative")), aside)
        all_groups = write(_all_claim_groups(rows, amount), f"{path}/claim_groups")
        remove(spark, aside)
        groups = all_groups.where("_grouped")
        joined = _whole_dates(policy_years.withColumn("LD_YEAR", F.col("CL_YEAR")).join(_light_dates(groups, amount).select(*key, "NUM_CLAIMS", amount, "_day", "_DATES"), key, "left"), groups, amount)
        write(_in_sequence(joined, groups, amount).drop("LD_YEAR").observe(
            combined, F.sum(amount).alias("claim_combined"), F.sum(f"{amount}_SEQ").alias("claim_in_sequence"), F.sum(f"{amount}_NOT_SEQ").alias("claim_not_in_sequence"),
            F.sum("NUM_CLAIMS_SEQ").alias("num_in_sequence"), F.sum("NUM_CLAIMS_NOT_SEQ").alias("num_not_in_sequence"),
            F.sum(F.when(in_year, premium)).alias("premium_in_year"), F.sum(F.when(~in_year, premium)).alias("premium_out_of_year")), f"{path}/combined")
    all_groups = spark.read.schema(all_groups.schema).parquet(f"{path}/claim_groups")
    keys = spark.read.parquet(f"{path}/combined").select(*KEYS, "CL_YEAR")
    own = all_groups.agg(F.sum(F.when(F.col("_grouped"), a)).alias("claim_grouped"), F.count_if("_grouped").alias("rows_grouped"),
                         (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count_if(F.col("_rows") > 0)).alias("dup_claim"))
    lost = all_groups.where("_grouped").select("POLICY_ID", amount).join(keys.select("POLICY_ID").distinct(), "POLICY_ID", "left_anti") \
        .agg(F.sum(amount).alias("claim_unmatched"), F.count(F.lit(1)).alias("rows_unmatched"))
    dup = key_counts(keys, [*KEYS, "CL_YEAR"]).select(F.col("DUPLICATE_ROWS").alias("dup_gwp"))
    seen = spark.createDataFrame([(k, None if v is None else Decimal(v)) for k, v in {**negative.get, **combined.get}.items()], "metric string, value decimal(38,4)")
    return seen.unionByName(metric_rows(own, lost, dup))


def metric_rows(*one_row_aggs: DataFrame) -> DataFrame:
    """Stack one-row aggregates into (metric, value) rows; values as DECIMAL(38,4)."""
    out = None
    for agg in one_row_aggs:
        pairs = ", ".join(f"'{c}', CAST(`{c}` AS DECIMAL(38,4))" for c in agg.columns)
        part = agg.selectExpr(f"stack({len(agg.columns)}, {pairs}) AS (metric, value)")
        out = part if out is None else out.unionByName(part)
    return out
