"""Rating-factor buckets (labels built at plan time, bucketing as one ``CASE`` expression).

Intervals are right-closed ``(lo, hi]`` with the lowest edge included; values outside every
interval, nulls and non-numeric text get the label ``NaN``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")
UNBUCKETED = "NaN"


def parse_edges(raw: Sequence) -> list[float]:
    """Edges from settings; the text ``Infinity`` means +inf."""
    return [INF if (isinstance(x, str) and x.strip().lower() in ("infinity", "inf")) else float(x) for x in raw]


def _check_edges(edges: Sequence[float]) -> None:
    if len(edges) < 2:
        raise ValueError(f"bucket edges need at least two values, got {list(edges)}")
    for a, b in zip(edges, edges[1:]):
        if not a < b:
            raise ValueError(f"bucket edges must increase strictly, got {list(edges)}")


# Label wording by the interval's place (amounts; unit buckets in English and, for
# PNT-11, Vietnamese).
AMOUNT_WORDING = {"first": "From 0 to {high}", "last": "Above {low}", "mid": "Above {low} to {high}"}
UNIT_WORDING = {
    "en": {"first": "Under {high} {unit}", "last": "From {low} {unit} and above", "mid": "From {low} to {high} {unit}"},
    "vi": {"first": "Dưới {high} {unit}", "last": "Từ {low} {unit} trở lên", "mid": "Từ {low} đến {high} {unit}"},
}


def _worded(words: dict[str, str], lows: list, highs: list, open_ended: bool, **more: str) -> list[str]:
    """Numbered label per interval: the first, those between, and an open last one have their own wording."""
    places = ["first", *["mid"] * (len(lows) - 1)]
    if open_ended and len(places) > 1:
        places[-1] = "last"
    texts = [words[p].format(low=a, high=b, **more) for p, a, b in zip(places, lows, highs, strict=True)]
    return [f"{k:02d}-{t}" for k, t in enumerate(texts, start=1)]


def amount_labels(edges: Sequence, billion_threshold: float = 1e9) -> tuple[list[float], list[str]]:
    """``01-From 0 to 400m``, ``02-Above 400m to 1.00bn``, ``03-Above 1.00bn``; edges unchanged."""
    cuts = parse_edges(edges)
    _check_edges(cuts)
    money = [f"{v / billion_threshold:.2f}bn" if v >= billion_threshold else f"{v / 1e6:.0f}m" for v in cuts]
    return cuts, _worded(AMOUNT_WORDING, money[:-1], money[1:], math.isinf(cuts[-1]))


def unit_labels(edges: Sequence, unit: str, locale: str = "en") -> tuple[list[float], list[str]]:
    """Whole numbers. ``[0,3,6,inf]`` cuts at ``[0,2] (2,5] (5,inf)`` with labels
    ``Under 3``, ``From 3 to 5``, ``From 6 and above``: an inner edge belongs to the bucket above
    it, so the right-closed cut lies one below. The last edge must be +inf."""
    starts = parse_edges(edges)
    _check_edges(starts)
    if starts[-1] != INF:
        raise ValueError(f"unit buckets need +inf as the last edge, got {starts}")
    inner = [int(e) for e in starts[1:-1]]
    tops = [*inner[:1], *[e - 1 for e in inner[1:]], INF]  # the first label names the edge itself
    cuts = [starts[0], *[float(e - 1) for e in inner], INF]
    _check_edges(cuts)
    return cuts, _worded(UNIT_WORDING[locale], [int(e) for e in starts[:-1]], tops, True, unit=unit)


def bucketize_col(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed cut with the lowest edge included; anything else is ``NaN``."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need exactly one label per interval")
    x = value
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = (x >= F.lit(lo)) if i == 0 else (x > F.lit(lo))
        cond = lower if math.isinf(hi) else (lower & (x <= F.lit(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(UNBUCKETED))


def numeric(c: str | Column) -> Column:
    """Numeric coerce (bad text → null), as double; NaN is treated as missing."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def bucketize(df: DataFrame, source: str, target: str, edges: Sequence, kind: str = "amount",
              unit: str = "", locale: str = "en") -> DataFrame:
    """Add ``target`` = label of ``source`` (``kind`` = ``amount`` | ``unit``)."""
    if kind == "amount":
        e, labels = amount_labels(edges)
    elif kind == "unit":
        e, labels = unit_labels(edges, unit, locale)
    else:
        raise ValueError(f"unknown bucket kind {kind!r}")
    return df.withColumn(target, bucketize_col(numeric(source), e, labels))


def bucketize_all(df: DataFrame, specs: Sequence[tuple[str, str, Sequence, str, str]]) -> DataFrame:
    """E5: apply several buckets in one projection. ``specs`` = (source, target, edges, kind, unit)."""
    cols = {}
    for source, target, edges, kind, unit in specs:
        e, labels = amount_labels(edges) if kind == "amount" else unit_labels(edges, unit)
        cols[target] = bucketize_col(numeric(source), e, labels)
    return df.withColumns(cols)


# Group columns bucketed with amount labels (all other *_GROUP columns use unit labels).
AMOUNT_GROUPS = ("VEHICLE_VALUE_GROUP", "SUM_ASSURED_GROUP")


def bucketize_from_settings(df: DataFrame, groups: dict[str, dict]) -> DataFrame:
    """E5: ``{<COL>_GROUP: {"bin": [...], "unit": "..."}}`` → one projection adding every group
    column from its source column ``<COL>``. Value / sum-assured groups get amount labels, the
    others unit labels; ``"Infinity"`` edges are +inf. Groups whose source column is missing are
    an error (the reference failed later on an empty frame)."""
    specs = []
    for target, cfg in groups.items():
        if not target.endswith("_GROUP"):
            raise ValueError(f"bucket setting {target!r} must end with _GROUP")
        source = target[: -len("_GROUP")]
        if source not in df.columns:
            raise ValueError(f"column {source!r} for {target!r} not found")
        kind = "amount" if target in AMOUNT_GROUPS else "unit"
        specs.append((source, target, cfg["bin"], kind, cfg.get("unit", "")))
    if not specs:
        raise ValueError("no bucket settings")
    return bucketize_all(df, specs)
