import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=5):
    vectors = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors[i] = min(vectors.get(i, (label, v)), (label, v))
    def score(a, b):
        return min(max(sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)

    out = []
    for i, (label, v) in vectors.items():
        if i % every:
            continue
        ranked = sorted((-score(v, w), j, other) for j, (other, w) in vectors.items() if j != i)
        for p, j, _ in [r for r in ranked if r[2] == label][:k]:
            hard = [(n, m) for n, m, other in ranked if other != label and 80 * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 100 == 0, **more).collect()))


def hard_rows():
    rnd = random.Random(5)
    near = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rnd.gauss(0, 0.2))) for x in near[i % 6]], rnd.randrange(4)) for i in range(900)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(400)]  # a vector that a third of the rows share
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1), (2004, near[0], None), (None, near[0], 1)]
    rows += [(2100, [0.0] * 8, 1), (2200, [], 2), (2300, [1.0, 2.0], 0), (2400, near[1], 77), rows[0], (200, near[2], 0), (200, near[3], 0)]
    return rows


def test_equals_brute_force_over_many_short_lists(spark, monkeypatch):
    rows = hard_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(3).withColumns({c: F.lit(1) for c in ("id", "rank", "anchor", "vector")})
    want = brute(rows)
    assert len(want) > 100 and mined(df) == want
    for name, value in (("LIST_ROWS", 50), ("FIRST_STEP", 1), ("CLUSTERS", 3)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(df.repartition(2)) == want


def test_anchor_blocks_and_empty_tables(spark, monkeypatch):
    rows = hard_rows()
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 300)
    assert mined(spark.createDataFrame(rows, ROWS)) == brute(rows)
    assert mined(spark.createDataFrame([], ROWS)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0), (100, None, 0)], ROWS)) == []


def test_lists_end_early_once_the_best_are_certain():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16)) * 40
    rows = np.floor(np.repeat(centre, 500, axis=0) + rng.normal(size=(10_000, 16)) * 3)
    ids, labels = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    own = np.arange(0, len(rows), 100)
    centres, cluster = negatives.clustered(rows[own], 20)
    walk = negatives.Walk(own, labels[own], rows[own], cluster, centres, 5)
    walk.over(ids, labels, rows)
    score = rows[own] @ rows.T
    score[np.arange(len(own)), own] = -np.inf
    want = [np.lexsort((ids, -s))[:5].tolist() for s in score]
    assert walk.best.id.reshape(-1, 5).tolist() == want
    assert walk.steps < 0.3 * len(own) * len(rows)


def test_numbers_beyond_doubles_stay_exact(spark):
    big = 1.1e7  # products of 2 ** 62 and more
    rows = [(0, [big, 1.0, 0.0], 0), (1, [big, 0.5, 0.0], 0), (2, [big, 0.25, 0.0], 1), (3, [big, 0.125, 0.0], 1), (4, [big, 3.0, 0.0], 1), (5, [1e38] * 3, 2), (6, [-1e38] * 3, 2)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute(rows)
    assert want[0][-1] > 2**62 and mined(spark.createDataFrame(rows, ROWS)) == want
