"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other labelled texts, smoothed by an informative Dirichlet
prior, score the tokens of a text; tokens outside the lexicon carry the small negative log-ratio
of meeting no lexicon token inside a toxic passage. A linear-time scan finds all maximal scoring
segments. Segment scores are calibrated as extreme values (Karlin-Altschul: the chance that a
clean text of this length holds a segment as good), and the best segment's surprise is mapped to
a probability by a logistic fit on the same labelled rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

#: Bounds of the labelled rows that the model is fitted on, and of its lexicon.
FIT_ROWS = 12_000
MAX_LEXICON = 5_000
#: Weight of the Dirichlet prior as a share of all tokens, least z-score and texts of a lexicon token.
PRIOR_SHARE = 0.2
MIN_Z = 3.0
MIN_TEXTS = 3
#: ... the least share of the toxic texts that must hold it, and its least shrunk log-odds.
MIN_SHARE = 0.01
MIN_ODDS = 1.0
#: Lengths of the stems (beginnings of words) that are lexicon features beside whole words.
MIN_STEM, MAX_STEM = 4, 8
#: Segments with a larger chance in a clean text are not reported.
MAX_P_VALUE = 0.05
THRESHOLD = 0.3

_TOKEN = re.compile(r"[^\W\d_]+")
_EULER = 0.5772156649


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    gap: float = -0.02
    rate: float = 1.0
    size: float = 1.0
    slope: float = 1.0
    bias: float = -3.0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, left to right, in linear time."""
    kept: list[list[float]] = []  # start, end, sum before, sum through
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        cur = [i, i + 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= cur[2]:
                j = int(kept[j][4])
            if j < 0 or kept[j][3] >= cur[3]:
                kept.append([*cur, j])
                break
            cur = [kept[j][0], cur[1], kept[j][2], cur[3]]
            del kept[j:]
    return [(int(k[0]), int(k[1]), k[3] - k[2]) for k in kept]


class _Weights(dict):
    """Token -> weight of its most specific lexicon feature (0: none); remembers what it was asked."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> float:
        weight = self.lexicon.get(token)
        if weight is None:
            weight = next((self.lexicon[f] for f in reversed(_features(token)) if f in self.lexicon), 0.0)
        if len(self) >= 200_000:
            self.clear()
        self[token] = weight
        return weight


def text_segments(text: str, model: ToxicityModel, weights: _Weights | None = None) -> tuple[list[tuple[int, int, float]], int]:
    """Maximal segments of a text as (first token, token after, score), and its number of tokens."""
    tokens = _TOKEN.findall(text.lower())
    known = _Weights(model.weights) if weights is None else weights
    hits = [(i, w) for i, w in enumerate(map(known.__getitem__, tokens)) if w]
    if not hits:
        return [], len(tokens)
    line, where, last = [], [], -1
    for i, w in hits:  # tokens between two hits are one negative item
        if i > last + 1:
            line.append(model.gap * (i - last - 1))
            where.append(last + 1)
        line.append(w)
        where.append(i)
        last = i
    return [(where[a], where[b - 1] + 1, s) for a, b, s in maximal_segments(line)], len(tokens)


def surprise(best: float, tokens: int, model: ToxicityModel) -> float:
    """-log10 of the chance that a clean text of that many tokens holds a segment as good."""
    if best <= 0:
        return 0.0
    expected = model.size * tokens * math.exp(-min(700.0, model.rate * best))
    p = -math.expm1(-expected)
    return min(60.0, -math.log10(max(p, 1e-60)))


def _evidence(text: str | None, model: ToxicityModel, weights: _Weights) -> tuple[float, int, list]:
    segments, n = text_segments(text, model, weights) if text else ([], 0)
    scored = [(a, b, s, surprise(s, n, model)) for a, b, s in segments]
    good = [x for x in scored if 10 ** -x[3] <= MAX_P_VALUE]
    return max((x[3] for x in scored), default=0.0), n, good


def _root(weights: list[tuple[float, float]]) -> float:
    """The positive solution of sum(p * exp(rate * s)) = 1."""
    value = lambda r: sum(p * math.exp(min(700.0, r * s)) for p, s in weights) - 1
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps, with a weak ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _log_odds(y1: float, y0: float, n1: float, n0: float) -> tuple[float, float]:
    """Log-odds ratio of a feature under an informative Dirichlet prior, and its standard deviation."""
    prior, whole = PRIOR_SHARE * (y1 + y0), PRIOR_SHARE * (n1 + n0)
    a, b = y1 + prior, y0 + prior
    odds = math.log(a / max(1.0, n1 + whole - a)) - math.log(b / max(1.0, n0 + whole - b))
    return odds, math.sqrt(1 / a + 1 / b)


def _copy_keys(batches):
    """Labelled texts with a key that near copies mostly share: the two least 64-bit hashes of five tokens. One phrase that
    unrelated texts share does not make them copies."""
    for batch in batches:
        for part, texts in common.chunks(batch, 0):
            keys = []
            for text in texts:
                tokens = _TOKEN.findall(text.lower())
                grams = zip(tokens, tokens[1:], tokens[2:], tokens[3:], tokens[4:], strict=False)
                least = heapq.nsmallest(2, {xxhash.xxh64_intdigest(" ".join(g)) for g in grams})
                keys.append(xxhash.xxh64_intdigest(" ".join(map(str, least)) if least else " ".join(tokens)) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=["t", "toxic", "copy"])


def _features(token: str) -> list[str]:
    """The token, and its proper beginnings as a stem with a star."""
    return [token, *[token[:k] + "*" for k in range(MIN_STEM, min(MAX_STEM, len(token) - 1) + 1)]]


def _feature_counts(batches):
    """Per chunk: tokens and texts with each feature, by label (a map-side combine)."""
    for batch in batches:
        for part, texts in common.chunks(batch, 0):
            counts: dict[str, list[int]] = {}
            size, rows_of = [0, 0], [0, 0]
            for text, label in zip(texts, part.column(1).to_pylist(), strict=True):
                tokens = Counter(_TOKEN.findall(text.lower()))
                size[label] += sum(tokens.values())
                rows_of[label] += 1
                features: Counter = Counter()
                for token, n in tokens.items():
                    for f in _features(token):
                        features[f] += n
                for f, n in features.items():
                    row = counts.setdefault(f, [0, 0, 0, 0])
                    row[label] += n
                    row[2 + label] += 1
            rows = [("", *size, *rows_of), *((f, *c) for f, c in counts.items())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 4), strict=True)],
                                             names=["token", "y0", "y1", "d0", "d1"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on labelled rows that are not held out, at most about ``FIT_ROWS`` of them (by hash).

    Labels that are null are not used; a document with both labels counts as toxic. Near copies
    (equal two least five-word hashes) count once, by the text of least hash, so a large copy group cannot
    fill the lexicon and the model does not depend on the order of rows. With no toxic row the model
    gives every text its small base score.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id")) \
        .agg(F.max("toxic").cast("int").alias("toxic")).where(~common.held_out(F.col("__id")))
    n = marked.count()
    if not n:
        return ToxicityModel()
    if n > FIT_ROWS:
        marked = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(FIT_ROWS / n * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()) \
        .join(marked, "__id").select("t", "toxic")
    texts = common.checkpointed(rows.mapInArrow(_copy_keys, "t string, toxic int, copy long")
                                .groupBy("copy", "toxic").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("t", "toxic"))
    toxic = texts.where("toxic = 1").count()
    counts = texts.mapInArrow(_feature_counts, "token string, y0 long, y1 long, d0 long, d1 long") \
        .groupBy("token").agg(*[F.sum(c).alias(c) for c in ("y0", "y1", "d0", "d1")]) \
        .where((F.col("token") == "") | (F.col("d1") >= max(MIN_TEXTS, MIN_SHARE * toxic)))
    found = {r["token"]: r for r in counts.orderBy(F.col("token") != "", F.desc("d1"), "token").limit(4 * MAX_LEXICON + 1).collect()}
    if not toxic or not found[""]["y0"]:
        return ToxicityModel()
    whole = found.pop("")
    n0, n1 = whole["y0"], whole["y1"]
    lexicon = []
    for f, r in found.items():
        odds, sd = _log_odds(r["y1"], r["y0"], n1, n0)
        by_text, sd_text = _log_odds(r["d1"], r["d0"], whole["d1"], whole["d0"])  # one bursting text is no evidence
        if min(odds / sd, by_text / sd_text) > MIN_Z and odds - sd >= MIN_ODDS:
            lexicon.append((by_text / sd_text, f, odds - sd, r["y0"], r["y1"]))
    lexicon = sorted(lexicon, key=lambda x: (-x[0], x[1]))[:MAX_LEXICON]
    if not lexicon:
        return ToxicityModel()
    weights = {f: w for _, f, w, _, _ in lexicon}
    own = {f: [y0, y1] for _, f, _, y0, y1 in lexicon}
    for f in sorted(own, key=len, reverse=True):  # a token counts at its most specific feature alone
        for g in _features(f[:-1])[1:-1] if f.endswith("*") else _features(f)[1:]:
            if g in own:
                own[g] = [max(0, x - y) for x, y in zip(own[g], own[f], strict=True)]
                break
    hit0, hit1 = (min(0.5, sum(x[k] for x in own.values()) / n) for k, n in ((0, n0), (1, n1)))
    gap = min(-1e-3, math.log((1 - hit1) / (1 - hit0)))
    background = [((own[f][0] + 0.5) / (n0 + 1), w) for f, w in weights.items()]
    rest = max(0.0, 1 - sum(p for p, _ in background))
    model = ToxicityModel(weights, gap, _root([*background, (rest, gap)]))
    best = _best_segments(texts, model)
    clean = [(s, t) for s, t, y in best if y == 0 and t]
    # size from the mean of clean texts' best scores (a Gumbel law in score * rate - log(tokens))
    level = [model.rate * s - math.log(t) for s, t in clean if s > 0]
    size = math.exp(min(5.0, max(-20.0, sum(level) / len(level) - _EULER))) * len(level) / max(1, len(clean)) if level else 1e-6
    model = ToxicityModel(weights, gap, model.rate, size)
    x = np.array([surprise(s, t, model) for s, t, _ in best])
    slope, bias = _logistic(x, np.array([y for _, _, y in best], float))
    return ToxicityModel(weights, gap, model.rate, size, max(0.0, slope), bias)


def _best_segments(rows: DataFrame, model: ToxicityModel) -> list[tuple[float, int, int]]:
    """Best segment, tokens and label of each labelled row (three numbers a row, ``FIT_ROWS`` rows)."""
    def make():
        weights = _Weights(model.weights)

        def compute(texts):
            found = [text_segments(t, model, weights) for t in texts]
            return [[max((s for _, _, s in seg), default=0.0) for seg, _ in found], [n for _, n in found]]
        return compute
    out = common.append_columns(rows, "t", [("best", T.DoubleType(), pa.float64()), ("n", T.LongType(), pa.int64())], make)
    return [(r[0], r[1], r[2]) for r in out.select("best", "n", "toxic").collect()]


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``passages`` (token spans with score and p-value).

    A null or empty text has no passage and the base score. Columns of these names are replaced.
    """
    passage = T.ArrayType(T.StructType([T.StructField("first_token", T.IntegerType()), T.StructField("end_token", T.IntegerType()),
                                        T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("first_token", pa.int32()), ("end_token", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def make():
        weights = _Weights(model.weights)

        def compute(texts):
            found = [_evidence(t, model, weights) for t in texts]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * x + model.bias)))) for x, _, _ in found]
            return [score, [int(s >= THRESHOLD) for s in score],
                    [[{"first_token": a, "end_token": b, "score": s, "p_value": 10 ** -x} for a, b, s, x in good] for _, _, good in found]]
        return compute

    return common.append_columns(docs, text_col, [("score", T.DoubleType(), pa.float64()),
                                                  ("predicted", T.IntegerType(), pa.int32()), ("passages", passage, arrow)], make)
