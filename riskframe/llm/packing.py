"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised and cut into pieces in one pass. Only the histogram of piece lengths (at
most ``capacity`` numbers) reaches the driver. There the configuration program (each
configuration is a multiset of lengths that fits one sequence; cover every length's count with as
few configurations as possible) is solved by multiplicative weights: each step prices the lengths,
a knapsack dynamic program finds the most valuable configuration, and covered lengths lose weight.
The solution is rounded down, and the pieces that are left are priced again: bounded knapsacks around the
longest one make their configurations. The pieces of each length are then numbered in Spark and take
the places that the plan has for their number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import bpe, common

CAPACITY = 1024
END_ID = 2
#: Steps of the multiplicative weights and their rate.
STEPS = 400
RATE = 0.5
#: How slowly the price of a token rises with its piece's length (SLOPE to SLOPE + 1 over the capacity).
SLOPE = 3

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class FastTokenizer:
    """The vocabulary of a byte-level BPE file as ranks of the tiktoken library (ids are the same)."""

    def __init__(self, path: str):
        self.bpe = bpe.ByteBpe(path)
        ranks = {self.bpe.bytes_of[i]: i for i in self.bpe.bytes_of if i not in self.bpe.special.values()}
        self.encoding = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens=self.bpe.special)
        self.by_words = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not text.isascii() and not self.bpe.plain.issuperset(rare := set(text)):
            self.bpe.pre_tokens("".join(rare))
            if not self.bpe.plain.issuperset(rare):  # classes that differ between Unicode versions
                ids = [i for w in self.bpe.pre_tokens(text) for i in
                       ([self.bpe.special[w]] if w in self.bpe.special else self.by_words.encode_ordinary(w))]
                return np.array(ids, np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special="all")


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every tokenised document: a longer one gets a shorter first piece, then full ones.

    A null text is empty: one piece that holds the end id alone.
    """
    def run(batches):
        tok = FastTokenizer(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for part, texts in common.chunks(batch, 1):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    ids = np.concatenate([tok.ids(text), end]).astype("<u4") if text else end.astype("<u4")
                    n = len(ids)
                    first = n if n <= capacity else n % capacity or capacity
                    starts = [0, *range(first, n, capacity)]
                    for k, s in enumerate(starts):
                        e = first if k == 0 else s + capacity
                        rows.append((doc, k, s, e - s, zlib.crc32(ids[s:e])))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def _best_configuration(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """Most valuable multiset of lengths that fits (unbounded knapsack): index of length -> copies."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            v = best[c - lengths[:k]] + values[:k]
            j = int(v.argmax())
            if v[j] > best[c]:
                best[c], choice[c] = v[j], j
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        j = choice[c]
        if j < 0:
            c -= 1
        else:
            out[j] = out.get(j, 0) + 1
            c -= int(lengths[j])
    return out


def _prices(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Prices that rise a little faster than the length, so that short pieces are left to fill gaps (whole numbers: equal everywhere)."""
    return lengths * (SLOPE * capacity + lengths)


def _fill_left(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable configuration of what is left that holds its longest length (bounded knapsack)."""
    alive = np.flatnonzero(left)
    top = int(alive[-1])
    room = capacity - int(lengths[top])
    best = np.zeros(room + 1, np.int64)
    items, taken = [], []
    for j in alive[::-1]:
        size = int(lengths[j])
        count = min(int(left[j]) - (j == top), room // size) if size <= room else 0
        k = 1
        while count > 0:
            k = min(k, count)
            value = best[:room + 1 - k * size] + k * prices[j]
            better = np.zeros(room + 1, bool)
            better[k * size:] = value > best[k * size:]
            best[k * size:] = np.maximum(value, best[k * size:])
            items.append((int(j), k))
            taken.append(better)
            count -= k
            k *= 2
    out, c = {top: 1}, room
    for (j, k), better in zip(reversed(items), reversed(taken), strict=True):
        if better[c]:
            out[j] = out.get(j, 0) + k
            c -= k * int(lengths[j])
    return out


def _repair(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations for the pieces that rounding left over, each taken as often as they allow."""
    left, plan = left.copy(), []
    while left.any():
        config = _fill_left(lengths, left, prices, capacity)
        times = min(int(left[j]) // a for j, a in config.items())
        plan.append(({int(lengths[j]): a for j, a in config.items()}, times))
        for j, a in config.items():
            left[j] -= a * times
    return plan


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) with how often each is used; together they hold every piece once.

    Only sums, products and quotients of doubles and whole numbers decide, so the plan is the same on every machine.
    """
    plan: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        plan.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x] > 0), np.int64)
    if not len(lengths):
        return plan
    count = np.array([histogram[int(x)] for x in lengths], np.int64)
    prices = _prices(lengths, capacity)
    value = prices / float(_prices(np.int64(capacity), capacity))
    weight = np.ones(len(lengths))
    used: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    for _ in range(STEPS):  # the linear program: cover every length's count
        config = _best_configuration(lengths, value * weight, capacity)
        step = min(count[j] / a for j, a in config.items())
        used[key] = used.get(key := tuple(sorted(config.items())), 0.0) + step
        for j, a in config.items():
            gain = a * step / count[j]
            covered[j] += gain
            weight[j] /= 1.0 + RATE * gain
        weight /= weight.max()
    fill = lambda c: sum(a * int(lengths[j]) for j, a in c)
    solution = [(c, x) for c, x in sorted(used.items(), key=lambda c: (-fill(c[0]), -c[1], c[0])) if fill(c) == capacity]
    scale = max(1.0, float(np.sort(covered)[len(covered) // 2]))
    bound = -(-int(count @ lengths) // capacity)
    # where not all sequences can be full, the program's full ones may cost others later: a smaller part of it is tried
    # too, and what is left is priced as at the start or by the program's last weights; the fewest sequences count
    last = np.maximum(1, np.floor(prices * weight * 1024)).astype(np.int64)
    best: list[tuple[dict[int, int], int]] = []
    for part, priced in ((1.0, prices), (1.0, last), (0.5, prices), (0.0, prices)):
        rounded, left = _round_down(lengths, count, [(c, x * part / scale) for c, x in solution])
        found = rounded + _repair(lengths, left, priced, capacity)
        if not best or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) == bound:
            break
    return plan + best


def _round_down(lengths: np.ndarray, count: np.ndarray, solution: list[tuple[tuple, float]]) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole parts of a solution as far as there are pieces, and what is left of them."""
    left, plan = count.copy(), []
    for config, x in solution:
        times = min(int(x), *(int(left[j]) // a for j, a in config))
        if times > 0:
            plan.append(({int(lengths[j]): a for j, a in config}, times))
            for j, a in config:
                left[j] -= a * times
    return plan, left


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of piece numbers per length, sorted by (length, first number)."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for config, times in plan:
        offset = 0
        for size, copies in config.items():
            low = taken.get(size, 0)
            rows.append((size, low, base, copies, offset))
            taken[size] = low + copies * times
            offset += size * copies
        base += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 48) + a[:, 1], "base": a[:, 2], "copies": a[:, 3], "offset": a[:, 4]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (read from a written table: they are read twice).

    Pieces of one length are interchangeable. They are numbered in ``spark.sql.shuffle.partitions``
    salted parts per length, so a length that a third of the pieces share is spread over tasks.
    """
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = common.checkpointed(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = {k: v.tobytes() for k, v in _places(plan_sequences(histogram, capacity)).items()}
    shared = spark.sparkContext.broadcast(places)
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("__number", F.row_number().over(within) - 1).join(starts, ["length", "__salt"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__start") + F.col("__number")).alias("__number"))

    def place(batches):
        t = {k: np.frombuffer(v, np.int64) for k, v in shared.value.items()}
        for b in batches:
            length, number = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(t["key"], (length << 48) + number, "right") - 1
            nth = number - (t["key"][at] - (length << 48))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(t["base"][at] + nth // t["copies"][at]), pa.array(t["offset"][at] + nth % t["copies"][at] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents; an empty table gives no row."""
    return pack(common.checkpointed(cut_pieces(docs, path, capacity, end_id, id_col, text_col)), capacity)
