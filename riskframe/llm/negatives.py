"""Hard-negative mining through anchor-clustered shared lists.

Anchors are taken in blocks of bounded size and clustered by direction. For a cluster, no member's inner
product with a row can exceed the member's length times the row's bound, |row| * cos(angle to the
centroid - the cluster's widest angle). A task sorts its rows by this bound once per cluster,
and every member walks that one list until the bound of what is left proves that its best rows are
found. What a member has found holds for the task's further rows. Two walks a block: one finds the
positives, and with them known, one finds the negatives within their score windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import common
from riskframe.session import checkpoint_dir

#: Bytes of anchor vectors in a block (8 a component); clusters of a block; rows that one list holds.
ANCHOR_BYTES = 16 << 20
CLUSTERS = 16
LIST_ROWS = 1 << 15
#: Rows of the first step of a walk; each further step takes twice as many, up to the second number.
FIRST_STEP, LARGEST_STEP = 64, 2048
#: Largest sum that doubles hold exactly.
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)
#: Components count as this at most (their squares still add up).
LARGEST = 1e150


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of floor(256 x), shorter ones filled up with zeros."""
    flat = np.clip(np.floor(256.0 * np.clip(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), -LARGEST, LARGEST)), -LARGEST, LARGEST)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; where doubles may not add them up exactly, Python's integers do, held within 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.frompyfunc(lambda x: min(max(x, LONG[0]), LONG[1]), 1, 1)(whole(a) @ whole(b).T)


def clustered(vectors: np.ndarray, k: int = CLUSTERS, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Directions of at most ``k`` clusters (spherical k-means from evenly spaced rows) and each row's cluster."""
    length = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(length > 0, length, 1)[:, None]
    centre = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        of = (unit @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, unit)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 0, total / np.where(size > 0, size, 1)[:, None], centre)
    return centre, (unit @ centre.T).argmax(axis=1)


def angles(vectors: np.ndarray, length: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centre / np.where(length > 0, length, 1), -1, 1))


class Best:
    """The first ``k`` rows of every slot by falling score, then id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.least = np.full(slots, -np.inf)  # score of the k-th, once there are k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        last = rank[keep] == self.k - 1
        self.least[self.slot[last]] = np.nextafter(self.score[last].astype(float), -np.inf)


class Walk:
    """Walks of a block's anchors over lists of rows; ``windows``: per anchor and slot the least and the greatest score, or None for positives."""

    def __init__(self, ids, labels, vectors, cluster, centres, k: int, windows=None):
        self.ids, self.labels, self.vectors, self.cluster, self.centres = ids, labels, vectors, cluster, centres
        self.length = np.linalg.norm(vectors, axis=1)
        self.windows = windows
        self.slots = 1 if windows is None else windows[0].shape[1]
        self.best = Best(len(ids) * self.slots, k)
        self.wide = np.zeros(len(centres))
        for c in range(len(centres)):
            own = cluster == c
            self.wide[c] = angles(vectors[own], self.length[own], centres[c]).max(initial=0.0)
        self.steps = 0

    def over(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        length = np.linalg.norm(vectors, axis=1)
        for c, centre in enumerate(self.centres):
            members = np.flatnonzero(self.cluster == c)
            if not len(members):
                continue
            bound = length * np.cos(np.maximum(0.0, angles(vectors, length, centre) - self.wide[c]))
            order = np.argsort(-bound, kind="stable")
            slack = 1e-9 * length.max(initial=0.0)
            at, step = 0, FIRST_STEP
            while at < len(order):
                most = self.length[members] * (bound[order[at]] + slack) + 0.5
                members = members[self._open(members, most)]
                if not len(members):
                    break
                rows = order[at:at + step]
                self._meet(members, ids[rows], labels[rows], vectors[rows])
                at, step = at + step, min(2 * step, LARGEST_STEP)

    def _least(self, members: np.ndarray) -> np.ndarray:
        """Scores that a row must reach to matter, per member and slot."""
        least = self.best.least.reshape(-1, self.slots)[members]
        return least if self.windows is None else np.maximum(least, np.nextafter(self.windows[0][members].astype(float), -np.inf))

    def _open(self, members: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (self._least(members) <= most[:, None]).any(axis=1)

    def _meet(self, members, ids, labels, vectors) -> None:
        self.steps += len(members) * len(ids)
        score = products(self.vectors[members], vectors)
        same = self.labels[members][:, None] == labels[None]
        least = self._least(members)
        found = []
        for j in range(self.slots):
            fits = score >= least[:, j][:, None]
            if self.windows is None:
                fits &= same & (self.ids[members][:, None] != ids[None])
            else:
                low, high = (w[members, j][:, None] for w in self.windows)
                fits &= ~same & (score >= low) & (score <= high)
            r, c = np.nonzero(fits)
            found.append((members[r] * self.slots + j, score[r, c], ids[c]))
        slot, score, found_ids = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(slot):
            self.best.add(slot, score, found_ids)


def lists(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (id, label, vector) of a task in lists of at most ``LIST_ROWS``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LIST_ROWS:
            yield _list(held, dims)
            held, n = [], 0
    if n:
        yield _list(held, dims)


def _list(held: list[pa.RecordBatch], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)), np.concatenate([matrix(b.column(2), dims) for b in held]))


def _walk(rows: DataFrame, make: Callable[[], Walk], dims: int, first: int) -> DataFrame:
    """The first ``first`` rows of every (anchor, slot): ``anchor``, ``slot`` (places in the block), ``id``, ``score``, ``rank``."""
    def run(batches):
        walk = make()
        for part in lists(batches, dims):
            walk.over(*part)
        best = walk.best
        score = pa.array(list(map(int, best.score.tolist())), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(best.slot // walk.slots), pa.array(best.slot % walk.slots), pa.array(best.id), score], names=["anchor", "slot", "id", "score"])

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(run, "anchor long, slot long, id long, score long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """``id``, ``label``, ``vector`` of the rows that take part, one per id (the least label, then vector)."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector")) \
        .where("id is not null and label is not null and vector is not null").where(whole)
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` (a condition on ``id``) holds for.

    Components become floor(256 x); a score is the integer inner product, higher first, ties by smaller
    id. An anchor's positives are its first other rows of the same label. Returned are, for each positive,
    the first rows of other labels with ``low`` * positive <= 100 * negative <= ``high`` * positive:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that
    repeat an id count once (the least label, then vector). A shorter vector ends in zeros. A
    positive without a negative in its window, an anchor without a positive, and an empty table give no row.
    A score beyond 64 bits counts as the nearest 64-bit number.
    Other columns are not read.
    """
    spark = rows.sparkSession
    own = common.written(usable(rows, id_col, F.col(label) if isinstance(label, str) else label, vector_col))
    # of equal vectors under one label, no row after the first (k + the anchor itself) can be among k
    same = Window.partitionBy("label", "vector").orderBy("id")
    lists_ = common.written(own.withColumn("n", F.row_number().over(same)).where(F.col("n") <= max(positives, negatives) + 1).select("id", "label", "vector"))
    size = own.where(anchors).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = own.agg(F.max(F.size("vector"))).first()[0] or 0
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    n_blocks = -(-size["n"] * 8 * max(dims, 1) // ANCHOR_BYTES)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_blocks:
        return spark.createDataFrame([], out)
    for block in range(n_blocks):
        held = own.where(anchors).where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).orderBy("id").toArrow()
        if not held.num_rows:
            continue
        held = held.combine_chunks()
        ids, labels, vectors = _list(held.to_batches(max_chunksize=max(held.num_rows, 1)), dims)
        centres, cluster = clustered(vectors)
        shared = spark.sparkContext.broadcast((ids, labels, vectors, cluster, centres))
        found = _walk(lists_, lambda s=shared: Walk(*s.value, k=positives), dims, positives).collect()
        # a slot per positive; anchors with fewer have windows that nothing fits
        window = np.empty((2, len(ids), positives), object)
        window[0], window[1] = np.inf, -np.inf
        for r in found:
            window[:, r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        if max((abs(r["score"]) for r in found), default=0) * max(high, 100) < EXACT:
            window = window.astype(float)
        windows = spark.sparkContext.broadcast(window)
        hard = _walk(lists_, lambda s=shared, w=windows: Walk(*s.value, k=negatives, windows=w.value), dims, negatives)
        names = spark.createDataFrame([(r["anchor"], r["rank"] - 1, int(ids[r["anchor"]]), r["id"], r["score"]) for r in found],
                                      "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
        hard.join(names, ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                                                    F.col("score").alias("negative_score")).write.parquet(f"{path}/block={block}")
    return spark.read.schema(out).parquet(path).select([c.split()[0] for c in out.split(", ")])
