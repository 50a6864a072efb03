"""Exact top-k search over binary codes by multi-index hashing.

Embeddings become 64-bit codes of their signs. A code is cut into ``SEGMENTS`` segments, and an
index holds every code under each of its segments. The search radius of the segments grows by one
a round: once all segments have been probed up to radius s, every code within
``SEGMENTS * (s + 1) - 1`` bits has been met. A query ends when its k-th verified distance is
covered by that bound; until then only candidates that can still enter its top k are kept.

Spark deals the codes to blocks and the queries to groups of bounded size, and every pair of a block and a
group is one cell: a task indexes the block and probes it for the group. A cell leaves at most k + 1
classes a query, and the least of all cells are the answer. The number of jobs is the same whatever the
radii, and nothing is broadcast. Rows of equal code are one class with its k + 1 least ids, so a
vector that a third of the rows share costs one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import common

BITS = 64
SEGMENTS = 4
SEGMENT_BITS = BITS // SEGMENTS
#: Codes of a block, queries of a group, and probes or candidates that a cell holds at a time (about).
BLOCK_CODES = 1 << 17
GROUP_QUERIES = 1 << 13
STEP = 1 << 21


def sign_code(vector: Column) -> Column:
    """The signs of the first 64 components as a long (missing components: 0); null for a null vector."""
    bits = [F.shiftleft(F.when(F.get(vector, F.lit(i)) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i) for i in range(BITS)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return F.when(vector.isNotNull(), bits[0])


class BlockIndex:
    """The codes of a block under each of their segments."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.values = [(codes >> np.uint64(k * SEGMENT_BITS)).astype(np.uint16) for k in range(SEGMENTS)]
        self.order = [np.argsort(v, kind="stable").astype(np.int32) for v in self.values]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << SEGMENT_BITS))]) for v in self.values]
        self.flips = np.bitwise_count(np.arange(1 << SEGMENT_BITS, dtype=np.uint16))

    def candidates(self, queries: np.ndarray, radius: int):
        """Pairs (place of the query, place of the code) whose codes are ``radius`` bits apart in a segment, a step at a time."""
        flips = np.flatnonzero(self.flips == radius).astype(np.uint16)
        for k in range(SEGMENTS):
            own, start, order = (queries >> np.uint64(k * SEGMENT_BITS)).astype(np.uint16), self.start[k], self.order[k]
            rows = max(1, STEP // max(len(flips), len(self.codes)))
            for at in range(0, len(queries), rows):
                probe = own[at:at + rows, None] ^ flips
                first, n = start[probe].ravel(), (start[1:][probe] - start[probe])
                of = np.repeat(np.arange(at, at + len(probe)), n.sum(axis=1))
                n = n.ravel()
                ends = np.cumsum(n)
                yield of, order[np.repeat(first - (ends - n), n) + np.arange(len(of))]

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest codes of each query as (place of the query, place of the code, distance); ties go to the earlier code."""
        n = len(self.codes)
        found = np.zeros(0, np.int64)  # (query, distance, code) as one number each
        most = np.full(len(queries), BITS)
        active = np.arange(len(queries))
        for radius in range(SEGMENT_BITS + 1):
            parts = [found]
            for of, code in self.candidates(queries[active], radius):
                of = active[of]
                d = np.bitwise_count(queries[of] ^ self.codes[code])
                near = np.flatnonzero(d <= most[of])
                parts.append(np.unique((of[near] * (BITS + 1) + d[near]) * n + code[near]))
            found = np.unique(np.concatenate(parts))
            of = found // ((BITS + 1) * n)
            first = np.searchsorted(of, np.arange(len(queries)))
            found = found[np.arange(len(found)) - first[of] < k]
            of, d = found // ((BITS + 1) * n), found // n % (BITS + 1)
            size = np.bincount(of, minlength=len(queries))
            last = np.cumsum(size) - 1
            full = size >= min(k, n)
            most[full] = d[last[full]]
            active = active[~full[active] | (most[active] > SEGMENTS * (radius + 1) - 1)]
            if not len(active):
                break
        return of, found % n, d


def _cell(k: int):
    """The k nearest classes of each query within a block."""
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        unsigned = lambda c: c.to_numpy().astype(np.int64).view(np.uint64)
        block = block.take(pc.sort_indices(block, [("first", "ascending")]))
        q, codes = unsigned(queries["q"]), unsigned(block["code"])
        none = np.zeros(0, np.int64)
        of, at, d = BlockIndex(codes).nearest(q, k) if len(q) and len(codes) else (none, none, none)
        return pa.table({"q": pa.array(q[of].view(np.int64)), "code": pa.array(codes[at].view(np.int64)), "d": pa.array(d.astype(np.int32))})
    return run


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, neighbor_id, distance, rank``: the k nearest other rows of every query row.

    Distances are Hamming distances of the codes; ties go to the smaller id. Rows with a null id
    or vector are neither found nor asked for; with k or fewer other rows all are returned. Rows
    that repeat an id count once; if their codes differ, the least code counts (as a signed number).
    """
    code = lambda df: df.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col)).alias("code")) \
        .where("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    classes = common.checkpointed(code(rows).withColumn("r", rank).where(F.col("r") <= k + 1)
                                  .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = common.checkpointed(code(queries))
    wanted = asked.select(F.col("code").alias("q")).distinct()
    blocks, groups = -(-classes.count() // BLOCK_CODES) or 1, -(-asked.count() // GROUP_QUERIES) or 1
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # cells are small to read and long to search: they are not put together
    left = wanted.select("q", dealt("q", groups).alias("g"), every(blocks).alias("b")).repartition(tasks, "b", "g").groupBy("b", "g")
    right = classes.select("code", F.col("ids")[0].alias("first"), dealt("code", blocks).alias("b"), every(groups).alias("g")).repartition(tasks, "b", "g").groupBy("b", "g")
    met = left.cogroup(right).applyInArrow(_cell(k + 1), "q long, code long, d int")
    # the k + 1 nearest rows (the query's own included) are in its k + 1 nearest classes, by distance and least id
    nearest = F.row_number().over(Window.partitionBy("q").orderBy("d", "first"))
    found = met.join(classes.select("code", F.col("ids")[0].alias("first")).hint("merge"), "code").withColumn("r", nearest).where(F.col("r") <= k + 1).select("q", "code", "d")
    best = asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found.hint("merge"), "q").select("query_id", "code", "d") \
        .join(classes.hint("merge"), "code").select("query_id", "d", F.explode("ids").alias("neighbor_id")).where("query_id <> neighbor_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "neighbor_id"))
    return best.withColumn("rank", order).where(F.col("rank") <= k) \
        .select("query_id", "neighbor_id", F.col("d").cast("int").alias("distance"), "rank")
