"""SimHash near-duplicates through vantage-point trees.

Every text gets a 64-bit fingerprint. Two fingerprints link at ``radius`` or fewer differing bits.
Fingerprints that differ in at most r of 64 bits differ in at most r // s bits on one of s
segments, so one vantage-point tree per segment finds every pair: a ball's bound is then narrow
against the spread of distances, and the triangle inequality prunes.

* The tops of the trees come from a bounded sample and are broadcast; their leaves are shards.
  A fingerprint lives in one shard of each tree and visits every later shard that the ball around
  it can reach, so each pair meets exactly where the later of the two lives.
* A shard is searched by a tree of its own, split at the median distance from a vantage point.
  Whatever lies within ``radius`` of the vantage point is linked to it at once, and a branch whose
  members already hang together is skipped, so a large group of near copies costs no pairs.
* A shard returns a spanning forest of its links, not its pairs; components are contracted on
  written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common
from riskframe.llm.components import connected_components

#: Seed of the shingles' hashes.
SEED = 42
#: Fingerprints of the sample that the tree tops are built from, and fingerprints wanted per shard.
SAMPLE = 65_536
SHARD = 20_000
#: Most levels of a tree top (2 ** MAX_LEVELS shards).
MAX_LEVELS = 12
#: Members of a branch that are compared outright.
LEAF = 128

#: Parts that the fingerprints of one component are dealt to when they get its id.
SALTS = 16
_BIT_SUMS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text (UTF-8): a bit is set where over half of the shingles' hashes have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    stops = (ends[words - 1:] if len(tokens) > words else ends[-1:]) - 1
    starts = [0, *ends[:len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops.tolist(), strict=True)], "<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT_SUMS for k in range(8)])
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) and the columns ``carry`` of every row; a null text has no word."""
    def make():
        def compute(texts):
            return [np.array([fingerprint(t, words) for t in common.utf8(texts)], np.uint64).view(np.int64)]
        return compute
    return common.append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry), "text",
                                 [("fp", T.LongType(), pa.int64())], make).select("doc_id", "fp", *carry)


def segment_masks(segments: int) -> list[int]:
    cuts = [round(64 * k / segments) for k in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _distance(x: np.ndarray, v, mask) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int16)


class TreeTop:
    """The upper levels of a vantage-point tree over one segment; its leaves are shards 0, 1, 2, ..."""

    def __init__(self, sample: np.ndarray, mask: int, levels: int, seed: int):
        self.mask, self.shards = np.uint64(mask), 0
        rng = np.random.default_rng(seed)

        def build(points: np.ndarray, left: int):
            if left and len(points) >= 16:
                for _ in range(4):
                    v = points[rng.integers(len(points))]
                    d = _distance(points, v, self.mask)
                    mu = int(np.median(d))
                    near = d <= mu
                    if not near.all():
                        return int(v), mu, build(points[near], left - 1), build(points[~near], left - 1)
            self.shards += 1
            return self.shards - 1
        self.root = build(sample, levels)

    def assign(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, is home): the home of each fingerprint and the later shards its ball reaches."""
        rows, shards, homes = [], [], []

        def walk(node, at: np.ndarray, home: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, int):
                rows.append(at)
                shards.append(np.full(len(at), node))
                homes.append(home)
                return
            v, mu, near, far = node
            d = _distance(fps[at], np.uint64(v), self.mask)
            inside = d <= mu
            go = inside | (~home & (d <= mu + radius))
            # a guest has its home in an earlier shard: none walks into the near side after a far home
            walk(near, at[go], (home & inside)[go])
            go = d >= mu + 1 - radius  # whatever lies outside, and balls that reach out
            walk(far, at[go], (home & ~inside)[go])
        walk(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


class Forest:
    """Union-find over positions, with arrays of roots taken in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[at] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def search_shard(fps: np.ndarray, home: np.ndarray, mask: int, radius: int, segment_radius: int) -> Forest:
    """Link every home member with every other member of the shard within ``radius``; a forest of the links."""
    forest = Forest(len(fps))
    mask_, full = np.uint64(mask), np.uint64(2**64 - 1)
    rng = np.random.default_rng(7)
    stack = [(np.flatnonzero(home), np.arange(len(fps)))]  # members to be found, members that ask
    while stack:
        member, asker = stack.pop()
        if not len(member) or not len(asker):
            continue
        if len(member) > LEAF:
            r = forest.roots(asker)
            if (r == r[0]).all() and (forest.roots(member) == r[0]).all():
                continue  # all hang together already
            split = None
            for _ in range(4):
                pick = member[rng.integers(len(member))]
                v = fps[pick]
                close = asker[_distance(fps[asker], v, full) <= radius]
                forest.join(close, np.full(len(close), pick))
                d = _distance(fps[member], v, mask_)
                mu = int(np.median(d))
                if (d > mu).any():
                    split = mu
                    break
                if (d < mu).any():
                    split = mu - 1
                    break
            if split is not None:
                e = _distance(fps[asker], v, mask_)
                stack.append((member[d <= split], asker[e <= split + segment_radius]))
                stack.append((member[d > split], asker[e > split - segment_radius]))
                continue
        _link_all(fps, member, asker, radius, forest)
    return forest


def _link_all(fps: np.ndarray, member: np.ndarray, asker: np.ndarray, radius: int, forest: Forest) -> None:
    """Compare a branch outright, in blocks; members that already hang with all askers are skipped."""
    for at in range(0, len(member), LEAF):
        block = member[at:at + LEAF]
        for to in range(0, len(asker), 8192):
            ask = asker[to:to + 8192]
            r = forest.roots(ask)
            if (r == r[0]).all() and (forest.roots(block) == r[0]).all():
                continue
            i, j = np.nonzero(np.bitwise_count(fps[block][:, None] ^ fps[ask][None, :]) <= radius)
            forest.join(block[i], ask[j])


def link_fingerprints(fps: DataFrame, radius: int, segments: int = 3) -> DataFrame:
    """Edges (a, b) of representatives that connect whatever links. ``fps``: distinct ``fp`` with ``rep``.

    Read from a written table, for it is read several times.
    """
    spark = fps.sparkSession
    n = fps.count()
    sample = fps.select("fp")
    if n > SAMPLE:
        sample = sample.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(SAMPLE / n * (1 << 20)))
    points = np.array(sorted(r[0] for r in sample.collect()), np.int64).view(np.uint64)
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / SHARD))))))
    masks = segment_masks(segments)
    near = radius // segments
    tops = spark.sparkContext.broadcast([TreeTop(points, m, levels, seed) for seed, m in enumerate(masks)])

    def assign(batches):
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, top in enumerate(tops.value):
                row, shard, home = top.assign(codes, near)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * segments + t, pa.int64()), b.column(0).take(taken), b.column(1).take(taken), pa.array(home)],
                    names=["shard", "fp", "rep", "home"])

    def search(key, group):
        tree = int(key[0].as_py()) % segments
        codes = group.column("fp").to_numpy().view(np.uint64)
        reps = group.column("rep").to_numpy()
        home = group.column("home").to_numpy()
        forest = search_shard(codes, home, masks[tree], radius, near)
        root = forest.roots(np.arange(len(codes)))
        linked = np.flatnonzero(root != np.arange(len(codes)))
        return pa.table({"a": reps[linked], "b": reps[root[linked]]})

    visits = fps.select("fp", "rep").mapInArrow(assign, "shard long, fp long, rep long, home boolean")
    return visits.groupBy("shard").applyInArrow(search, "a long, b long")


def linked_fingerprints(classes: DataFrame, radius: int, segments: int = 3) -> DataFrame:
    """Add ``component`` to rows of distinct ``fp``: the least fingerprint reachable over links, the own one included."""
    classes = common.checkpointed(classes)
    groups = connected_components(link_fingerprints(classes.select("fp", F.col("fp").alias("rep")), radius, segments))
    return classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 3, segments: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    The component is the smallest id reachable over links of at most ``radius`` differing bits,
    the own id included. Equal fingerprints always link, rows without a word (fingerprint zero)
    too. Fingerprints are linked, not ids: rows that share an id, or have none, hang together only
    by their texts. A null id is never the smallest of a group that has an id.
    """
    prints = common.checkpointed(fingerprints(docs, words, id_col, text_col))
    classes = common.checkpointed(linked_fingerprints(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, segments))
    # a lone fingerprint has its own least id; the members of a large group are dealt to several parts
    least = classes.groupBy("component").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1") \
        .select("component", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = classes.withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int")).join(least, ["component", "salt"], "left") \
        .select("fp", F.coalesce("first", "least").alias("component_id"))
    return prints.join(named, "fp") \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
