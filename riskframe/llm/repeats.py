"""Removal of repeated passages through depth-limited suffix order.

A byte is removed when a window of ``size`` bytes that covers it also starts earlier. Sorting all
suffixes would move the corpus many times over, so only suffixes that can repeat are ordered:

1. Every window has one anchor, the leftmost least hash of its ``GRAM``-byte strings. Equal windows
   have equal anchors at equal places, so windows are kept as runs that share an anchor, and only
   one row a run travels: anchor hash, hash of the run's bytes, position.
2. By anchor, runs with equal bytes repeat as a whole but for the earliest. Runs whose anchor has
   other runs with different bytes are open; all others hold no repeated window.
3. The windows of open runs are ordered by most-significant-digit passes, eight bytes a pass, and
   no further than ``size`` bytes. Groups of one window fall out at each pass; groups that remain
   are exactly the repeated windows, and all but their earliest member are removed.

Copies inside a chunk of texts are settled there, so a passage that a third of the texts share
travels once a chunk. A row is named by its id and the 64-bit hash of its text throughout. Rows of equal id
and equal text count as one document; rows of equal id and different text are ordered by that hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

SIZE = 100
#: Bytes of an anchor string (its hash is built for 24), and text bytes worked on at a time.
GRAM = 24
CHUNK = 1 << 20
#: Bytes of open runs that are ordered at a time.
ORDER_BYTES = 2 << 20

_NULL_ID = -(1 << 63)
_RUN = "key long, ctx long, doc long, tag long, pos long"


def _pos(start: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Start of a run and its windows less one (7 bits), in order of position."""
    return (start << 7) | extra


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position on."""
    table = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h, width = table[data], 1
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        h = h[:-width] * np.uint64(factor) + h[width:]
        width *= 2
    n = len(data) - GRAM + 1
    h = h[:n] * np.uint64(0xFF51AFD7ED558CCD) + h[8:n + 8] * np.uint64(0xC4CEB9FE1A85EC53) + h[16:n + 16]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchor_runs(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, anchor, anchor hash (over all of ``data``)."""
    h = _gram_hashes(data)
    span = size - GRAM + 1
    low, width = h, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    least = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(least) - 1]])
    anchor = np.empty(len(first), np.int64)
    for at in range(0, len(first), 16384):
        f = first[at:at + 16384]
        anchor[at:at + 16384] = f + h[f[:, None] + np.arange(span)].argmin(1)
    tied = np.flatnonzero(anchor < last)
    if len(tied):  # the least hash occurs again while the run goes on: the next occurrence takes over
        keep = np.ones(len(first), bool)
        keep[tied] = False
        parts = [(first[keep], last[keep], anchor[keep])]
        for r in tied.tolist():
            a, b = int(first[r]), int(last[r])
            where = a + np.flatnonzero(h[a:b + span] == least[a])
            where = where[:int(np.searchsorted(where, b)) + 1]
            begin = np.concatenate([[a], where[:-1] + 1])
            parts.append((begin, np.minimum(where, b), where))
        first, last, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(first, kind="stable")
        first, last, anchor = first[order], last[order], anchor[order]
    return first, last, anchor, h[anchor]


def _index_rows(size: int):
    """Texts to rows: open index rows, and runs already known as repeats (null ``ctx``)."""
    span = size - GRAM + 1

    def run(batches):
        for batch in batches:
            for part, texts in common.chunks(batch, 1, CHUNK):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                tags = part.column(2).to_numpy(zero_copy_only=False)
                raw = common.utf8(texts)
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                use = np.lexsort((tags, ids))
                use = use[sizes[use] >= size]
                if not len(use):
                    continue
                flat = b"".join([raw[i] for i in use.tolist()])
                ends = np.cumsum(sizes[use])
                begins = ends - sizes[use]
                first, last, _, key = anchor_runs(np.frombuffer(flat, np.uint8), size)
                # cut the runs at the texts' ends: a window must lie inside its text
                doc = np.searchsorted(ends, first, "right")
                stop = np.searchsorted(ends, last, "right")
                wide = stop > doc
                tail_doc, tail_last, tail_key = stop[wide], last[wide], key[wide]
                last = np.minimum(last, ends[doc] - size)
                tail_first = begins[tail_doc]
                doc, first, last, key = (np.concatenate(x) for x in ((doc, tail_doc), (first, tail_first), (last, np.minimum(tail_last, ends[tail_doc] - size)), (key, tail_key)))
                ok = last >= first
                doc, first, last, key = doc[ok], first[ok], last[ok], key[ok].view(np.int64)
                hash_ = xxhash.xxh3_64_intdigest
                ctx = np.array([hash_(flat[a:b]) for a, b in zip(first.tolist(), (last + size).tolist(), strict=True)], np.uint64).view(np.int64)
                d, tag, pos = ids[use][doc], tags[use][doc], _pos(first - begins[doc], last - first)
                order = np.lexsort((pos, tag, d, ctx, key))
                key, ctx, d, tag, pos = key[order], ctx[order], d[order], tag[order], pos[order]
                again = np.concatenate([[False], (key[1:] == key[:-1]) & (ctx[1:] == ctx[:-1])])
                same = np.concatenate([[False], again[1:] & (d[1:] == d[:-1]) & (tag[1:] == tag[:-1]) & (pos[1:] == pos[:-1])])
                keep = ~same
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(again, d, key)[keep]), pa.array(ctx[keep], mask=again[keep]), pa.array(d[keep]), pa.array(tag[keep]), pa.array(pos[keep])],
                    names=["key", "ctx", "doc", "tag", "pos"])
    assert span > 0
    return run


def _verdicts(batches):
    """Rows sorted by key, ctx and position to settled runs (null ``key``) and open ones.

    Streams: only the first row of the current key waits for a sign of another run of that key.
    """
    last = wait = None  # the row before, and the key's first row while nothing differs from it
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        known = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        key, ctx, doc, tag, pos = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in batch.columns)
        out = [(doc[known], tag[known], pos[known], np.zeros(0, np.int64), 0)]
        key, ctx, doc, tag, pos = (x[~known] for x in (key, ctx, doc, tag, pos))
        if len(key):
            lk, lc, ld, lt, lp = last or (~key[0], 0, 0, 0, 0)
            before = lambda x, v: np.concatenate([[v], x[:-1]])
            same_key = key == before(key, lk)
            if last is None:
                same_key[0] = False
            same_ctx = same_key & (ctx == before(ctx, lc))
            same_row = same_ctx & (doc == before(doc, ld)) & (tag == before(tag, lt)) & (pos == before(pos, lp))
            new_ctx = ~same_ctx
            settled = same_ctx & ~same_row
            out.append((doc[settled], tag[settled], pos[settled], None, 0))
            group = np.cumsum(~same_key)  # 0: the key that goes on from before
            differs = np.zeros(int(group[-1]) + 1, bool)
            differs[group[new_ctx & same_key]] = True
            if wait is not None and differs[0]:
                out.append((*(np.array([x]) for x in wait[1:]), np.array([wait[0]]), 1))
                wait = None
            begins_key = ~same_key
            is_open = new_ctx & (same_key | differs[group])
            is_open &= ~(begins_key & ~differs[group])
            out.append((doc[is_open], tag[is_open], pos[is_open], key[is_open], 1))
            if begins_key.any():
                i = int(np.flatnonzero(begins_key)[-1])
                wait = None if differs[group[i]] else (key[i], doc[i], tag[i], pos[i])
            last = (key[-1], ctx[-1], doc[-1], tag[-1], pos[-1])
        d, t, p = (np.concatenate([o[i] for o in out]) for i in range(3))
        k = np.concatenate([o[3] if o[4] else np.zeros(len(o[0]), np.int64) for o in out])
        settled = np.concatenate([np.full(len(o[0]), not o[4]) for o in out])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(p), pa.array(k, mask=settled)], names=["doc", "tag", "pos", "key"])


def _open_bytes(size: int):
    """Texts with their verdicts to the bytes of open runs; settled runs pass."""
    def run(batches):
        for batch in batches:
            for part, texts in common.chunks(batch, 1, CHUNK):
                doc, tag, pos, key, data = [], [], [], [], []
                for d, text, t, runs in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for r in runs or ():
                        p, k = r["pos"], r["key"]
                        doc.append(d)
                        tag.append(t)
                        pos.append(p)
                        key.append(k if k is not None else d)
                        start = p >> 7
                        data.append(None if k is None else raw[start:start + (p & 127) + size])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(x, pa.int64()) for x in (doc, tag, pos)], pa.array(data, pa.binary())],
                                                 names=["key", "doc", "tag", "pos", "data"])
    return run


def repeated_windows(data: list[bytes], group: np.ndarray, size: int) -> np.ndarray:
    """For runs in order of position: a flag per window (runs laid end to end), true for all but the earliest equal one.

    Windows can be equal only in one group and at the same distance from the run's anchor, which
    ``group`` stands for. Most-significant-digit passes over 8 bytes.
    """
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    windows = sizes - size + 1
    flat = np.frombuffer(b"".join(data) + bytes(8), np.uint8)
    eight = np.zeros(len(flat) - 8, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | flat[j:j + len(eight)]
    run = np.repeat(np.arange(len(data)), windows)
    first = np.cumsum(windows) - windows
    start = np.arange(int(windows.sum())) - first[run] + (np.cumsum(sizes) - sizes)[run]
    part = group[run]
    at = np.arange(len(start))
    for depth in range(0, size, 8):
        digit = eight[start[at] + depth]
        if depth + 8 > size:
            digit = digit >> np.uint64(8 * (depth + 8 - size))
        order = np.lexsort((digit, part))
        at, digit, part = at[order], digit[order], part[order]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (digit[1:] != digit[:-1])])[:len(at)]
        part = np.cumsum(new)
        many = np.bincount(part)[part] > 1
        at, part = at[many], part[many]
        if not len(at):
            break
    flags = np.zeros(len(start), bool)
    if len(at):
        flags[at[1:][part[1:] == part[:-1]]] = True
    return flags


def _order_open(size: int):
    """Open runs sorted by key and position to the runs of repeated windows in them; settled runs pass."""
    def settle(rows: list[tuple]) -> tuple[list[tuple], list]:
        data = [r[4] for r in rows]
        group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
        flags = repeated_windows(data, group, size)
        found, at, fresh = [], 0, []
        for r in rows:
            n = len(r[4]) - size + 1
            f = flags[at:at + n]
            at += n
            fresh.append(not f.all())
            if r[5] or not f.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            start = r[3] >> 7
            found += [(r[1], r[2], (start + a) << 7 | (b - a - 1)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        return found, fresh

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["doc", "tag", "pos"])

    def run(batches):
        held: list[tuple] = []
        held_bytes = 0
        last = None
        for batch in batches:
            settled = batch.column(4).is_null()
            passed = batch.filter(settled)
            found = list(zip(*[passed.column(i).to_pylist() for i in (1, 2, 3)], strict=True))
            rest = batch.filter(pc.invert(settled))
            for row in zip(*[c.to_pylist() for c in rest.columns], strict=True):
                if row[:4] == last:  # the same run of a repeated row (equal id and text): one document
                    continue
                last = row[:4]
                if held_bytes >= ORDER_BYTES and held[-1][0] != row[0]:
                    found += settle(held)[0]
                    held, held_bytes = [], 0
                elif held_bytes >= 4 * ORDER_BYTES:  # a hot key: go on with the runs that hold a first window
                    more, fresh = settle(held)
                    found += more
                    held = [(*r[:5], True) for r, new in zip(held, fresh, strict=True) if new and r[0] == row[0]]
                    held_bytes = 0
                held.append((*row, False))
                held_bytes += len(row[4])
            yield out(found)
        if held:
            yield out(settle(held)[0])
    return run


def removed_spans(positions: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of one text from its repeated runs of windows."""
    out: list[list[int]] = []
    for a, b in sorted((p >> 7, (p >> 7) + (p & 127) + size) for p in positions):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``).

    ``carry`` names columns of ``docs`` that come along as one struct ``carried``.

    A null text is empty; texts shorter than ``size`` bytes lose nothing; a null id comes before
    all ids. ``kept`` is the remaining text, without the parts of characters that a cut left over.
    """
    if not GRAM < size < GRAM + 120:
        raise ValueError(f"size must lie between {GRAM + 1} and {GRAM + 119}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    texts = docs.select(*rest, F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("tag"))
    extra = ["carried"] if carry else []
    rows = texts.select("doc", "text", "tag").where(F.octet_length("text") >= size).mapInArrow(_index_rows(size), _RUN)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    verdicts = rows.repartition(parts, "key").sortWithinPartitions("key", "ctx", "doc", "tag", "pos") \
        .mapInArrow(_verdicts, "doc long, tag long, pos long, key long")
    runs = verdicts.groupBy("doc", "tag") \
        .agg(F.collect_list(F.struct("pos", "key")).alias("runs"))
    # a left join as below: both then read one exchange of the texts
    opened = texts.join(runs.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "tag", "runs", *extra) \
        .mapInArrow(_open_bytes(size), "key long, doc long, tag long, pos long, data binary")
    found = opened.repartition(parts, "key").sortWithinPartitions("key", "doc", "tag", "pos") \
        .mapInArrow(_order_open(size), "doc long, tag long, pos long")
    spans = found.groupBy("doc", "tag") \
        .agg(F.collect_list("pos").alias("spans"))

    def finish(batches):
        for batch in batches:
            for part, values in common.chunks(batch, 1):
                n, gone, count, sha, left = [], [], [], [], []
                for raw, positions in zip(common.utf8(values), part.column(2).to_pylist(), strict=True):
                    cut = removed_spans(positions or [], size)
                    edges = [0, *[x for ab in cut for x in ab], len(raw)]
                    kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    n.append(len(raw))
                    gone.append(len(raw) - len(kept))
                    count.append(len(cut))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode("utf-8", "ignore") if with_text else None)
                ids = part.column(0)
                ids = pc.if_else(pc.equal(ids, _NULL_ID), pa.scalar(None, pa.int64()), ids)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (n, gone, count)], pa.array(sha, pa.string()), pa.array(left, pa.string()), *part.columns[3:]],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *extra])

    out = texts.join(spans.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "spans", *extra)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    out = out.mapInArrow(finish, T.StructType([*schema.fields, *[out.schema[c] for c in extra]]))
    return out if with_text else out.drop("kept")
