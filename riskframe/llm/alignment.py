"""Cross-tokenizer alignment by merge-path partitioning.

Two tokenizations of one text end their tokens at byte offsets. Merging both lists of ends tells which
tokens overlap, and an offset where both end closes a group. The merge is cut by diagonals: the
binary search on a diagonal finds how many ends of each list lie before it, so every piece
between two diagonals holds the same number of ends and is merged on its own, however the texts
lie in it. A pair of equal ends that a diagonal parts is put together when pieces are stitched.

Both vocabularies never join a character with a blank that follows it, so a text falls into units
(a blank and what follows, up to the next blank after a visible character) that both tokenize apart
from each other. The distinct units of a block of texts are joined, tokenized and merged once;
documents are made of units. Id pairs are counted over the corpus by way of block dictionaries.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import blocks, common, packing

#: Ends in a piece between two diagonals.
PIECE = 1 << 15
#: Units that a worker remembers.
MEMO_UNITS = 400_000

_INNER_BOUNDARY = re.compile(r"(?<=\S)(?= )")
_BLANK_AFTER_WHITE = re.compile(r"\s ")
SCHEMA = ("block long, a int, b int, entries " + blocks.ENTRIES + ", total long, doc int, doc_id long, "
          "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


def diagonal_cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of ``a`` and of ``b`` before each diagonal of the merge (equal ends: ``a`` first), one in ``size`` diagonals and the last."""
    d = np.append(np.arange(0, len(a) + len(b), size), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(d), bool)  # a[mid] comes before b[d - mid - 1]
        before[open_] = a[mid[open_]] <= b[(d - mid - 1)[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece in merge order: places in ``a`` and in ``b`` (its length: what the next piece begins with), and whether they end together."""
    at = np.searchsorted(b, a, "left")
    equal = np.zeros(len(a), bool)
    inside = at < len(b)
    equal[inside] = b[at[inside]] == a[inside]
    alone = np.ones(len(b), bool)
    alone[at[equal]] = False
    lone = np.flatnonzero(alone)
    i = np.concatenate([np.arange(len(a)), np.searchsorted(a, b[lone], "left")])
    j = np.concatenate([at, lone])
    order = np.argsort(np.concatenate([a, b[lone]]), kind="stable")
    return i[order], j[order], np.concatenate([equal, np.zeros(len(lone), bool)])[order]


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs of two token lists with ascending ends over the same bytes: places in both and whether they end together."""
    cut_a, cut_b = diagonal_cuts(a, b, size)
    pieces = []
    for k in range(len(cut_a) - 1):
        i0, i1, j0, j1 = cut_a[k], cut_a[k + 1], cut_b[k], cut_b[k + 1]
        i, j, together = merge_piece(a[i0:i1], b[j0:j1])
        if k and i0 and j0 < len(b) and a[i0 - 1] == b[j0]:  # the diagonal parted equal ends
            pieces[-1][2][-1] = True
            i, j, together = i[1:], j[1:], together[1:]
        pieces.append((i + i0, j + j0, together))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


class Tokenizers:
    """Vocabulary A (byte-level, tokenizers file) and B (pieces with byte fallback), ids and bytes of plain text."""

    def __init__(self, path_a: str, path_b: str):
        self.a = packing.FastTokenizer(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a = [self.a.bpe.bytes_of.get(i, b"") for i in range(max(self.a.bpe.bytes_of) + 1)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of A; strings of special tokens are plain text."""
        bpe = self.a.bpe
        if not text.isascii() and not bpe.plain.issuperset(rare := set(text)):
            bpe._words("".join(rare))
            if not bpe.plain.issuperset(rare):
                return np.array([i for w in bpe._words(text) for i in self.a.by_words.encode_ordinary(w)], np.int64)
        return self.a.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)

    def ids_b(self, units: list[str]) -> np.ndarray:
        """Ids of B of units whose leading blank B adds itself."""
        found = [ids or [self.blank] for ids in self.b.encode(units, num_threads=1)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64)

    def units(self, text: str) -> list[str]:
        """A text after its blank, cut into units without their leading blank."""
        if not self.splits:
            return [text]
        if text[:1] != " " and not _BLANK_AFTER_WHITE.search(text):
            return text.split(" ")
        return [u[1:] for u in _INNER_BOUNDARY.split(" " + text)]

    def exact(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        raw = text.encode()
        return b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw


class Aligner:
    """Aligned units, remembered by a worker: group texts, token counts, and links as (a << 32 | b)."""

    def __init__(self, path_a: str, path_b: str):
        self.tok = Tokenizers(path_a, path_b)
        text = [str(i) for i in range(max(len(self.tok.bytes_a), len(self.tok.bytes_b)))]
        self.comma, self.bar, self.semi = (np.array([x + c for x in text], object) for c in ",|;")
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: bytes differ
        self.n_a, self.n_b, self.starts, self.links = (np.zeros(n, np.int64) for n in (0, 0, 1, 0))

    def learn(self, units: set[str]) -> None:
        """Align units that the memo does not hold yet."""
        if len(self.place) > MEMO_UNITS:
            self.clear()
        new = sorted(units.difference(self.place))
        joined = [u for u in new if u and not u[-1].isspace()]
        self._align(joined)
        if len(joined) < len(new):
            for u in new:  # nothing may follow white space at a unit's end
                if not u or u[-1].isspace():
                    self._align([u])

    def _align(self, units: list[str]) -> None:
        if not units:
            return
        tok, text = self.tok, " " + " ".join(units)
        a, b = tok.ids_a(text), tok.ids_b(units)
        if not tok.exact(text, a, b):
            if len(units) > 1:
                half = len(units) // 2
                self._align(units[:half])
                self._align(units[half:])
            else:
                self._keep(units, [None], *[np.zeros(1, np.int64)] * 3, np.zeros(0, np.int64))
            return
        end_a, end_b = np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b])
        ends = np.cumsum(np.fromiter((1 + len(u.encode()) for u in units), np.int64, len(units)))
        i, j, together = overlaps(end_a, end_b)
        i, j = i[together], j[together]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[i], last_b[j] = True, True
        # tokens in the order of the group texts: a group's tokens of A, then its tokens of B
        parts = np.empty(len(a) + len(b), object)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        parts[np.arange(len(a)) + np.append(0, j + 1)[group_a]] = np.where(last_a, self.bar[a], self.comma[a])
        parts[np.arange(len(b)) + (i + 1)[group_b]] = np.where(last_b, self.semi[b], self.comma[b])
        n_a, n_b, n = (np.searchsorted(e, ends, "right") for e in (end_a, end_b, end_a[i]))
        cut = np.append(0, n_a + n_b).tolist()
        parts = parts.tolist()
        self._keep(units, ["".join(parts[s:e])[:-1] for s, e in zip(cut, cut[1:], strict=False)], *[np.diff(x, prepend=0) for x in (n_a, n_b, n)], a[i] << 32 | b[j])

    def _keep(self, units, groups, n_a, n_b, n_links, links) -> None:
        for u in units:
            self.place[u] = len(self.place)
        self.groups += groups
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(n_links))
        self.links = np.append(self.links, links)

    def block(self, texts: list) -> tuple[dict[str, list | np.ndarray], np.ndarray, np.ndarray]:
        """Figures per text, and all links with the place of their text."""
        units = [self.tok.units(t) if t else [] for t in texts]
        self.learn(set().union(*units))
        at = [list(map(self.place.__getitem__, us)) for us in units]
        texts = [list(map(self.groups.__getitem__, us)) for us in at]
        for k, groups in enumerate(texts):
            if None in groups:
                at[k] = texts[k] = []
        n = np.fromiter(map(len, at), np.int64, len(at))
        unit = np.fromiter(itertools.chain.from_iterable(at), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(at)), n)
        size = np.diff(self.starts)[unit]
        of = np.repeat(doc, size)
        first = np.cumsum(size) - size
        links = self.links[np.repeat(self.starts[unit] - first, size) + np.arange(len(of))]
        total = lambda x: np.bincount(doc, x, len(at)).astype(np.int64)
        sha = [hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "" for groups in texts]
        return {"n_a": total(self.n_a[unit]), "n_b": total(self.n_b[unit]), "n_groups": total(size), "n_links": total(size), "groups_sha256": sha}, links, of


def align_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds per block: id pairs with their entries (``a`` set) and documents with their figures (``doc`` set)."""
    def run(batches):
        aligner, number = Aligner(path_a, path_b), blocks.numbers()
        names = [f.strip().split(" ")[0] for f in SCHEMA.replace(blocks.ENTRIES, "x").split(",")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), blocks.ENTRIES_ARROW, pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]

        def out(n, **cols):
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for part, texts in common.chunks(batch, 1, blocks.BLOCK_BYTES):
                block, n = next(number), len(texts)
                figures, links, of = aligner.block(texts)
                yield out(n, block=pa.array(np.full(n, block)), doc=pa.array(np.arange(n, dtype=np.int32)), doc_id=part.column(0),
                          **{k: pa.array(v) for k, v in figures.items()})
                pairs, pair = np.unique(links, return_inverse=True)
                present, held, total = blocks.entries(pair, of, len(pairs), n)
                pairs = pairs[present]
                yield out(len(pairs), block=pa.array(np.full(len(pairs), block)), a=pa.array((pairs >> 32).astype(np.int32)),
                          b=pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), entries=held, total=pa.array(total))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` (links of the id pair in the corpus) and ``best`` (1 where no pair of the same B id has more)."""
    counts = rows.where("a is not null").groupBy("a", "b").agg(F.sum("total").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align both tokenizations of a blank and each text; one row per input row.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (token pairs that end together), ``n_best`` (links whose id
    pair no other pair of the same B id outnumbers in the corpus), ``count_sum`` (corpus counts of the
    id pairs, over links) and ``groups_sha256`` of ``a1,a2|b1;a3|b2``.

    A null or empty text, and one that a tokenizer does not give back byte for byte, has zeros and an
    empty hash and adds nothing to the counts. Rows are told apart by their place, so repeated rows
    and null ids each keep their row and count each; other columns of the input are not read.
    A very long text is one unit of work for the tokenizers and is merged piece by piece.
    """
    rows = common.written(align_blocks(docs, path_a, path_b, id_col, text_col))
    counts = common.written(pair_counts(rows))
    held = rows.where("a is not null").select("block", "a", "b", "entries").join(counts, ["a", "b"]).select("block", "entries", "count", "best")
    sums = blocks.back_to_documents(held, n_best=F.col("n") * F.col("best"), count_sum=F.col("n") * F.col("count"))
    found = rows.where("doc is not null").select("block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return found.join(sums, ["block", "doc"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
