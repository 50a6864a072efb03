"""Language identification by cross-parsing entropy.

Per language, a bounded sample of labelled text is compiled into a suffix automaton. A text is
parsed greedily against each automaton: every phrase is the longest match that occurs in the
language's sample. The language that needs the fewest phrases, normalised to bits per byte by the
sample's length, wins (Ziv-Merhav cross entropy).

Texts are parsed whole, as lower-cased UTF-8 bytes, in blocks of ``BLOCK`` bytes; phrases end at a
block's end. Blocks of all texts advance through the automata side by side as numpy lanes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

#: Bounds of the labelled sample: distinct blocks of each language, characters of a block, and bytes of a language.
SAMPLE_BLOCKS = 96
SAMPLE_BLOCK = 512
SAMPLE_BYTES = 65_536

BLOCK = 512
#: Sharpness of the score: weight of one bit per byte between two languages.
SHARPNESS = 4.0
UNDETERMINED = "und"

_NOT_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_AUTOMATA: dict[tuple, list] = {}


def _normal(text: str) -> bytes:
    """Lower-cased UTF-8 bytes, ASCII that is no letter as space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_NOT_LETTERS)


def suffix_automaton(text: bytes) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and longest lengths of the states of the suffix automaton of ``text``."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt, length


class PhraseCounter:
    """Greedy phrase counts of many blocks against one language's sample.

    The automaton becomes one flat table: entry ``2 * next row + flag``, where the flag says that
    the longest match ended before this byte and a new phrase begins with it.
    """

    def __init__(self, sample: bytes):
        self.bits = math.log2(max(2, len(sample)))
        nxt, _ = suffix_automaton(sample)
        seen = sorted(set(sample))
        width = len(seen) + 2  # other bytes, padding
        code = np.full(256, len(seen), np.uint8)
        code[seen] = np.arange(len(seen))
        self.code, self.pad = code, width - 1
        out = np.zeros((len(nxt), width), np.int32)
        for c, to in nxt[0].items():
            out[0, code[c]] = 2 * width * to
        restart = out[0] | 1  # the match ended; the byte itself starts the next phrase
        out[:] = restart
        for s, row in enumerate(nxt):
            for c, to in row.items():
                out[s, code[c]] = 2 * width * to
        out[:, self.pad] = 0
        self.table = out.ravel()

    def count(self, columns: np.ndarray) -> np.ndarray:
        """Phrases per lane; ``columns[j]`` holds byte j of every lane, 256 as padding."""
        code = np.append(self.code, np.uint8(self.pad))
        lanes = columns.shape[1]
        state = np.zeros(lanes, np.intp)
        entry = np.zeros(lanes, np.int32)
        phrases = np.zeros(lanes, np.int32)
        for col in columns:
            state += code[col]
            np.take(self.table, state, out=entry, mode="clip")
            phrases += entry & 1
            np.right_shift(entry, 1, out=state, casting="unsafe")
        return phrases


def _automata(samples: tuple[tuple[str, bytes], ...]) -> list:
    if samples not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[samples] = [PhraseCounter(s) for _, s in samples]
    return _AUTOMATA[samples]


def cross_entropies(texts: list, samples: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Bits per byte of every text (rows) under every language (columns)."""
    data = [_normal(t) if t else b"" for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    blocks = -(-sizes // BLOCK)
    grid = np.full((int(blocks.sum()), BLOCK), 256, np.uint16)
    flat, first = grid.reshape(-1), np.concatenate([[0], np.cumsum(blocks)])
    for d, at in zip(data, first, strict=False):
        flat[at * BLOCK:at * BLOCK + len(d)] = np.frombuffer(d, np.uint8)
    order = np.argsort((grid != 256).sum(1), kind="stable") if len(grid) else np.zeros(0, int)
    columns = np.ascontiguousarray(grid[order].T)
    owner = np.repeat(np.arange(len(data)), blocks)[order]
    out = np.zeros((len(data), len(samples)))
    for k, counter in enumerate(_automata(samples)):
        if len(grid):
            phrases = np.bincount(owner, counter.count(columns) + 1, minlength=len(data))
            out[:, k] = phrases * counter.bits / np.maximum(sizes, 1)
    return out


def _least_blocks(batches):
    """A task's ``SAMPLE_BLOCKS`` distinct blocks of least hash of each label, from its whole texts."""
    best: dict[str, dict[int, str]] = {}
    limit: dict[str, int] = {}
    for batch in batches:
        labels = batch.column(1).to_pylist()
        at = 0
        for _, texts in common.chunks(batch, 0):
            for text in texts:
                label = labels[at]
                at += 1
                held, most = best.setdefault(label, {}), limit.get(label, 1 << 64)
                for k in range(0, len(text), SAMPLE_BLOCK):
                    block = text[k:k + SAMPLE_BLOCK]
                    h = xxhash.xxh64_intdigest(block.encode("utf-8", "surrogatepass"))
                    if h < most and _normal(block).strip():
                        held[h] = block
                        if len(held) >= 4 * SAMPLE_BLOCKS:
                            best[label] = held = dict(sorted(held.items())[:SAMPLE_BLOCKS])
                            limit[label] = most = max(held)
    rows = [(label, h, block) for label, held in best.items() for h, block in sorted(held.items())[:SAMPLE_BLOCKS]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] - (1 << 63) for r in rows], pa.int64()),
                                      pa.array([r[2] for r in rows], pa.string())], names=["l", "h", "t"])


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> tuple[tuple[str, bytes], ...]:
    """Samples per language from labelled rows that are not held out.

    Every label is a language. Its whole texts are cut into blocks of ``SAMPLE_BLOCK`` characters, and its
    sample is the ``SAMPLE_BLOCKS`` distinct blocks of least hash (``SAMPLE_BYTES`` at most), so copies count
    once and neither a text's length nor its place in the table matters. Rows with a null text or
    label are not used; an empty table gives no language. A task sends at most that many blocks a label.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")) \
        .where(~common.held_out(F.col(id_col)) & F.col("t").rlike(r"\p{L}") & F.col("l").isNotNull())
    picked = rows.mapInArrow(_least_blocks, "l string, h long, t string").dropDuplicates(["l", "h"]) \
        .withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("k") <= SAMPLE_BLOCKS)
    samples: dict[str, list[str]] = {}
    for r in picked.orderBy("l", "k").collect():
        samples.setdefault(r["l"], []).append(r["t"])
    return tuple((lang, _normal("\n".join(ts))[:SAMPLE_BYTES]) for lang, ts in sorted(samples.items()))


def identify_languages(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``bits_per_byte`` to the rows of ``docs``.

    ``und`` with score 0 where the text is null, has no letter, or no language was learned. Equal
    entropies go to the language first in the alphabet. Columns of these names are replaced.
    """
    flagged = docs.withColumn("__letter", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = np.array([lang for lang, _ in samples], object)

    def make():
        def compute(texts):
            if not samples:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)]
            bits = cross_entropies(texts, samples)
            best = bits.argmin(1)
            low = bits[np.arange(len(best)), best]
            score = 1 / np.exp(-SHARPNESS * (bits - low[:, None])).sum(1)
            return [names[best].tolist(), score, low]
        return compute

    out = common.append_columns(flagged, text_col, [
        ("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()),
        ("bits_per_byte", T.DoubleType(), pa.float64())], make)
    return out.withColumns({
        "lang_pred": F.when(F.col("__letter"), F.col("lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(F.col("__letter"), F.col("score")).otherwise(0.0)}).drop("__letter")
