"""Quality rules on tokeniser fertility.

A public subword vocabulary measures every text: characters per token, the share of byte-fallback
tokens, and the entropy of the text's tokens against the most that so many tokens can have. Prose
of one language and about one length keeps within bands of these measures; what lies far outside
is rejected. The bands come from all distinct texts: for each language label (script, where there is
no label) and power of two of word characters, the quartiles of each measure, widened by a
multiple of their distance. A group of few texts takes the band of its language, then of its
script, then of the whole corpus.

Base counts (words, symbols, repeated lines and five-word windows) are taken in the same pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Base rules: least words, most percent of words in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Width of the bands in distances between the quartiles, and the least half-width of each measure.
BAND = 3.0
LEAST_WIDTH = {"chars_per_token": 0.06, "byte_share": 0.02, "entropy": 0.03}
#: Distinct texts that a band must come from at least; a group with fewer takes the next wider one. Of the
#: whole corpus, any number will do.
MIN_TEXTS = 30
#: Accuracy of the quartiles (rank error one in so many rows).
ACCURACY = 1000
MEMO_WORDS = 200_000

#: Scripts by the lead byte of their UTF-8 letters.
SCRIPTS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF],
           "cyrillic": [*range(0xD0, 0xD4)], "hebrew_arabic": [*range(0xD6, 0xDC)], "indic": [0xE0],
           "cjk": [*range(0xE3, 0xEE)], "other": [0xCA, 0xCB, 0xD4, 0xD5, 0xE1, 0xE2, 0xEF, *range(0xF0, 0xF5)]}
_SCRIPT_NAMES = [*SCRIPTS, "none"]
_SCRIPT_OF = np.zeros((256, len(SCRIPTS)), np.int64)
for _k, _bytes in enumerate(SCRIPTS.values()):
    _SCRIPT_OF[_bytes, _k] = 1
_MIX = np.random.default_rng(5).integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Fertility:
    """Pieces of words under a vocabulary with byte fallback; a worker remembers words it met."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.memo: dict[bytes, np.ndarray] = {}

    def pieces(self, words: list[bytes]) -> list[np.ndarray]:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        for w, ids in zip(new, self.sp.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else [], strict=True):
            self.memo[w] = np.array(ids, np.int32)
        return [self.memo[w] for w in words]


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Per text: words in windows of ``width`` words that occur twice or more in it (64-bit keys)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    key = doc[at].astype(np.uint64) * _MIX[5]
    for k in range(width):
        key += (ids[at + k].astype(np.uint64) + np.uint64(1)) * _MIX[k]
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    return np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=n_docs)


def measure(texts: list, fertility: Fertility) -> dict[str, np.ndarray | list]:
    """Base counts and fertility measures of every text; a null text has no word."""
    n_docs = len(texts)
    texts = [t or "" for t in texts]
    raw = common.utf8(texts)
    words = [b.split() for b in raw]
    n_words = np.fromiter(map(len, words), np.int64, n_docs)
    dup = np.zeros(n_docs, np.int64)
    for k, t in enumerate(texts):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(WHITE)]
            dup[k] = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n_docs), n_words)
    pieces = fertility.pieces(list(index))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    bytes_in = np.zeros(len(pieces), np.int64)
    if len(flat):
        bytes_in = np.bincount(np.repeat(np.arange(len(pieces)), lengths), fertility.byte[flat], minlength=len(pieces)).astype(np.int64)
    total = lambda per_word: np.bincount(doc, per_word[ids], minlength=n_docs).astype(np.int64) if len(ids) else np.zeros(n_docs, np.int64)
    n_tokens = total(lengths)
    size = lengths[ids]
    ends = np.cumsum(size)
    token = flat[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat((np.cumsum(lengths) - lengths)[ids], size)]
    key = np.sort(np.repeat(doc, size) * fertility.size + token)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([cut, [len(key)]])).astype(float)
    owner = key[cut] // fertility.size
    share = count / np.maximum(n_tokens, 1)[owner] if len(cut) else count
    entropy = np.bincount(owner, -share * np.log2(share), minlength=n_docs) if len(cut) else np.zeros(n_docs)
    most = np.log2(np.maximum(2, np.minimum(n_tokens, fertility.size)))
    word_chars = np.array([len(t) - sum(map(t.count, WHITE)) for t in texts], np.int64)
    scripts = np.array([np.bincount(np.frombuffer(b, np.uint8), minlength=256) @ _SCRIPT_OF for b in raw]).reshape(n_docs, len(SCRIPTS))
    script = np.where(scripts.any(1), scripts.argmax(1), len(SCRIPTS)) if n_docs else []
    some = np.maximum(n_tokens, 1)
    return {"n_words": n_words, "word_chars": word_chars,
            "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64), "n_dup_lines": dup,
            "n_repeat_words": _repeat_words(ids, doc, n_docs), "script": [_SCRIPT_NAMES[k] for k in script],
            "chars_per_token": word_chars / some, "byte_share": total(bytes_in) / some, "entropy": entropy / most}


MEASURES = ("chars_per_token", "byte_share", "entropy")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add base counts, ``base_failed``, script and fertility measures (columns of these names are replaced)."""
    def make():
        fertility = Fertility(path)

        def compute(texts):
            m = measure(texts, fertility)
            return [m[c] for c in (*_COUNTS, "script", *MEASURES)]
        return compute

    out = common.append_columns(docs, text_col, [
        *[(c, T.LongType(), pa.int64()) for c in _COUNTS], ("script", T.StringType(), pa.string()),
        *[(c, T.DoubleType(), pa.float64()) for c in MEASURES]], make)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


_LEVELS = ("band", "label", "script", "corpus")


def _group(level: str) -> Column:
    """The name of a row's group at a level, unlike any name of another level."""
    return F.concat_ws(":", F.lit(level), F.lit("") if level == "corpus" else F.col(level))


def fit_bands(measured: DataFrame) -> DataFrame:
    """Per ``band, label, script``: ``<measure>_low, <measure>_high`` of each measure.

    They come from the distinct texts (``digest``) that pass the base rules, in the narrowest of
    the row's groups that has ``MIN_TEXTS`` of them.
    """
    quart = [F.percentile_approx(m, [0.25, 0.75], ACCURACY).alias(m) for m in MEASURES]
    texts = measured.where(~F.col("base_failed")).select(F.explode(F.array(*map(_group, _LEVELS))).alias("group"), "digest", *MEASURES).distinct()
    groups = common.checkpointed(texts.groupBy("group").agg(F.count("*").alias("n"), *quart)
                                 .where((F.col("n") >= MIN_TEXTS) | (F.col("group") == "corpus:")).select("group", F.struct(*MEASURES).alias("q")))
    keys = measured.select("band", "label", "script").distinct()
    for level in _LEVELS:
        keys = keys.withColumn("group", _group(level)).join(groups.withColumnRenamed("q", f"q_{level}"), "group", "left").drop("group")
    keys = keys.withColumn("q", F.coalesce(*[f"q_{level}" for level in _LEVELS]))
    out = ["band", "label", "script"]
    for m in MEASURES:
        low, high = F.col("q")[m][0], F.col("q")[m][1]
        width = F.greatest(BAND * (high - low), F.lit(LEAST_WIDTH[m]))
        out += [(low - width).alias(f"{m}_low"), (high + width).alias(f"{m}_high")]
    return keys.select(*out)


def apply_bands(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """Add ``kept``: passes the base rules and lies inside its group's bands."""
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    joined = measured.join(bands, ["band", "label", "script"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(*[f"{m}_{e}" for m in MEASURES for e in ("low", "high")])


def quality_verdicts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str | None = "lang") -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, script, measures, band group and ``kept`` of every row.

    A null text has no word and fails the base rules; an empty table gives no row.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    size = F.floor(F.log2(F.greatest("word_chars", F.lit(1)))).cast("string")
    label = F.coalesce("lang", "script")
    measured = common.checkpointed(measure_texts(rows.withColumn("digest", F.xxhash64("text")), path, "text").drop("text")
                                   .withColumns({"label": label, "band": F.concat_ws("/", label, size)}).drop("lang"))
    columns = [c for c in measured.columns if c not in ("digest", "label", "band")]
    return apply_bands(measured, common.checkpointed(fit_bands(measured))).select("band", *columns, "kept")
