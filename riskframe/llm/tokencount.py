"""Token counts under a unigram model by dynamic programming on a trie.

The distinct pre-tokens (white-space words with a word mark) of a chunk of texts are put into a
trie. The best-path forward score of a prefix is computed once for its node, whatever number of
words share it: level by level, every node extends the vocabulary walks that began at its
ancestors by its byte and takes the best piece that ends there. The token count of a word is the
count stored at its terminal node; a text's count is the sum over its words.

The public vocabulary holds ranks, not probabilities: a piece of rank r has the log-probability
that Zipf and Mandelbrot's law gives that rank. Bytes that no piece covers cost one byte token.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

MARK = "▁".encode()
#: Mandelbrot's shift, and how much less likely a byte token is than the rarest piece.
SHIFT = 2.7
BYTE_PENALTY = 10.0
#: Words of more bytes are counted one by one; words that a worker remembers.
TRIE_BYTES = 48
MEMO_WORDS = 400_000


class Unigram:
    """Pieces, their scores and the vocabulary's byte trie (``child[state * 256 + byte]``, 0: none)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ids.sort(key=lambda i: (-sp.get_score(i), i))
        self.score = {sp.id_to_piece(i).encode(): -math.log(rank + SHIFT) for rank, i in enumerate(ids)}
        self.byte_score = min(self.score.values()) - BYTE_PENALTY
        self.longest = max(map(len, self.score))
        nodes: list[dict[int, int]] = [{}, {}]  # state 0 is dead, 1 the root
        value = [-np.inf, -np.inf]
        for piece, score in self.score.items():
            s = 1
            for b in piece:
                if b not in nodes[s]:
                    nodes[s][b] = len(nodes)
                    nodes.append({})
                    value.append(-np.inf)
                s = nodes[s][b]
            value[s] = score
        self.child = np.zeros((len(nodes), 256), np.int32)
        for s, out in enumerate(nodes):
            for b, to in out.items():
                self.child[s, b] = to
        self.child, self.value = self.child.ravel(), np.array(value)

    def count_one(self, word: bytes) -> int:
        """Tokens of one word by plain dynamic programming over its bytes."""
        best, count = [0.0], [0]
        for e in range(1, len(word) + 1):
            top, n = best[e - 1] + self.byte_score, count[e - 1] + 1
            for s in range(e - 1, max(-1, e - 1 - self.longest), -1):
                w = self.score.get(word[s:e])
                if w is not None and best[s] + w > top:
                    top, n = best[s] + w, count[s] + 1
            best.append(top)
            count.append(n)
        return count[-1]

    def count_trie(self, words: list[bytes]) -> np.ndarray:
        """Tokens of distinct, sorted words; each prefix is scored once."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        wide = int(sizes.max())
        grid = np.zeros((n, wide), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        shared = np.zeros(n, np.int64)  # bytes shared with the word before
        shared[1:] = np.minimum(np.where((d := grid[1:] != grid[:-1]).any(1), d.argmax(1), wide), np.minimum(sizes[1:], sizes[:-1]))
        out = np.zeros(n, np.int64)
        node = np.zeros(n, np.int64)  # node of each word's prefix at the level before
        # per node of a level, latest ancestor first: walks begun there, scores and counts there
        walks = np.ones((1, 1), np.int32)
        scores, counts = np.zeros((1, 1)), np.zeros((1, 1), np.int32)
        for depth in range(1, wide + 1):
            new = (sizes >= depth) & (shared < depth)
            first = np.flatnonzero(new)
            parent = node[first]
            byte = grid[first, depth - 1].astype(np.int64)
            walk = self.child[walks[parent].astype(np.int64) * 256 + byte[:, None]]
            above, n_above = scores[parent], counts[parent]
            total = above + self.value[walk]
            best = total.argmax(1)
            at = np.arange(len(first))
            top, n_top = total[at, best], n_above[at, best] + 1
            spare = above[:, 0] + self.byte_score
            use = spare >= top
            top[use], n_top[use] = spare[use], n_above[use, 0] + 1
            keep = min(self.longest, depth + 1)
            walks = np.concatenate([np.ones((len(first), 1), np.int32), walk], 1)[:, :keep]
            scores = np.concatenate([top[:, None], above], 1)[:, :keep]
            counts = np.concatenate([n_top[:, None].astype(np.int32), n_above], 1)[:, :keep]
            node = np.cumsum(new) - 1
            ends = sizes == depth
            out[ends] = counts[node[ends], 0]
        return out


class Counter:
    """Token counts of texts; a worker remembers words it met."""

    def __init__(self, path: str):
        self.model = Unigram(path)
        self.memo: dict[bytes, int] = {}

    def count(self, texts: list) -> tuple[list[int], list[int]]:
        """Words and tokens of every text."""
        words = [[MARK + w for w in b.split()] for b in common.utf8(texts)]
        seen = set().union(*words)
        if len(self.memo) + len(seen) > MEMO_WORDS:
            self.memo.clear()
        new = sorted(w for w in seen if w not in self.memo)
        short = [w for w in new if len(w) <= TRIE_BYTES]
        if short:
            self.memo.update(zip(short, self.model.count_trie(short).tolist(), strict=True))
        self.memo.update((w, self.model.count_one(w)) for w in new if len(w) > TRIE_BYTES)
        return [len(ws) for ws in words], [sum(map(self.memo.__getitem__, ws)) for ws in words]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` of every whole text (null: none). Columns of these names are replaced."""
    def make():
        counter = Counter(path)
        return lambda texts: list(counter.count(texts))

    return common.append_columns(docs, text_col, [("n_words", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64())], make)


def token_totals(counted: DataFrame, *by: str) -> DataFrame:
    """Documents, words and tokens per group; counts are added up before the shuffle."""
    return counted.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
