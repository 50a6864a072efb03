"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

Frequent words are compiled, with the ids that the merges give them, into a minimal acyclic
automaton: words share prefixes and suffixes, and the numbers on the edges of a word's path add up
to the word's place in the table of ids. The automaton is one array that each executor's workers
memory-map. A word that it does not hold is merged exactly. What the lexicon holds changes the
speed only, never a result; its words are the most frequent ones of all texts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from riskframe.llm import common

#: The lexicon's words, and the distinct words and pieces, and their characters, that a task counts before it hands them on.
COUNT_WORDS = 200_000
COUNT_CHARACTERS = 32 << 20
LEXICON_WORDS = 30_000
#: Longest word in bytes that the lexicon holds; words that a worker remembers.
LEXICON_WORD_BYTES = 48
MEMO_WORDS = 500_000

#: Fixed value: how byte-level tokenizers of this family split text before the merges.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, where no Unicode classes are needed.
ASCII_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Blanks before something else than white space, and all others; ``\s`` of ``re`` is all that any of the patterns takes as white space.
BLANK, ODD_BLANK = re.compile(r" (?=\S)"), re.compile(r" (?=\s|\Z)")
#: Words of one length that are merged at once.
MERGE_ROWS = 8_192


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[c] for c in byte_characters()]
        merges = spec["model"]["merges"]
        self.rank_of = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.base = max(vocab.values()) + 1
        self.byte_ids, self.made_ids = np.array(self.byte_id, np.int64), np.array(self.made, np.int64)
        pairs = sorted((a * self.base + b, rank) for (a, b), rank in self.rank_of.items()) or [(-1, 0)]
        self.pair_keys, self.pair_ranks = np.array(pairs, np.int64).T.copy()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.exact = Tokenizer.from_file(path).pre_tokenizer
        self.plain: set[str] = set()  # characters on whose class all Unicode versions agree

    def pre_tokens(self, text: str) -> list[str]:
        """Words before the merges, special tokens as words of their own."""
        if self.split_special and any(s in text for s in self.special):
            return [w for part in self.split_special.split(text) if part
                    for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text)
        if not self._known(text):  # the library's own classes decide
            return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _known(self, text: str) -> bool:
        """Whether the text has no character that is assigned in some Unicode versions only."""
        if text.isascii():
            return True
        rare = set(text) - self.plain
        newer = {c for c in rare if unicodedata.category(c) in ("Cn", "Co")}
        self.plain |= rare - newer
        return not newer

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """The first words of a text and, without the blank, what follows each blank before something else than white space:
        a word begins at each such blank. A text with special tokens or unknown characters is all words."""
        if self.split_special and any(s in text for s in self.special) or not self._known(text):
            return self.pre_tokens(text), []
        parts = BLANK.split(text) if ODD_BLANK.search(text) else text.split(" ")
        return self._words(parts[0]), parts[1:]

    def words_of(self, pieces: list[str]) -> list[str]:
        """The words of such pieces."""
        text = " " + " ".join(pieces)
        return (ASCII_WORDS if text.isascii() else self.words).findall(text) if pieces else []

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank_of, none = self.rank_of, len(self.made)
        ranks = [rank_of.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            ids[i:i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of.get((ids[i], ids[i + 1]), none)
        return ids

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: those of one length are merged side by side, a pair of each a step, so they stay of one length."""
        out: list = [None] * len(words)
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            lengths.setdefault(len(w), []).append(i)
        for n, places in lengths.items():
            if n < 2 or n > 64 or len(places) < 32:
                for i in places:
                    out[i] = self.merge(words[i])
                continue
            for k in range(0, len(places), MERGE_ROWS):
                part = places[k:k + MERGE_ROWS]
                data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(-1, n)
                for i, ids in self._merge_rows(np.array(part), self.byte_ids[data]):
                    out[i] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``len(made)`` for those that no merge makes."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.made))

    def _merge_rows(self, rows: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Each row's number and its ids after all merges."""
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            on = best < len(self.made)
            yield from zip(rows[~on].tolist(), ids[~on].tolist(), strict=True)
            rows, ids, ranks, at, best = rows[on], ids[on], ranks[on], at[on], best[on]
            lane, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
            ids[lane, at] = self.made_ids[best]
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), 1)
            for left in (at - 1, at):  # the pairs beside the new id
                ok = (left >= 0) & (left < ranks.shape[1])
                ranks[lane[ok], left[ok]] = self._ranks(ids[lane[ok], left[ok]], ids[lane[ok], left[ok] + 1])
        yield from zip(rows.tolist(), ids.tolist(), strict=True)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        n, rank_of = len(ids), self.rank_of
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank_of[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank_of]
        heapq.heapify(heap)
        while heap:
            rank, i, p = heapq.heappop(heap)
            j = right[i]
            if ids[i] != p[0] or j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j] = self.made[rank], -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (q := (ids[a], ids[right[a]])) in rank_of:
                    heapq.heappush(heap, (rank_of[q], a, q))
        return [i for i in ids if i >= 0]


@functools.lru_cache(maxsize=1)
def tokenizer(path: str) -> ByteBpe:
    """The file's vocabulary and merges, read once a worker."""
    return ByteBpe(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> np.ndarray:
    """The minimal acyclic transducer of words and ids as one array (see :class:`Lexicon`)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # final, edges (byte, state)
    reach: list[int] = []  # words from a state on

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            reach.append(node[0] + sum(reach[s] for _, s in node[1]))
        return register[key]

    path: list[list] = [[False, []]]
    last = b""
    for word in sorted(words):
        same = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), same, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], close(path.pop())))
    root = close(path[0])
    edges = []
    for s, (final, out) in enumerate(states):
        skip = int(final)
        for b, to in out:
            edges.append((s * 256 + b, to, skip))
            skip += reach[to]
    edges.sort()
    e = np.array(edges, np.int64).reshape(-1, 3)
    ids = [words[w] for w in sorted(words)]
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
    final = np.array([f for f, _ in states], np.int64)
    return np.concatenate([[len(states), len(e), len(ids), len(flat), root], e[:, 0], e[:, 1], e[:, 2], final, ends, flat])


class Lexicon:
    """Looks many words up at once in a compiled transducer."""

    def __init__(self, data: np.ndarray):
        n_states, n_edges, n_words, n_ids, self.root = map(int, data[:5])
        cut = np.cumsum([5, n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids])
        self.keys, self.to, self.skip, self.final, self.ends, self.ids = (data[a:b] for a, b in itertools.pairwise(cut))

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Memory-map the array from a file that all workers of this machine share."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.npy")
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                np.save(f, np.frombuffer(data, np.int64))
            os.replace(f.name, path)
        return cls(np.load(path, mmap_mode="r"))

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, None where the lexicon does not hold it."""
        place = np.full(len(words), -1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        lanes = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_WORD_BYTES))
        if len(lanes) and len(self.keys):
            flat = np.frombuffer(b"".join(words), np.uint8)
            at = (np.cumsum(sizes) - sizes)[lanes]
            state, number = np.full(len(lanes), self.root, np.int64), np.zeros(len(lanes), np.int64)
            left = sizes[lanes]
            while len(lanes):
                key = state * 256 + flat[at]
                edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[edge] == key
                lanes, at, left, number, edge = lanes[ok], at[ok] + 1, left[ok] - 1, number[ok], edge[ok]
                number = number + self.skip[edge]
                state = self.to[edge]
                done = left == 0
                end = done & (self.final[state] == 1)
                place[lanes[end]] = number[end]
                lanes, at, left, number, state = (x[~done] for x in (lanes, at, left, number, state))
        return [None if p < 0 else self.ids[self.ends[p]:self.ends[p + 1]].tolist() for p in place.tolist()]


class Encoder:
    """Texts to ids and back; words go through the lexicon, then the merges, and are remembered."""

    def __init__(self, path: str, lexicon: bytes):
        self.bpe, self.lexicon = tokenizer(path), Lexicon.mapped(lexicon)
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}
        self.changed: set[str] = set()  # words that their ids do not give back as they are

    def prepare(self, texts: list) -> list[list[str]]:
        """Pre-tokens of the texts; all of them are in the memo afterwards."""
        words = [self.bpe.pre_tokens(t) if t else [] for t in texts]
        seen = set().union(*words)
        if len(self.ids) + len(seen) > MEMO_WORDS:
            self.ids.clear()
            self.back.clear()
            self.changed.clear()
        new = [w for w in seen if w not in self.ids]
        raw = [w.encode("utf-8") for w in new]
        found = self.lexicon.find(raw)
        rest = [i for i, ids in enumerate(found) if not ids]
        for i, ids in zip(rest, self.bpe.merge_many([raw[i] for i in rest]), strict=True):
            found[i] = ids
        for word, data, ids in zip(new, raw, found, strict=True):
            if word in self.bpe.special:
                ids = [self.bpe.special[word]]
            self.ids[word] = ",".join(map(str, ids))
            self.back[word] = b"".join(map(self.bpe.bytes_of.__getitem__, ids))
            if self.back[word] != data:
                self.changed.add(word)
        return words

    def decoded(self, words: list[str]) -> bytes:
        """What the ids of prepared words stand for; it is the words' own text where each word's ids give it back."""
        if not self.changed or self.changed.isdisjoint(words):
            return "".join(words).encode("utf-8")
        return b"".join(map(self.back.__getitem__, words)).decode("utf-8", "replace").encode("utf-8")


def fit_lexicon(docs: DataFrame, path: str, text_col: str = "text") -> bytes:
    """Compile the most frequent words of all texts. A task counts pieces of texts that end where words do and takes the words from
    the distinct ones; it hands its counts on whenever it holds ``COUNT_WORDS`` of them or ``COUNT_CHARACTERS``."""
    def count(batches):
        bpe, counts, pieces = tokenizer(path), Counter(), Counter()

        def rows():
            same: dict[int, list[str]] = {}
            for piece, n in pieces.items():
                same.setdefault(n, []).append(piece)
            for n, found in same.items():
                for w in bpe.words_of(found):
                    counts[w] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
            counts.clear()
            pieces.clear()
            return out

        characters = 0
        for batch in batches:
            for _, texts in common.chunks(batch, 0):
                for t in texts:
                    first, rest = bpe.cut(t) if t else ((), ())
                    counts.update(first)
                    pieces.update(rest)
                    characters += max(map(len, rest), default=0)
                if len(counts) + len(pieces) >= COUNT_WORDS or characters >= COUNT_CHARACTERS:
                    yield rows()
                    characters = 0
        yield rows()

    top = docs.select(F.col(text_col)).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")) \
        .where(F.octet_length("w") <= LEXICON_WORD_BYTES).orderBy(F.desc("n"), "w").limit(LEXICON_WORDS).collect()
    bpe = tokenizer(path)
    return compile_lexicon({w: bpe.merge(w) for w in (r["w"].encode() for r in top) if w.decode() not in bpe.special}).tobytes()


def encode_digests(docs: DataFrame, lexicon: bytes, path: str, text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256``.

    A null text counts as empty: no ids. Columns of these names are replaced.
    """
    def make():
        enc = Encoder(path, lexicon)

        def compute(texts):
            n, ids_sha, back_sha = [], [], []
            for words in enc.prepare(texts):
                ids = ",".join(map(enc.ids.__getitem__, words))
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back_sha.append(hashlib.sha256(enc.decoded(words)).hexdigest())
            return [n, ids_sha, back_sha]
        return compute

    return common.append_columns(docs, text_col, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()),
                                                  ("decoded_sha256", T.StringType(), pa.string())], make)


def encode_texts(docs: DataFrame, lexicon: bytes, path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (string) for every text; null counts as empty."""
    def make():
        enc = Encoder(path, lexicon)

        def compute(texts):
            words = enc.prepare(texts)
            ids = [[int(i) for w in ws for i in enc.ids[w].split(",")] for ws in words]
            return [ids, [enc.decoded(ws).decode("utf-8") for ws in words]]
        return compute

    return common.append_columns(docs, text_col, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
                                                  ("decoded", T.StringType(), pa.string())], make)
