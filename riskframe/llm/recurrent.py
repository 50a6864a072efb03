"""Language-model scoring with a gated recurrent network.

Words are counted over all training documents. The most frequent ones are words of the model; every
other word belongs to a class by its last two bytes, within which it has its share of the class's
counts (one more each, and one for all unseen words). A gated recurrent network predicts the next
word in two factors: a softmax over classes, and within a class of frequent words a softmax over
its words. It starts as the unigram model of the counts and is trained in numpy by truncated
backpropagation: the state is carried from window to window, the gradient is not.

Documents of a task run side by side in lanes, one after another in each lane. A document's state is
carried over all of its windows, so its score is the log-likelihood of the complete text.

Every training document is learnt from. A first pass over a few of them in one task only sets where the
training starts; then every task trains a copy on all training documents of its partition, a bounded
number at a time, and the copies are averaged.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import blocks, common

#: Words of the model, words of a class, classes of rare words by their ending, and the network's width.
MODEL_WORDS = 2_000
CLASS_WORDS = 50
ENDINGS = 31
HIDDEN = 32
#: Blocks' text whose words are counted as one: the more of it, the fewer rows per text.
BLOCKS = 4
#: Longest word of the model in bytes.
WORD_BYTES = 64
#: Documents that set the start of the training (about), and passes over them.
FIT_ROWS = 2_000
FIRST_PASSES = 2
#: Steps of a window, lanes in training and in scoring, and the rates of both trainings.
WINDOW = 24
TRAIN_LANES, SCORE_LANES = 96, 512
#: Tokens that a task holds at a time while it trains (one longer document is held alone).
TRAIN_TOKENS = 1 << 21
RATE, SECOND_RATE = 3e-3, 1e-3
#: Numbers in a row of a model on its way to the average.
CHUNK = 1 << 13
#: Rows that meet the softmax over classes at a time (their logits stay in the processor's cache).
OUTPUT_ROWS = 2048
#: Logits count as this at most (their exponentials still add up).
LARGEST = np.float32(60)

LN10 = float(np.log(10))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words (A-Z only; white space is blank, tab, and line and page ends) as places in a list, words of each text, and the list (distinct)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, pa.scalar("", texts.type))))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    term, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()  # white space at the ends of a text
    if empty >= 0:
        keep = term != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        term = term[keep]
        term = term - (term > empty)
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1:]])
    return term, sizes, distinct.cast(pa.binary())


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 2 by 7 (null ids: false, they are learnt from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Vocabulary:
    """Places of words (0: the end), of endings, and what the counts say of them."""

    place: dict[bytes, int]
    endings: dict[bytes, int]
    counts: np.ndarray  # of the words, then of the rare classes

    @property
    def words(self) -> int:
        return len(self.place) + 1

    @property
    def rare(self) -> int:
        return len(self.counts) - self.words

    def encoder(self) -> Callable[[pa.Array], np.ndarray]:
        """Function from words to their places, the end's place last."""
        named, endings = pa.array(list(self.place), pa.binary()), pa.array(list(self.endings), pa.binary())
        places = np.array([*self.place.values(), 0], np.uint16)
        rare = np.array([*self.endings.values(), len(self.counts) - 1], np.uint16)  # the last: all other endings

        def encode(words: pa.Array) -> np.ndarray:
            at, ending = (pc.fill_null(pc.index_in(w, among), -1).to_numpy() for w, among in ((words, named), (pc.binary_slice(words, -2), endings)))
            return np.append(np.where(at < 0, rare[ending], places[at]), np.uint16(0))

        return encode


class Network:
    """Parameters and steps of the network. Inputs: words, rare classes, start of a document. Outputs: word classes, rare classes.

    The inputs' and the state's parts (slow gate, reset gate, new state) are planes of their own. All numbers lie in one line, ``flat``.
    """

    def __init__(self, vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 7):
        self.k, self.hidden = vocabulary.words, hidden
        self.word_classes = -(-self.k // CLASS_WORDS)
        self.start = self.k + vocabulary.rare
        rnd = np.random.default_rng(seed)
        small = lambda *shape: (rnd.standard_normal(shape) * 0.1).astype(np.float32)
        planes = lambda rows: rows.reshape(len(rows), 3, hidden).swapaxes(0, 1)
        counts = vocabulary.counts.astype(np.float64) + 1
        ends = np.arange(0, self.k, CLASS_WORDS)
        parts = {"x": planes(small(self.start + 1, 3 * hidden)), "u": planes(small(hidden, 3 * hidden)), "b": np.zeros(hidden, np.float32),
                 "wc": small(hidden, self.word_classes + vocabulary.rare),
                 "bc": np.log(np.append(np.add.reduceat(counts[:self.k], ends), counts[self.k:]) / counts.sum()).astype(np.float32),
                 "ww": small(self.k, hidden), "bw": np.log(counts[:self.k] / counts.sum()).astype(np.float32)}
        self.shapes = {n: v.shape for n, v in parts.items()}
        self.flat = np.concatenate([v.ravel() for v in parts.values()])
        for n, v in self.named(self.flat).items():
            setattr(self, n, v)
        self.x[0] += 1  # the state changes slowly at first

    def named(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of the parts of a line of numbers."""
        ends = np.cumsum([np.prod(shape) for shape in self.shapes.values()])
        return {n: part.reshape(shape) for (n, shape), part in zip(self.shapes.items(), np.split(flat, ends[:-1]), strict=True)}

    def vector(self) -> np.ndarray:
        return self.flat.copy()

    def load(self, flat: np.ndarray) -> Network:
        self.flat[:] = flat
        return self

    def class_of(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.k, y // CLASS_WORDS, y - self.k + self.word_classes)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        """One step: the new state, and what the way back needs (slopes as their roots)."""
        first = np.flatnonzero(ids == self.start)
        if len(first):
            h = h.copy()
            h[first] = 0
        g, a = np.matmul(h, self.u), self.x.take(ids, axis=1)
        gate, inner = g[:2], g[2]
        inner += self.b
        gate += a[:2]
        slope = _softsign(gate)
        gate *= 0.5
        gate += 0.5
        new = gate[1] * inner
        new += a[2]
        new_slope = _softsign(new)
        out = h - new
        out *= gate[0]
        out += new
        return out, (ids, h, gate, slope, new, new_slope, inner)

    def output(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the probabilities of ``y`` after states ``h`` (numbers from -1 to 1); with ``grad``, gradients are added to it and those of ``h`` returned."""
        of = self.class_of(y).astype(np.uint16)
        order = np.argsort(of, kind="stable")
        h, y, of = h.take(order, axis=0), y[order], of[order]
        logs, dh = np.empty(len(y)), None if grad is None else np.empty_like(h)
        large = (np.abs(self.wc).sum(axis=0) + self.bc).max() > LARGEST or (np.abs(self.ww).sum(axis=1) + self.bw).max() > LARGEST
        for low in range(0, len(y), OUTPUT_ROWS):
            at = slice(low, low + OUTPUT_ROWS)
            logs[at], d = _softmax(h[at], of[at], self.wc, self.bc, large, grad and (grad["wc"], grad["bc"]))
            if grad is not None:
                dh[at] = d
        cut = np.searchsorted(of, np.arange(self.word_classes + 1))
        for c in np.flatnonzero(np.diff(cut)).tolist():
            at, own = slice(cut[c], cut[c + 1]), slice(c * CLASS_WORDS, min((c + 1) * CLASS_WORDS, self.k))
            more, d = _softmax(h[at], y[at] - own.start, self.ww[own].T, self.bw[own], large, grad and (grad["ww"][own].T, grad["bw"][own]))
            logs[at] += more
            if grad is not None:
                dh[at] += d
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return logs[back], None if grad is None else dh.take(back, axis=0)


def _softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place; the root of its slope."""
    root = np.abs(x)
    root += 1
    np.reciprocal(root, out=root)
    x *= root
    return root


def _softmax(h: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray, large: bool, grad: tuple | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithms of the probabilities of ``y`` after ``h``; with ``grad`` (of ``w`` and ``b``, added to), the gradient of ``h``. ``large``: logits may exceed ``LARGEST``."""
    p, rows = h @ w, np.arange(len(y))
    if large:
        p += b
        np.minimum(p, LARGEST, out=p)
        own, share = p[rows, y], np.ones_like(b)
    else:  # e^(hw + b) as e^hw times e^b, which goes to the smaller side of each product
        own, share = p[rows, y] + b[y], np.exp(b)
    np.exp(p, out=p)
    total = p @ share
    logs = own - np.log(total)
    if grad is None:
        return logs, None
    p[rows, y] -= total / share[y]
    part = 1 / total
    grad[0][:] += ((h * part[:, None]).T @ p) * share
    grad[1][:] += (part @ p) * share
    dh = p @ (w * share).T
    dh *= part[:, None]
    return logs, dh


def _add_rows(total: np.ndarray, ids: np.ndarray, rows: np.ndarray, few: int = 8) -> None:
    """Add each row to the row of ``total`` that its id names (ids repeat): ids of many rows one by one, all others side by side."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    count = np.diff(first, append=len(ids))
    many, one = count > few, np.ones(len(ids), rows.dtype)
    for i, n in zip(first[many].tolist(), count[many].tolist(), strict=True):
        total[ids[i]] += one[:n] @ rows.take(order[i:i + n], axis=0)
    first, count = first[~many], count[~many]
    for k in range(few):
        first, count = first[count > k], count[count > k]
        total[ids[first]] += rows.take(order[first + k], axis=0)


class Lanes:
    """Documents (lists of places, the end last) laid side by side: the longest go first, each to the shortest lane."""

    def __init__(self, docs: list[np.ndarray], start: int, lanes: int, cut: bool = False):
        """``cut``: as one line cut into lanes of one length (training; a document's state ends at a cut)."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        order = np.argsort(-sizes, kind="stable")
        heap = [(0, k) for k in range(min(lanes, len(docs)))]
        held: list[list[int]] = [[] for _ in heap]
        for d in order.tolist():
            n, k = heap[0]
            held[k].append(d)
            heapq.heapreplace(heap, (n + int(sizes[d]), k))
        held.sort(key=lambda ds: -int(sizes[ds].sum()))
        self.y = np.concatenate([docs[d] for ds in held for d in ds]) if docs else np.zeros(0, np.uint16)
        line = np.array([d for ds in held for d in ds], np.int64)
        self.doc = np.repeat(line, sizes[line])
        self.x = np.append(start, self.y[:-1]) if len(self.y) else self.y.copy()
        first = np.cumsum(sizes[line]) - sizes[line]
        self.x[first] = start
        self.sizes = np.array([int(sizes[ds].sum()) for ds in held], np.int64)
        if cut:
            ends = np.linspace(0, len(self.y), len(self.sizes) + 1).astype(np.int64)
            self.sizes = -np.sort(-np.diff(ends))
        self.offset = np.cumsum(self.sizes) - self.sizes

    def windows(self, steps: int = WINDOW):
        """Lists of the positions of all running lanes, step by step (lanes that have ended are the last)."""
        for t in range(0, int(self.sizes.max(initial=0)), steps):
            most = np.searchsorted(-self.sizes, -np.arange(t, t + steps), "left")
            yield [self.offset[:n] + t + k for k, n in enumerate(most) if n]


def score_documents(net: Network, docs: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Log-likelihood (base 10) of each document's places."""
    run = Lanes(docs, net.start, lanes)
    out = np.zeros(len(docs))
    h = np.zeros((len(run.sizes), net.hidden), np.float32)
    for window in run.windows():
        states = []
        for at in window:
            h, _ = net.step(run.x[at], h[:len(at)])
            states.append(h)
        at = np.concatenate(window)
        logs, _ = net.output(np.concatenate(states), run.y[at].astype(np.int64))
        out += np.bincount(run.doc[at], logs, len(docs))
    return out / LN10


def train(net: Network, docs: list[np.ndarray], rate: float, lanes: int = TRAIN_LANES, steps: int = WINDOW) -> int:
    """One pass over the documents by truncated backpropagation; places learnt from."""
    run = Lanes(docs, net.start, lanes, cut=True)
    if not hasattr(net, "moments"):
        net.moments = [np.zeros_like(net.flat) for _ in range(2)]
        net.updates = 0
    n, flat = net.hidden, np.empty_like(net.flat)
    grad, halves = net.named(flat), np.array([0.5, 0.5, 1], np.float32)
    h = np.zeros((len(run.sizes), n), np.float32)
    for window in run.windows(steps):
        states, back = [], []
        for at in window:
            h, kept = net.step(run.x[at], h[:len(at)])
            states.append(h)
            back.append(kept)
        at = np.concatenate(window)
        flat[:] = 0
        _, dhs = net.output(np.concatenate(states), run.y[at].astype(np.int64), grad)
        ends = np.cumsum([len(x) for x in window])
        dh, ways = np.zeros((0, n), np.float32), np.empty((len(at), 4 * n), np.float32)  # new state, both gates, its state part
        turned = net.u.swapaxes(1, 2).reshape(3 * n, n) * np.repeat(halves, n)[:, None]
        for k in range(len(window) - 1, -1, -1):
            i, before, gate, slope, new, new_slope, inner = back[k]
            way = ways[ends[k] - len(i):ends[k]]
            d = dhs[ends[k] - len(i):ends[k]]
            d[:len(dh)] += dh
            slope *= slope  # twice the gates' slopes; the halves follow for the window
            kept = d * gate[0]
            dn = d - kept
            dn *= new_slope
            dn *= new_slope
            d *= before - new
            np.multiply(d, slope[0], out=way[:, n:2 * n])
            inner *= slope[1]
            np.multiply(dn, inner, out=way[:, 2 * n:3 * n])
            np.multiply(dn, gate[1], out=way[:, 3 * n:])
            way[:, :n] = dn
            dh = way[:, n:] @ turned
            dh += kept
            if (i == net.start).any():
                dh *= (i != net.start)[:, None]
        grad["u"][:] = (np.concatenate([x[1] for x in back]).T @ ways[:, n:]).reshape(n, 3, n).swapaxes(0, 1) * halves[:, None, None]
        grad["b"][:] = ways[:, 3 * n:].sum(axis=0)
        inputs = np.zeros((net.start + 1, 4 * n), np.float32)
        _add_rows(inputs, np.concatenate([x[0] for x in back]).astype(np.uint16), ways)
        for plane, part in enumerate((1, 2, 0)):
            np.multiply(inputs[:, part * n:(part + 1) * n], halves[plane], out=grad["x"][plane])
        flat /= len(at)
        size = np.sqrt(flat @ flat)
        if size > 1:
            flat /= size
        net.updates += 1
        m, v = net.moments
        m *= 0.9
        m += 0.1 * flat
        v *= 0.99
        np.multiply(flat, flat, out=flat)
        flat *= 0.01
        v += flat
        fix = np.sqrt(1 - 0.99 ** net.updates) / (1 - 0.9 ** net.updates)
        np.sqrt(v, out=flat)
        flat += 1e-8
        np.divide(m, flat, out=flat)
        flat *= rate * fix
        net.flat -= flat
    return len(run.y)


# counts

WORD_ROWS = "block long, term int, word binary, learnt long, terms binary, doc_id long, held_out boolean, key_a long, key_b long"
#: A document's sums over its words: words, logarithms of their counts, words that are known, rare words' shares of their classes.
SUMS = "doc_id long, held_out boolean, key_a long, key_b long, n_words long, base double, known long, rare double"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``held_out`` and 128 bits of the text, which name the row in joins."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), held_out(F.col(id_col)).alias("held_out"),
                       F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(13), text).alias("key_b"))


def _blocks(batches, text: int):
    """The rows of a task in batches of about ``BLOCKS`` blocks' text, whatever size they come in."""
    held, size = [], 0
    for batch in batches:
        for part, _ in common.chunks(batch, text, BLOCKS * blocks.BLOCK_BYTES):
            more = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + more > BLOCKS * blocks.BLOCK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.concat_batches(held)


def word_rows(docs: DataFrame) -> DataFrame:
    """Rows of two kinds per block: its distinct words (``word`` set) by ``term``, and documents (``terms`` set: their words' places in the block)."""
    names = [f.split(" ")[0] for f in WORD_ROWS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def out(n, **cols):
        return pa.RecordBatch.from_arrays([cols[c].cast(k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        number = blocks.numbers()
        for part in _blocks(batches, 1):
            block, n = next(number), len(part)
            term, sizes, distinct = words(part.column(1))
            ends, line = np.append(0, np.cumsum(sizes)) * 4, term.astype("<i4").tobytes()
            yield out(n, block=pa.array(np.full(n, block)), terms=pa.array([line[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
                      **{c: part.column(i) for i, c in enumerate(["doc_id", None, "held_out", "key_a", "key_b"]) if c})
            m = len(distinct)
            learnt = np.bincount(term, np.repeat(~part.column(2).to_numpy(zero_copy_only=False), sizes), m).astype(np.int64)
            yield out(m, block=pa.array(np.full(m, block)), term=pa.array(np.arange(m, dtype=np.int32)), word=distinct, learnt=pa.array(learnt))

    return docs.mapInArrow(run, WORD_ROWS)


def counted(rows: DataFrame) -> DataFrame:
    """Word rows with ``c`` (the word's count in training documents) and its ending; the word itself is left on its first row."""
    same = Window.partitionBy("word").orderBy("block")
    return rows.where("word is not null").select(
        "block", "term", F.sum("learnt").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("c"),
        F.row_number().over(same).alias("nth"), "word") \
        .select("block", "term", "c", F.substring("word", -2, 2).alias("ending"), (F.length("word") <= WORD_BYTES).alias("short"), F.when(F.col("nth") == 1, F.col("word")).alias("word"))


def word_sums(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """Per document its sums over its words; ``figures``: block, term, and the word's ``logc`` (0: unknown) and ``rare``. Blocks meet their figures."""
    def run(docs: pa.Table, of: pa.Table) -> pa.Table:
        term = of.column("term").to_numpy()
        logc, rare = np.zeros((2, len(term)))
        logc[term], rare[term] = of.column("logc").to_numpy(), of.column("rare").to_numpy()
        sums = []
        for line in docs.column("terms"):
            own = np.frombuffer(line.as_buffer(), "<i4")
            known = logc[own]
            sums.append((len(own), known.sum(), np.count_nonzero(known), rare[own].sum()))
        n, base, known, share = np.array(sums).reshape(-1, 4).T
        return pa.table([*(docs.column(c) for c in ("doc_id", "held_out", "key_a", "key_b")), pa.array(n.astype(np.int64)), pa.array(base), pa.array(known.astype(np.int64)), pa.array(share)],
                        names=[f.split(" ")[0] for f in SUMS.split(", ")])

    found = rows.where("terms is not null").select("block", "terms", "doc_id", "held_out", "key_a", "key_b")
    return found.groupBy("block").cogroup(figures.groupBy("block")).applyInArrow(run, SUMS)


@dataclass
class Statistics:
    """What the counts give the model: totals, the vocabulary, the count that its words exceed, and the mass of each ending."""

    tokens: int
    distinct: int
    documents: int
    vocabulary: Vocabulary
    above: int
    mass: dict[bytes, float]
    other_mass: float


def statistics(rows: DataFrame, counts: DataFrame) -> Statistics:
    """Read the counts of a corpus (at most ``MODEL_WORDS`` words and one row an ending reach the driver)."""
    documents = rows.where("terms is not null and not held_out").count()
    first = counts.where("word is not null and c > 0")
    total = first.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = first.where("short").orderBy(F.desc("c"), "word").limit(MODEL_WORDS).select("word", "c").collect()
    above = top[-1]["c"] if len(top) == MODEL_WORDS else 0
    top = [r for r in top if r["c"] > above]
    rare = {bytes(r["ending"]): (r["n"], r["v"]) for r in first.where(~_frequent(above)).groupBy("ending").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    named = sorted(rare, key=lambda e: (-rare[e][0], e))[:ENDINGS]
    k = len(top) + 1
    other = [rare[e] for e in rare if e not in set(named)]
    counts_ = [documents, *[r["c"] for r in top], *[rare[e][0] for e in named], sum(n for n, _ in other)]
    vocabulary = Vocabulary({bytes(r["word"]): i + 1 for i, r in enumerate(top)}, {e: k + i for i, e in enumerate(named)}, np.array(counts_, np.float64))
    return Statistics(total["n"] + documents, total["v"] + (documents > 0), documents, vocabulary, above,
                      {e: float(sum(rare[e]) + 1) for e in named}, float(sum(n + v for n, v in other) + 1))


def _frequent(above: int) -> Column:
    return F.col("short") & (F.col("c") > above)


# model

def _places(texts: pa.Array, encode) -> list[np.ndarray]:
    """The places of each text's words and of its end; distinct words are looked up once."""
    term, sizes, distinct = words(texts)
    place = np.array(encode(distinct), np.uint16)
    ends = np.cumsum(sizes + 1)
    line = np.full(len(term) + len(sizes), place[-1])
    word = np.ones(len(line), bool)
    word[ends - 1] = False
    line[word] = place[term]
    return np.split(line, ends[:-1])


def _runs(batches, encode):
    """The places of documents, about ``TRAIN_TOKENS`` at a time."""
    held, size = [], 0
    for batch in batches:
        for part, _ in common.chunks(batch, 0):
            held += _places(part.column(0), encode)
            size += sum(map(len, held[len(held) - len(part):]))
            if size >= TRAIN_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _trained(docs: DataFrame, vocabulary: Vocabulary, start: np.ndarray | None, passes: int, rate: float) -> np.ndarray:
    """The average, by places learnt from, of the models that the tasks train from ``start`` on their documents (``text``)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, start))

    def run(batches):
        vocabulary, start = shared.value
        net = Network(vocabulary)
        if start is not None:
            net.load(start)
        weight = 0.0
        for learn in _runs(batches, vocabulary.encoder()):
            lanes = SCORE_LANES if 2 * sum(map(len, learn)) >= TRAIN_TOKENS else TRAIN_LANES  # much text: more of it a step
            weight += sum(train(net, learn, rate, lanes) for _ in range(passes)) / passes
        if weight:
            flat = net.vector()
            parts = [flat[at:at + CHUNK] for at in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([weight] * len(parts), pa.float64()),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "weight", "numbers"])

    def mean(batches):
        total: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for chunk, weight, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                had = total.get(chunk, (0.0, 0.0))
                total[chunk] = had[0] + weight, had[1] + weight * np.frombuffer(numbers, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0.0] * len(total), pa.float64()),
                                          pa.array([(x / w).astype(np.float32).tobytes() for w, x in total.values()], pa.binary())], names=["chunk", "weight", "numbers"])

    schema = "chunk int, weight double, numbers binary"
    found = docs.select("text").mapInArrow(run, schema).repartition("chunk").mapInArrow(mean, schema).orderBy("chunk").collect()
    return np.frombuffer(b"".join(bytes(r["numbers"]) for r in found), np.float32) if found else Network(vocabulary).vector() if start is None else start


def fit(docs: DataFrame, stats: Statistics, rows: int = FIT_ROWS) -> np.ndarray:
    """The network's numbers: started on about ``rows`` training documents in one task, then trained on all of them in every task."""
    learnt = docs.where("not held_out").select("text", F.pmod(F.xxhash64("doc_id", "key_a"), F.lit(1 << 30)).alias("part"))
    start = learnt.where(F.col("part") < int(min(1.0, rows / max(stats.documents, 1)) * (1 << 30)))
    first = _trained(start.coalesce(1), stats.vocabulary, None, FIRST_PASSES, RATE)
    return _trained(learnt, stats.vocabulary, first, 1, SECOND_RATE)


def network_scores(docs: DataFrame, vocabulary: Vocabulary, numbers: np.ndarray) -> DataFrame:
    """``doc_id``, ``key_a``, ``key_b`` and ``network``: the log-likelihood (base 10) of the text's words, rare ones by their class."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, numbers))

    def run(batches):
        vocabulary, numbers = shared.value
        net, encode = Network(vocabulary).load(numbers), vocabulary.encoder()
        for batch in batches:
            scores = score_documents(net, [d for part, _ in common.chunks(batch, 3) for d in _places(part.column(3), encode)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], names=["doc_id", "key_a", "key_b", "network"])

    return docs.select("doc_id", "key_a", "key_b", "text").mapInArrow(run, "doc_id long, key_a long, key_b long, network double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all texts, learning from those that are not held out; one row per input row.

    ``n_tokens`` (words and one end), ``n_known`` (tokens that occur in training documents), ``train_tokens``,
    ``base_score`` (unigrams plus one) and ``score`` (the network), both base 10 logarithms.

    A null or empty text, or one of white space, is the end alone. Rows with a null id are learnt from.
    Repeated rows each count and each keep their row, with one score. Without training documents the
    base score is 0 and the network is its start. Documents of any length are scored whole, with the
    state carried through. An empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col)
    rows = common.written(word_rows(docs))
    counts = common.written(counted(rows))
    stats = statistics(rows, counts)
    network = network_scores(docs, stats.vocabulary, fit(docs, stats)).groupBy("doc_id", "key_a", "key_b").agg(F.min("network").alias("network"))
    masses = spark.createDataFrame([(bytearray(e), m) for e, m in stats.mass.items()], "ending binary, mass double")
    log = F.log10(F.col("c") + 1.0)
    figures = counts.join(F.broadcast(masses), "ending", "left").select(
        "block", "term", log.alias("logc"), F.when(_frequent(stats.above), 0.0).otherwise(log - F.log10(F.coalesce("mass", F.lit(stats.other_mass)))).alias("rare"))
    tokens = F.col("n_words") + 1
    every = float(np.log10(stats.tokens + stats.distinct + 1))
    return word_sums(rows, figures).alias("d").join(
        network.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.key_a") == F.col("s.key_a")) & (F.col("d.key_b") == F.col("s.key_b")), "left") \
        .select("d.doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + int(stats.documents > 0)).alias("n_known"),
                F.lit(stats.tokens).cast("long").alias("train_tokens"),
                (F.col("base") + float(np.log10(stats.documents + 1)) - tokens * F.lit(every)).alias("base_score"),
                (F.col("network") + F.col("rare")).alias("score"))
