import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import recurrent

from . import helpers


def tokens(text):
    return re.findall(helpers.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def out_of_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def small():
    """A vocabulary of six words and two endings with a network, and documents of its places."""
    vocabulary = recurrent.Vocabulary({w.encode(): k + 1 for k, w in enumerate("abcde")}, {b"xy": 6}, np.array([9, 8, 7, 6, 5, 4, 3, 2.0]))
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 8, n), 0).astype(np.uint16) for n in (0, 1, 70, 3, 200, 12, 12)]
    return vocabulary, recurrent.Network(vocabulary, hidden=6), docs


def one_by_one(net, doc):
    """Log-likelihood of one document, a step and a token at a time, with all probabilities of each step."""
    h, x, total, sums = np.zeros((1, net.hidden), np.float32), net.start, 0.0, []
    for y in doc.tolist():
        h, _ = net.step(np.array([x]), h)
        every = np.arange(net.start)
        logs = net.output(np.repeat(h, len(every), axis=0), every)[0]
        sums.append(np.exp(logs).sum())
        total, x = total + logs[y], y
    return total / math.log(10), sums


def test_probabilities_add_up_and_state_runs_through_all_windows(small):
    _, net, docs = small
    for lanes in (1, 2, 100):
        got = recurrent.score_documents(net, docs, lanes)
        for doc, score in zip(docs, got, strict=True):
            want, sums = one_by_one(net, doc)
            assert score == pytest.approx(want, rel=1e-4) and np.allclose(sums, 1, atol=1e-4)
    assert recurrent.score_documents(net, []).tolist() == []


def test_gradients_equal_differences():
    vocabulary = recurrent.Vocabulary({w.encode(): k + 1 for k, w in enumerate("abcde")}, {b"xy": 6}, np.array([9, 8, 7, 6, 5, 4, 3, 2.0]))
    net = recurrent.Network(vocabulary, hidden=4)
    docs = [np.array([1, 2, 3, 7, 0], np.uint16), np.array([6, 5, 0], np.uint16)]
    start, places = net.vector().astype(np.float64), sum(map(len, docs))

    def loss(flat):
        return -recurrent.score_documents(net.load(flat), docs, 1).sum() * math.log(10) / places

    net.load(start)
    recurrent.train(net, docs, 0.0, lanes=1, steps=50)
    flat = net.moments[0] * 10  # of one update
    rng = np.random.default_rng(0)
    for way in rng.normal(size=(6, len(start))):
        slope = (loss(start + 1e-2 * way) - loss(start - 1e-2 * way)) / 2e-2
        assert slope == pytest.approx(float(flat @ way), rel=0.08, abs=0.01)


def test_training_learns_an_order(small):
    vocabulary, _, _ = small
    net = recurrent.Network(vocabulary)
    docs = [np.array([1, 2, 3, 4, 5, 6] * 8 + [0], np.uint16) for _ in range(40)]
    before = recurrent.score_documents(net, docs).sum()
    for _ in range(30):
        recurrent.train(net, docs, 1e-2, lanes=8)
    assert recurrent.score_documents(net, docs).sum() > 0.3 * before


def test_counts_and_base_score_equal_brute_force(spark, odd_rows, odd_docs, no_docs):
    learnt = [(i, t) for i, t, *_ in odd_rows if not out_of_training(i)]
    count = Counter(w for _, t in learnt for w in tokens(t))
    n, v = sum(count.values()) + len(learnt), len(count) + 1
    df = odd_docs.withColumns({c: F.lit("x") for c in ("score", "block", "held_out", "key_a", "network")})
    got = recurrent.score(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(key((i, out_of_training(i), len(tokens(t)) + 1, sum(w in count for w in tokens(t)) + 1, n,
                       round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)) + math.log10((len(learnt) + 1) / (n + v + 1)), 6))) for i, t, *_ in odd_rows)
    assert sorted(key((*r[:5], round(r.base_score, 6))) for r in got) == want
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 6}) == 1
    assert recurrent.score(no_docs).count() == 0


def test_held_out_texts_gain_and_unseen_words_have_a_share(spark, odd_docs):
    rows = [(i, " ".join(["one two three four"] * (5 + i % 7)) + f" w{i % 20}xy") for i in range(300)] + [(1_000_000, "nowhere " * 30)]
    got = recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(out) > 20 and all(r.score > r.base_score for r in out)
    assert all(math.isfinite(r.score) for r in got)


def test_no_training_documents(spark):
    rows = [(i, "a b c") for i in range(200) if out_of_training(i)]
    got = recurrent.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0 for r in got)


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recurrent, "_trained", lambda docs, *rest: seen.append(docs.count()) or np.zeros(1, np.float32))
    docs = recurrent.keyed(spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("a "), "id").alias("text")), "doc_id", "text")
    learnt = sum(not out_of_training(i) for i in range(700))
    recurrent.fit(docs, recurrent.Statistics(0, 0, learnt, None, 0, {}, 1.0), rows=20)
    assert seen[0] < 100 and seen[1] == learnt


def test_texts_are_trained_on_a_bounded_number_at_a_time(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(recurrent, "TRAIN_TOKENS", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(["a b c"] * 4)], names=["text"]) for _ in range(5)]
    runs = list(recurrent._runs(batches, lambda ws: [1] * len(ws) + [0]))
    assert sum(map(len, runs)) == 20 and max(map(len, runs)) == 4


def test_words_of_a_column_are_those_of_each_text():
    import pyarrow as pa
    texts = [None, "", " \t", "A b\vÄb a\x1c ", "b\r\nA  a", "x"]
    term, sizes, distinct = recurrent.words(pa.array(texts, pa.string()))
    assert len(set(distinct.to_pylist())) == len(distinct)
    got = [[distinct[t].as_py().decode() for t in own] for own in np.split(term, np.cumsum(sizes)[:-1])]
    assert got == [tokens(t) for t in texts]


def test_blocks_do_not_follow_the_batches(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(recurrent.blocks, "BLOCK_BYTES", 10)  # 40 bytes a block
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t], pa.string())], names=["id", "text"]) for k, t in enumerate(["a" * 8] * 11 + ["b" * 100, None, "c"])]
    got = list(recurrent._blocks(batches, 1))
    assert [len(b) for b in got] == [5, 5, 1, 1, 2] and [i for b in got for i in b.column(0).to_pylist()] == list(range(14))


def test_rows_are_added_to_repeated_places():
    ids, rows = np.repeat([5, 0, 3, 2], [40, 1, 8, 9]).astype(np.uint16), np.random.default_rng(1).normal(size=(58, 4)).astype(np.float32)
    mixed = np.random.default_rng(2).permutation(58)
    got, want = np.zeros((6, 4), np.float32), np.zeros((6, 4))
    recurrent._add_rows(got, ids[mixed], rows)
    np.add.at(want, ids[mixed], rows)
    assert np.allclose(got, want, atol=1e-5)


def test_large_logits_count_as_the_largest(small):
    vocabulary, _, _ = small
    net, h = recurrent.Network(vocabulary, hidden=6), np.full((3, 6), 0.5, np.float32)
    net.wc[:, 1] = 100
    every = np.arange(net.start)
    assert np.exp(net.output(np.repeat(h[:1], len(every), axis=0), every)[0]).sum() == pytest.approx(1, abs=1e-4)
    assert net.output(h[:1], np.array([1]))[0][0] == pytest.approx(-60, abs=8)
