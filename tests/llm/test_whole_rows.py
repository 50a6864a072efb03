"""Cases in which rows, labels or columns once stood for one another."""

import bisect
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import hamming, language, packing, repeats, toxicity

from . import helpers


def test_texts_with_equal_short_hashes_keep_their_own_verdicts(spark):
    rnd = random.Random(2)
    prose = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = prose(150)
    seen = {}
    for k in itertools.count():
        text = (prose(60) + shared + prose(60)) if k % 2 else prose(360)
        h = xxhash.xxh64_intdigest(text.encode(), 42) % (1 << 21)
        if h in seen and (len(seen[h]) == 360) != (len(text) == 360):
            break
        seen.setdefault(h, text)
    rows = [(None, seen[h]), (None, text), (None, prose(200)), (3, shared + "x"), (3, prose(50) + shared), (3, prose(360))]
    rows = [(i, t) for i, t in rows]
    got = {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = {t: xxhash.xxh64_intdigest(t.encode(), 42) for _, t in rows}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ranked = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], signed(order[r[1]])))
    want = helpers.repeats([(k, t) for k, (_, t) in enumerate(ranked)])
    assert got == set(want.values())


def test_an_id_with_two_vectors_counts_once(spark):
    vector = lambda bits: [1.0 if bits >> i & 1 else -1.0 for i in range(64)]
    rows = [(0, vector(0)), (1, vector(1)), (1, vector(3)), (2, vector(7)), (3, vector(15)), (4, vector(2**20 - 1)), (0, vector(0)), (2, vector(7))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.neighbor_id, r.distance) for r in hamming.search(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 3), (3, 4)]


def test_probes_are_spread_over_tasks(spark):
    plan = hamming.search(spark.range(50).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k).alias("x") for k in range(64)]).alias("embedding")),
                          spark.range(2).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k).alias("x") for k in range(64)]).alias("embedding")), 5)
    assert plan.count() == 10


def test_every_label_is_a_language_and_copies_count_once(spark):
    rnd = random.Random(4)
    names = [f"l{k:02d}" for k in range(70)]
    words = {n: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for n in names}
    say = lambda n, k: " ".join(rnd.choice(words[n]) for _ in range(k))
    rows = [(i, say(n, 40), n) for i, n in enumerate(names * 6)]
    five = [say("l00", 30) for _ in range(5)]
    rows += [(1000 + i, five[i % 5], "five") for i in range(600)]
    samples = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [n for n, _ in samples] == sorted([*names, "five"])
    assert all(dict(samples)["five"].count(language._normal(t)) == 1 for t in five)
    ask = spark.createDataFrame([(k, say(n, 30), n) for k, n in enumerate(names[1:])], "doc_id long, text string, want string")
    assert all(r.lang_pred == r.want for r in language.identify_languages(ask, samples).collect())


def test_samples_come_from_whole_texts(spark):
    start = "aaaa bbbb " * 400
    rows = [(i, start + f"zebra quagga {i} " * 60, "z") for i in range(40)]
    samples = dict(language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert b"quagga" in samples["z"] and len(samples["z"]) <= language.SAMPLE_BYTES


def best_fit_decreasing(histogram, capacity=1024):
    free = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - n)
    return len(free)


def test_plans_are_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for mean, n in ((500, 1500), (250, 900), (700, 1200), (60, 3000)):
        sizes = np.clip(rng.lognormal(np.log(mean), 0.8, n).astype(int), 1, 1024)
        histogram = {int(k): int(c) for k, c in zip(*np.unique(sizes, return_counts=True), strict=True)}
        plan = packing.plan_sequences(histogram)
        held = {}
        for config, times in plan:
            assert times > 0 and sum(k * c for k, c in config.items()) <= 1024
            for k, c in config.items():
                held[k] = held.get(k, 0) + c * times
        assert held == histogram and sum(t for _, t in plan) <= best_fit_decreasing(histogram)
        assert plan == packing.plan_sequences(dict(reversed(histogram.items())))


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns(spark, odd_docs, tmp_path, stage):
    spark.createDataFrame([(5, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["score", "lang_pred", "bits_per_byte", "predicted", "passages", "__row", "component", "fp", "tag", "kept", "n_removed", "doc", "key"]
    docs = odd_docs.withColumns({c: F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names)


def test_a_shared_phrase_makes_no_copies_and_the_fit_repeats(spark):
    import pyarrow as pa
    rnd = random.Random(9)
    names = ["".join(rnd.choice("abcdefghijklm") for _ in range(7)) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(names) for _ in range(n))
    phrase = min((prose(5) for _ in range(4000)), key=lambda g: xxhash.xxh64_intdigest(g))
    texts = [f"{prose(40)} {phrase} {prose(40)}" for _ in range(20)]
    near = [texts[0] + " end", texts[0]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts + near), pa.array([0] * 22, pa.int32())], names=["t", "toxic"])
    keys = [k for b in toxicity._copy_keys([batch]) for k in b.column(2).to_pylist()]
    assert len(set(keys[:20])) == 20 and keys[0] == keys[21]
    rows = [(i, f"{prose(30)} {'vile slur ' * 4 if i % 4 == 0 else ''}{prose(10)}") for i in range(400)]
    rows += [(1000 + i, rows[i % 8][1]) for i in range(200)]
    marks = spark.createDataFrame([(i, int("vile" in t)) for i, t in rows], "doc_id long, toxic int")
    models = [toxicity.fit_toxicity(spark.createDataFrame(rnd.sample(rows, len(rows)), "doc_id long, text string").repartition(n), marks) for n in (1, 5)]
    assert models[0].weights == models[1].weights and "vile" in models[0].weights and models[0].slope == pytest.approx(models[1].slope, rel=1e-6)


def test_cells_of_any_size_give_the_same_neighbours_without_broadcasts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 64)))]
    df = spark.createDataFrame(rows + [(400 + i, rows[0][1]) for i in range(30)], "vec_id long, embedding array<double>")
    ask = lambda: sorted(map(tuple, hamming.search(df, df.where("vec_id % 50 = 0"), 7).collect()))
    whole = ask()
    monkeypatch.setattr(hamming, "BLOCK_CODES", 60)
    monkeypatch.setattr(hamming, "GROUP_QUERIES", 4)
    monkeypatch.setattr(hamming, "STEP", 100)
    assert ask() == whole and len(whole) == 9 * 7
    code = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v in rows + [(400 + i, rows[0][1]) for i in range(30)]}
    for q in range(0, 430, 50):
        assert [(r[2], r[1]) for r in whole if r[0] == q] and sorted((r[2], r[1]) for r in whole if r[0] == q) == sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items() if i != q)[:7]
