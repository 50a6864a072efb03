"""The pipeline's stages against brute force on a small table."""

import random

import corpus_pipeline
from tests.llm import helpers
from tests.llm.conftest import DOCS

from riskframe.llm import simhash


def test_stages_keep_what_brute_force_keeps(spark, odd_docs, odd_rows, tmp_path):
    folder = str(tmp_path)
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (8, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, columns = odd_docs, odd_docs.columns
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        rows = docs.collect()
        counts[name] = len(rows)
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in rows} >= {1, 2, 3, 11}
        if name == "simhash":
            prints = [(10**9 if r["doc_id"] is None else r["doc_id"], helpers.simhash(r["text"], 4)) for r in before]
            group = helpers.components(prints, 4)
            assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in rows) == sorted({i for i in group if group[i] == i})
        if name == "suffix_dedup":
            want = helpers.repeats([(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in before])
            sizes = {i: (n, gone) for (i, _), (n, gone, _, _) in want.items()}
            assert sorted(i for i, (n, gone) in sizes.items() if gone < n) == sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        docs = spark.createDataFrame(rows, odd_docs.schema)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in pieces}) == counts["suffix_dedup"]


def test_empty_table_passes(spark, no_docs, tmp_path):
    folder = str(tmp_path)
    no_docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def _words(seed, n=60):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_rows_that_share_an_id_or_have_none_stay_unless_they_are_copies(spark):
    u, v, x, y, z, w = (_words(s) for s in range(6))
    rows = [(7, u), (7, v), (9, v), (5, x), (None, x), (None, y), (11, y), (None, z), (None, z), (None, w), (12, _words(9)), (12, _words(9))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(kept, key=key) == sorted([(7, u), (7, v), (5, x), (11, y), (None, z), (None, w), (12, _words(9))], key=key)


def _near(text):
    """The text with a word more, at 1 to 4 differing bits."""
    more = (f"{text} {tail}" for tail in _words(0, 1000).split())
    return next(t for t in more if 0 < (helpers.simhash(t, 4) ^ helpers.simhash(text, 4)).bit_count() <= 4)


def test_null_ids_do_not_link_components(spark):
    x, y = _words(1, 200), _words(2, 200)
    rows = [(5, x), (None, _near(x)), (9, y), (None, _near(y)), (None, _words(3)), (None, _words(4)), (20, _words(5)), (20, _words(6)), (30, _words(6))]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, radius=4).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in out), key=str)
    assert got == sorted([(5, 5), (None, 5), (9, 9), (None, 9), (None, None), (None, None), (20, 20), (20, 20), (30, 20)], key=str)
