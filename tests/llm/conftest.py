import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls in any column, empty and long texts, ties, repeated rows and near copies."""
    rnd = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Eta", "theta", "ñandú", "日本語", "x", "trash"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = prose(120)
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (None, "no id " + base, "en", "a"),
            (5, base, "en", "a"), (6, base, "de", "a"), (6, base, "de", "a"), (7, base.replace("gamma", "gamma", 1) + " tail", None, "b"),
            (8, prose(4000), "en", "a"), (9, "y" * 700, "fr", "a"), (10, "Shti " * 150, "en", "a"), (11, "12 34 !!", "en", "a"),
            (12, "a\x00b <|endoftext|> c", "en", "a")]
    rows += [(20 + i, base[:rnd.randint(80, 300)] + prose(rnd.randint(0, 60)), rnd.choice(["en", "de"]), "a") for i in range(60)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(odd_rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
