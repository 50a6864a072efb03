import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and group texts of a text by the libraries themselves and one pass over both lists of ends."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    names = alignment.Tokenizers(A, B)

    def align(text):
        if not text:
            return [], [], []
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a, bytes_b = [names.bytes_a[i] for i in a], [names.bytes_b[i] for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], [], []
        groups, i, j, x, y, held = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                x += len(bytes_a[i])
                held[0].append(a[i])
                i += 1
            else:
                y += len(bytes_b[j])
                held[1].append(b[j])
                j += 1
            if x == y and held[0] and held[1]:
                groups.append(held)
                held = ([], [])
        return a, b, groups

    return align


def digest(groups):
    return hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups).encode()).hexdigest() if groups else ""


def test_diagonals_cut_the_merge_into_equal_pieces_that_stitch():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        a, b = (np.union1d(np.arange(1, n + 1)[rng.random(n) < 0.5], [n]) for _ in range(2))
        want, i, j = [], 0, 0
        while i < len(a):
            want.append((i, j, bool(a[i] == b[j])))
            i, j = i + (a[want[-1][0]] <= b[want[-1][1]]), j + (b[want[-1][1]] <= a[want[-1][0]])
        for size in (1, 2, 3, 7, 100):
            cut_a, cut_b = alignment.diagonal_cuts(a, b, size)
            assert set(np.diff(cut_a + cut_b)[:-1]) <= {size}
            assert list(zip(*[x.tolist() for x in alignment.overlaps(a, b, size)], strict=True)) == want


ODD = ["a", " ", "  ", " a", "a ", "a  b", "a \n b\n\n  c", "\n", "a\n", "<|endoftext|> x<s></s>", "x▁y z", "日本語 テキスト", "é  q \xa0 w", "\x00 \x1c a\x1c b",
       "\t\tq  ", "ñ" * 300, "a'll we've  don't  ", "😀 👩‍👩‍👧 x", "\U0001F8FF q", "z" * 3000 + " " + "9" * 500, "﻿ a", "a\r\n b\x85 c　 d", None, ""]


def test_units_align_like_whole_texts(plain):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(" \n\tab1.'é日s😀　\x1f") for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    figures, links, of = alignment.Aligner(A, B).block(texts)
    for k, text in enumerate(texts):
        a, b, groups = plain(text)
        assert (figures["n_a"][k], figures["n_b"][k], figures["n_groups"][k], figures["groups_sha256"][k]) == (len(a), len(b), len(groups), digest(groups)), text
    assert Counter(of.tolist()) == {k: n for k, n in enumerate(figures["n_links"].tolist()) if n}


def test_documents_equal_brute_force(spark, plain, odd_rows, odd_docs, no_docs):
    rows = [(i, t) for i, t, *_ in odd_rows] + [(100 + k, t) for k, t in enumerate(ODD)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string"))
    docs = docs.withColumns({c: F.lit("x") for c in ("block", "a", "n_a", "entries")})
    aligned = [(i, *plain(t)) for i, t in rows]
    links = [[(a[-1], b[-1]) for a, b in groups] for *_, groups in aligned]
    count = Counter(p for ps in links for p in ps)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    want = [(i, len(a), len(b), len(g), len(ps), sum(count[p] == top[p[1]] for p in ps), sum(count[p] for p in ps), digest(g))
            for (i, a, b, g), ps in zip(aligned, links, strict=True)]
    key = lambda r: tuple(x if x is not None else -1 for x in r)
    assert sorted(map(key, alignment.align_documents(docs, A, B).collect())) == sorted(map(key, want))
    assert alignment.align_documents(no_docs, A, B).count() == 0
