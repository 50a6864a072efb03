"""Each operator against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import helpers
from tokenizers import Tokenizer

from riskframe.llm import bpe, hamming, html, language, packing, quality, repeats, simhash, tokencount, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def clash(df):
    """Extra columns with the names of results and of inner columns."""
    return df.withColumns({c: F.lit("x") for c in ("score", "fp", "tag", "key", "n_tokens", "runs", "code", "band", "kept", "rep", "t")})


# language

def test_automaton_parse_equals_longest_matches():
    rnd = random.Random(1)
    sample = "".join(rnd.choice("abc ") for _ in range(300)).encode()
    counter = language.PhraseCounter(sample)
    for n in (1, 5, 200, 512):
        text = "".join(rnd.choice("abc ") for _ in range(n)).encode()
        columns = np.frombuffer(text, np.uint8).astype(np.uint16)[:, None]
        assert counter.count(columns)[0] + 1 == helpers.longest_matches(text, sample)


def test_language_results(spark, odd_docs, no_docs):
    en, de = "the house and the garden with flowers", "das haus und der garten mit blumen"
    rows = [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de") for i in range(200)]
    samples = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x for x, _ in samples] == ["de", "en"]
    found = {r["doc_id"]: r for r in language.identify_languages(clash(odd_docs).withColumn("lang_pred", F.lit("?")), samples).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 11))
    texts = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(texts, samples).collect()} == {1: "en", 2: "de"}
    assert language.fit_languages(no_docs) == ()
    assert {r["lang_pred"] for r in language.identify_languages(odd_docs, ()).collect()} == {"und"}
    assert language.identify_languages(no_docs, samples).count() == 0


# toxicity

def test_maximal_segments_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        scores = [rnd.choice([-3, -1, -0.5, 1, 2, 0.7]) + rnd.random() / 100 for _ in range(rnd.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        want = helpers.top_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity_learns_and_handles_odd_rows(spark, odd_docs, no_docs):
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    rows = []
    for i in range(600):
        toks = [rnd.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            toks[10:14] = ["awful", "nasty", rnd.choice(plain), "awful"]
        rows.append((i, " ".join(toks)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    out = toxicity.score_toxicity(clash(docs), model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in out)
    assert all(r["passages"] and r["passages"][0]["first_token"] >= 10 and r["passages"][0]["end_token"] <= 14 for r in out if r["predicted"])
    odd = toxicity.score_toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    empty = toxicity.fit_toxicity(no_docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd_docs, empty).collect()} == {0}
    assert toxicity.fit_toxicity(docs, labels.where("toxic = 0")) == toxicity.ToxicityModel()


# simhash

def test_simhash_equals_brute_force(odd_docs, odd_rows, no_docs, monkeypatch):
    for shard, leaf in ((20_000, 128), (8, 2)):
        monkeypatch.setattr(simhash, "SHARD", shard)
        monkeypatch.setattr(simhash, "LEAF", leaf)
        out = simhash.near_duplicates(clash(odd_docs), words=4, radius=4).collect()
        assert len(out) == len(odd_rows)
        prints = [(10**9 if i is None else i, helpers.simhash(t, 4)) for i, t, *_ in odd_rows]
        group = helpers.components(prints, 4)
        for r in out:
            i = 10**9 if r["doc_id"] is None else r["doc_id"]
            assert int(r["fingerprint"], 16) == dict(prints)[i]
            assert group[i] == (i if r["component_id"] is None else r["component_id"])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_vantage_point_search_finds_all_links():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in set(rng.integers(0, 63, rng.integers(0, 5)).tolist())) for _ in range(30)], np.uint64) for c in centres]))
    want = simhash.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        want.join(j, np.full(len(j), i))
    parts = [simhash.TreeTop(fps, m, 4, s) for s, m in enumerate(simhash.segment_masks(3))]
    got = simhash.Forest(len(fps))
    for top in parts:
        row, shard, home = top.assign(fps, 4 // 3)
        assert (np.bincount(row[home]) == 1).all()
        for s in range(top.shards):
            at = row[shard == s]
            f = simhash.search_shard(fps[at], home[shard == s], int(top.mask), 4, 4 // 3)
            got.join(at, at[f.roots(np.arange(len(at)))] if len(at) else at)
    every = np.arange(len(fps))
    assert (got.roots(every) == want.roots(every)).all()


# repeated passages

def test_repeats_equal_brute_force(odd_docs, odd_rows, no_docs, spark, monkeypatch):
    for chunk, order in ((1 << 20, 2 << 20), (2000, 2000)):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "ORDER_BYTES", order)
        out = repeats.remove_repeats(clash(odd_docs), with_text=True, carry=["lang"]).collect()
        assert len(out) == len(odd_rows)
        want = helpers.repeats([(-1 if i is None else i, t) for i, t, *_ in odd_rows])
        texts = {-1 if i is None else i: t or "" for i, t, *_ in odd_rows}
        for r in out:
            i = -1 if r["doc_id"] is None else r["doc_id"]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[i, texts[i]]
    assert repeats.remove_repeats(no_docs).count() == 0
    same_id = [(1, "a" * 50 + "q" * 200), (1, "z" * 30 + "q" * 200)]
    out = repeats.remove_repeats(spark.createDataFrame(same_id, "doc_id long, text string"))
    assert sorted(r["n_removed"] for r in out.collect())[1] >= 200


def test_repeated_rows_keep_a_short_phrase_that_others_hold(spark, monkeypatch):
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [noise(n) for n in (24, 40, 60, 99)]
    texts = {i: "".join(f"{noise(150)}{i}{p}{i}" for p in phrases) + noise(150) for i in range(1, 6)}
    rows = [(i, t) for i, t in texts.items() for _ in range(1 + i % 3)]
    for chunk, order in ((1 << 20, 2 << 20), (500, 500)):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        monkeypatch.setattr(repeats, "ORDER_BYTES", order)
        out = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        want = helpers.repeats(rows)
        assert len(out) == len(rows)
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], texts[r["doc_id"]]] for r in out)
        assert {r["n_removed"] for r in out} == {0}


def test_repeated_windows_are_the_equal_groups():
    rnd = random.Random(9)
    data = sorted((bytes(rnd.choice(b"ab") for _ in range(104)) for _ in range(40)))
    data += [data[0], data[3][:102] + b"zz"]
    flags = repeats.repeated_windows(data, np.zeros(len(data), np.int64), 100)
    windows = [d[p:p + 100] for d in data for p in range(5)]
    seen = set()
    assert flags.tolist() == [w in seen or seen.add(w) or False for w in windows]


# quality

def test_quality_counts_and_bands(odd_docs, odd_rows, no_docs):
    out = quality.quality_verdicts(clash(odd_docs), PIECES).collect()
    assert len(out) == len(odd_rows)
    texts = {i: t for i, t, *_ in odd_rows}
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == helpers.base_counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_verdicts(no_docs, PIECES).count() == 0


def test_quality_rejects_outliers(spark):
    rnd = random.Random(5)
    words = ["house", "garden", "window", "summer", "people", "nothing", "between", "morning", "water", "letter"] * 2 + ["the", "and", "of"]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(60))
    rows = [(i, prose(), "en") for i in range(200)] + [(999, " ".join("%x7Q~" + chr(0x2500 + rnd.randint(0, 99)) for _ in range(70)), "en")]
    out = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert not out.pop(999) and sum(out.values()) >= 198


def test_quality_bands_count_copies_once_and_reach_small_groups(spark):
    rnd = random.Random(6)
    words = ["house", "garden", "window", "summer", "people", "nothing", "between", "morning", "water", "letter", "internationally", "a", "of", "qzxv"]
    prose = lambda n=60: " ".join(rnd.choice(words) for _ in range(n))
    noise = lambda: " ".join("%x7Q~" + chr(0x2500 + rnd.randint(0, 99)) for _ in range(70))
    texts = [prose() for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en") for i in range(600)]
    rows += [(5000, noise(), "xx"), (5001, " ".join(noise() for _ in range(40)), "en")]
    out = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert not out[5000] and not out[5001]
    alone = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows[:200], "doc_id long, text string, lang string"), PIECES).collect()}
    assert sum(alone.values()) >= 195 and sum(out[i] for i in range(200)) >= 195


# BPE

def test_bpe_equals_the_library(odd_docs, odd_rows, no_docs):
    lexicon = bpe.fit_lexicon(odd_docs, BPE)
    tok = Tokenizer.from_file(BPE)
    texts = {i: t or "" for i, t, *_ in odd_rows}
    for blob in (lexicon, bpe.fit_lexicon(no_docs, BPE)):
        for r in bpe.encode_digests(clash(odd_docs), blob, BPE).collect():
            ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.encode_texts(odd_docs, lexicon, BPE).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)


def test_bpe_words_of_any_script_and_length():
    tok, own, fast = Tokenizer.from_file(BPE), bpe.ByteBpe(BPE), packing.FastTokenizer(BPE)
    texts = ["", "a" * 500, " " * 70, "日本語" * 50, "😀 x́ ½²Ⅷ", "a\x1cb\x85d\xa0e", "՘a౜b", "𐞻 q", "<|endoftext|>x <|endoftext|>", "don't 'S\n\n\t x  y"]
    texts += [f"a{chr(c)}b 1{chr(c)} {chr(c)}" for c in range(0x80, 0x2FFFF, 401) if not 0xD800 <= c < 0xE000]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert fast.ids(t).tolist() == want
        assert [i for w in own.pre_tokens(t) for i in ([own.special[w]] if w in own.special else own.merge(w.encode()))] == want


def test_transducer_is_minimal_and_maps_every_word():
    words = {w: [k, k + 1] for k, w in enumerate([b"walk", b"walks", b"walked", b"talk", b"talks", b"talked", b"t", "é".encode()])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lex.find([*words, b"tal", b"walkss", b"", b"zz"]) == [*words.values(), None, None, None, None]
    assert len(lex.final) <= 10  # both stems share one tail


def test_lexicon_counts_the_words_of_all_texts(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "COUNT_WORDS", 300, raising=False)
    docs = spark.range(4000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    assert np.frombuffer(bpe.fit_lexicon(docs, path), np.int64)[2] == 4000


# top k

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 64))
    vectors = [base[i % 50] if i % 3 else base[i] for i in range(150)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(None, [1.0]), (900, None), (7, [float(x) for x in vectors[7]]), (901, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit(1))
    out = hamming.search(df, df.where("vec_id % 50 = 0"), k=12).collect()
    codes = {i: sum(1 << b for b, x in enumerate(v[:64]) if x is not None and x > 0) for i, v in rows if i is not None and v is not None}
    queries = [i for i in codes if i % 50 == 0]
    assert {r["query_id"] for r in out} == set(queries)
    for q in queries:
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:12]
        assert [(r["distance"], r["neighbor_id"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert hamming.search(df.limit(0), df.limit(0), k=3).count() == 0


# token counts

def test_token_counts_equal_plain_programming(odd_docs, odd_rows, no_docs):
    model = tokencount.Unigram(PIECES)
    texts = {i: t or "" for i, t, *_ in odd_rows}
    for r in tokencount.count_tokens(clash(odd_docs), PIECES).collect():
        words = texts[r["doc_id"]].encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(model.count_one(tokencount.MARK + w) for w in words))
    totals = tokencount.token_totals(tokencount.count_tokens(odd_docs, PIECES), "lang").collect()
    assert sum(r["n_docs"] for r in totals) == len(odd_rows)
    assert tokencount.count_tokens(no_docs, PIECES).count() == 0


# packing

def test_packing_is_whole_and_gapless(odd_docs, odd_rows, no_docs):
    rows = packing.pack_documents(clash(odd_docs), BPE, capacity=64).collect()
    tok = Tokenizer.from_file(BPE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = {i: t or "" for i, t, *_ in odd_rows}
    for i, pieces in by_doc.items():
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
        pieces = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces})
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == len(ids)
        assert all(p[2] == 64 for p in pieces[1:])
        assert all(zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) == c for _, s, n, c in pieces)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by_sequence) <= 1.05 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.pack_documents(no_docs, BPE).count() == 0


def test_plan_covers_the_histogram_near_the_bound():
    rnd = random.Random(8)
    for hist in ({1024: 3}, {600: 7}, {1: 5}, {rnd.randint(1, 1024): rnd.randint(1, 40) for _ in range(200)}, {512: 9, 513: 4, 100: 50}):
        plan = packing.plan_sequences(hist)
        held = {}
        for config, times in plan:
            assert times > 0 and sum(n * k for n, k in config.items()) <= 1024
            for n, k in config.items():
                held[n] = held.get(n, 0) + k * times
        assert held == hist
    assert packing.plan_sequences({}) == []
    hist = {n: 100 for n in range(10, 500, 7)}
    assert sum(t for _, t in packing.plan_sequences(hist)) <= 1.005 * sum(n * c for n, c in hist.items()) / 1024 + 1


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title %d &amp; more</h1><p>All rights  kept by us today.</p>
<p><b>Body %d one<br><p>Body %d&nbsp;two <i>in</i> italics</p><ul><li>item %d<li>last</ul><aside>side %d</aside><section id="comments"><p>reader</p></section></article>
<form><p>Name</p></form><footer>&copy; us</footer></body>"""


def page(i):
    return PAGE % (i, i, i, i, i)


def test_main_text_through_wrapper(spark):
    rows = [(i, "https://a.example.org/x", page(i)) for i in range(8)]
    rows += [(50, "http://one.example.org/", page(50)), (51, None, "<p>alone<p>two"), (52, "http://a.example.org", None), (53, "nonsense", ""),
             (None, "http://a.example.org/y", page(9)), (54, "https://a.example.org/z", "x" * 5000), (0, "https://a.example.org/x", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y"), "root": F.lit("z")})
    out = html.extract_main_text(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    for i in (*range(8), 50):  # single blocks of the article stay, though all pages of the host share them
        assert got[i].split("\n") == [f"Title {i} & more", "All rights kept by us today.", f"Body {i} one", f"Body {i} two in italics", f"item {i}", "last"]
    assert (got[51], got[52], got[53], got[54]) == ("alone\ntwo", "", "", "x" * 5000)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_tree_matching_aligns_equal_structure():
    a, b = (html.parse(p).measured().nodes[0] for p in ("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>", "<div><p>1</p><table><tr><td>q</td></tr></table><p>3</p></div>"))
    assert sorted((x.tag, x.texts, y.texts) for x, y in html.match_trees(a, b) if x.texts) == [("p", ["1"], ["1"]), ("p", ["2"], ["3"])]


def test_content_root_keeps_the_whole_article(spark):
    say = lambda what, i, n: " ".join(f"{what}{i}{k}" for k in range(n))
    layouts = {"a": "<article><h1>%s</h1><p>%s</p><section><p>%s</p></section></article>",
               "b": "<article><h1>%s</h1><p>%s</p><div><p>%s</p></div></article>",
               "c": "<main><h1>%s</h1><p>%s</p><table><tr><td>%s</td></tr></table></main>",
               "d": "<div><h1>%s</h1><p>%s</p><div><p>%s</p></div></div>"}
    parts = {(h, i): (say("title", i, 3), say("lead", i, 20), say("body", i, 40)) for h in layouts for i in range(6)}
    rows = [(k, f"http://{h}.example.org/{i}", f"<html><body><nav>Home</nav>{layouts[h] % p}</body></html>") for k, ((h, i), p) in enumerate(parts.items())]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, p in enumerate(parts.values()):
        assert out[k].split("\n") == list(p)


def test_wrappers_come_from_distinct_pages_of_any_length(spark):
    long = lambda i: page(i).replace("<ul>", "".join(f"<p>words {i} {k} " + "x" * 900 + "</p>" for k in range(30)) + "<ul>")
    assert len(long(0)) > 20_000
    rows = [(i, "http://copies.example.org/", page(i)) for i in range(8) for _ in range(6)]
    rows += [(100 + i, "http://long.example.org/", long(i)) for i in range(5)]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    assert all(f"Body {r['page_id'] % 100} one" in r["text"] for r in out)


def test_words_of_the_pieces_are_the_words_of_the_text():
    """Texts are cut at blanks for counting; whatever white space, scripts and special tokens, the words are those of the whole text."""
    own, rnd = bpe.ByteBpe(BPE), random.Random(6)
    signs = [" ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "a", "B", "\xe9", "1", "\u0663", "'", "s", "'ve", ".", "\u4e2d", "\U0001f642", "<|endoftext|>", "\U000e0fff", "x" * 70]
    for _ in range(20000):
        text = "".join(rnd.choices(signs, k=rnd.randint(0, 14)))
        first, pieces = own.cut(text)
        assert [*first, *own.words_of(pieces)] == own.pre_tokens(text)
        assert "<|endoftext|>" in text or "\U000e0fff" in text or own.pre_tokens(text) == own.words.findall(text)
        assert [*first, *(w for p in pieces for w in own.words_of([p]))] == own.pre_tokens(text)


def test_words_merged_side_by_side_have_the_ids_of_each_alone():
    own, rnd = bpe.ByteBpe(BPE), random.Random(7)
    words = [bytes(rnd.choices(b"aaaethonrsi .\xe2\x80\x94", k=rnd.randint(0, 70))) for _ in range(6000)] + [b"", b"a", b"th", b"the"] * 40 + [b"a" * n for n in range(70)] * 3
    assert own.merge_many(words) == [own.merge(w) for w in words]
    assert own.merge_many([]) == []


def test_words_that_their_ids_do_not_give_back_are_decoded_from_the_ids():
    enc = bpe.Encoder(BPE, bpe.compile_lexicon({b"the": [1]}).tobytes())
    words = enc.prepare(["a the b", "the", "a b"])
    assert "the" in enc.changed or enc.back["the"] == b"the"
    enc.back["a"] = b"x\xff"
    enc.changed.add("a")
    assert [enc.decoded(w).decode() for w in words] == ["x\ufffd the b", enc.back["the"].decode("utf-8", "replace"), "x\ufffd b"]
    assert enc.decoded(enc.prepare(["c \u4e2d <|endoftext|>"])[0]).decode() == "c \u4e2d <|endoftext|>"
