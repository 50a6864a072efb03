"""Wrapper induction on hosts whose pages carry no telling tag or class, on articles that share text, and on deep and long pages."""

import itertools
import random
import time

from riskframe.llm import html


def say(what, i, n):
    return " ".join(f"{what}{i}x{k}" for k in range(n))


MENU = "<div><ul><li><a href=/>Start</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul></div>"
FOOT = "<div><p>Our house, Main Street 1</p><p>All rights are ours</p></div>"
BOX = "<div><p>Join us</p><p>Write to us every day</p></div>"


def plain_page(i):
    return (f"<html><body><div>{MENU}<div><h2>{say('title', i, 4)}</h2><h3>Summary</h3><p>{say('lead', i, 30)}</p>{BOX}<p>{say('body', i, 60)}</p>"
            f"<h3>References</h3><ul><li>{say('ref', i, 5)}</li><li>last</li></ul></div>{FOOT}</div></body></html>")


def wanted(i):
    return [say("title", i, 4), "Summary", say("lead", i, 30), say("body", i, 60), "References", say("ref", i, 5), "last"]


def extracted(spark, pages):
    rows = [(k, f"http://h{h}.example.org/{k}", p) for k, (h, p) in enumerate(pages)]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text.split("\n") for r in sorted(out, key=lambda r: r.page_id)]


def test_unmarked_menus_boxes_and_footers_go_and_shared_headings_stay(spark):
    got = extracted(spark, [(0, plain_page(i)) for i in range(9)])
    assert got == [wanted(i) for i in range(9)]
    root, template = html.induce([plain_page(i) for i in range(6)])
    with_wrapper, without = html.main_text(plain_page(50), root, set(template)), html.main_text(plain_page(50), None, set())
    assert with_wrapper.split("\n") == wanted(50) and "Join us" in without and len(template) >= 3


def test_articles_keep_their_own_header_classes_and_tails(spark):
    page = lambda i: (f"<html><body><header><p>Site</p></header><article class='related-work'><header><h1>{say('t', i, 3)}</h1></header><div class='section-header'><p>Part {i}</p></div>"  # noqa: E731
                      f"<p>{say('b', i, 20)}</p><div class='notice-board'><p>n{i}</p></div><div class='cookie-notice'><p>We bake</p></div></article><div class=share><p>Share</p></div></body></html>")
    assert extracted(spark, [(1, page(i)) for i in range(5)]) == [[say("t", i, 3), f"Part {i}", say("b", i, 20), f"n{i}"] for i in range(5)]
    assert [html.main_text(f"<p>one</p>{tail}", None, set()) for tail in ("<3 you all", "< 5 left", "<b unfinished", "</p", "<!-- open")] == \
        ["one\n<3 you all", "one\n< 5 left", "one", "one", "one"]


def plain_match(x, y):
    """Simple tree matching by its definition."""
    if x.tag != y.tag:
        return 0
    best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, c in enumerate(x.children, 1):
        for j, d in enumerate(y.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_match(c, d))
    return best[-1][-1] + 1


def test_alignment_scores_like_simple_tree_matching():
    rnd = random.Random(8)

    def tree(depth):
        tag = rnd.choice(["div", "section", "ul"])
        return f"<{tag}>" + "".join(tree(depth - 1) if depth and rnd.random() < 0.6 else f"<h{rnd.randint(1, 3)}>t</h{rnd.randint(1, 3)}>" for _ in range(rnd.randint(0, 4))) + f"</{tag}>"

    close = 0
    for _ in range(150):
        a, b = (html.parse(f"<main>{tree(3)}{tree(2)}</main>").measured().nodes[0] for _ in range(2))
        pairs, best = html.match_trees(a, b), plain_match(a, b)
        assert all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        up = {id(x): y for x, y in pairs}
        assert all(x.parent is None or up[id(x.parent)] is y.parent for x, y in pairs)
        assert len(pairs) <= best
        close += len(pairs) == best
    assert close >= 140


def test_deep_and_long_pages():
    deep = lambda i: "<html><body>" + "<div>" * 3000 + f"<p>{say('d', i, 30)}</p>" + "</div>" * 3000 + f"<i>x{i}</i></body></html>"
    flat = lambda i: "<html><body>" + MENU + "".join(f"<p>{say('f', i, 3)} {k}</p>" + "<ul><li>x</li></ul>" * ((k * 7 + i) % 3 == 0) for k in range(3000)) + FOOT + "</body></html>"
    start = time.process_time()
    for page in (deep, flat):
        root, template = html.induce([page(i) for i in range(5)])
        text = html.main_text(page(9), root, set(template))
        assert say("d", 9, 30) in text or f"{say('f', 9, 3)} 2999" in text
        assert "All rights" not in text and "News" not in text
    assert time.process_time() - start < 60


def test_nested_lists_of_unlike_shapes_stay_affordable():
    rnd = random.Random(5)
    page = lambda: "<html><body>" + "".join("<div>" + "".join("<section>" + "<p>a</p>" * rnd.randint(1, 9) + "<h2>b</h2>" * rnd.randint(0, 3) + "</section>" for _ in range(rnd.randint(20, 40))) + "</div>"
                                            for _ in range(40)) + "</body></html>"
    start = time.process_time()
    for a, b in itertools.pairwise([html.parse(page()).measured().nodes[0] for _ in range(3)]):
        assert len(html.match_trees(a, b)) > 1000
    assert time.process_time() - start < 60


def test_pages_alone_on_their_host_and_odd_pages(spark):
    pages = [(k, p) for k, p in enumerate([plain_page(1), None, "", "no tags at all", "<p>", "<article></article>", "<article><p>a</p></article><p>b</p><article><p>c</p></article>", "<li>x<li>y", "&lt;p&gt; &#x41;"])]
    assert extracted(spark, pages)[1:] == [[""], [""], ["no tags at all"], [""], [""], ["a", "c"], ["x", "y"], ["<p> A"]]


def test_every_distinct_page_counts_for_its_host(spark, monkeypatch):
    """Pages are aligned in several groups and what they tell is added up: a box on most of all pages is found whatever pages
    a small draw would take, copies change nothing, and each page is parsed for the wrapper."""
    boxed = lambda i: plain_page(i) if i % 3 else plain_page(i).replace(BOX, "")
    for group, n in ((32, 90), (7, 40)):
        monkeypatch.setattr(html, "GROUP_PAGES", group)
        pages = [boxed(i) for i in range(n)]
        rows = [(f"http://h.example.org/{k}", p) for k, p in enumerate([*pages, *pages[:2] * 30])]
        told = html.fit_wrappers(spark.createDataFrame(rows, "url string, html string").repartition(3)).collect()
        assert [r.host for r in told] == ["h.example.org"]
        template = set(told[0].template)
        assert html.main_text(plain_page(999), told[0].root, template).split("\n") == wanted(999)
    key, group = [html.pa.scalar("h")], html.pa.table({"h": list(range(40)), "html": [boxed(i) for i in range(40)]})
    told = html._align(key, group).to_pylist()
    assert [r["n"] for r in told if r["kind"] == html.ALIGNED] == [40]
    # a menu that all pages have is counted on each of them, the box on those that have it
    assert {40, sum(i % 3 != 0 for i in range(40))} <= {r["n"] for r in told if r["kind"] == html.VOTES}


def test_a_host_of_near_copies_keeps_the_wrapper_of_its_other_pages(spark):
    near = [plain_page(1).replace(say("ref", 1, 5), say("ref", k, 5)) for k in range(60)]
    pages = [(0, p) for p in [*near, *[plain_page(i) for i in range(2, 40)]]]
    got = extracted(spark, pages)
    assert got[60:] == [wanted(i) for i in range(2, 40)]
    assert all("Join us" not in t and "News" not in t and t[0] == say("title", 1, 4) for t in got[:60])
