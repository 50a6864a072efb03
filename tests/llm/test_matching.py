"""Simple tree matching of wide trees and of trees with very many unlike parts: the heaviest matching, whatever the size."""

import random

import pytest

from riskframe.llm import html
from tests.llm.test_wrappers import BOX, FOOT, MENU, plain_match, say


def parsed(body):
    return html.parse(f"<main>{body}</main>").measured().nodes[0]


def checked(a, b):
    """Aligned nodes, after a look at what any alignment has to keep."""
    pairs = html.match_trees(a, b)
    assert all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
    up, order = {id(x): y for x, y in pairs}, {}
    assert all(x.parent is None or up[id(x.parent)] is y.parent for x, y in pairs)
    for x, y in pairs:
        if x.parent is not None:
            order.setdefault(id(x.parent), []).append((x.parent.children.index(x), y.parent.children.index(y)))
    assert all([j for _, j in sorted(o)] == sorted(j for _, j in o) for o in order.values())
    return pairs


def wide(rnd, n):
    return "".join(rnd.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>x</li></ul>", "<ul><li>x</li><li>y</li><p>z</p></ul>", "<div><p>c</p></div>"]) for _ in range(n))


@pytest.mark.parametrize("n", [30, 60, 140])
def test_many_children_are_matched_as_few_are(n):
    rnd = random.Random(n)
    for _ in range(4):
        a, b = parsed(wide(rnd, n)), parsed(wide(rnd, n + rnd.randint(-9, 9)))
        assert len(checked(a, b)) == plain_match(a, b)


def test_very_many_unlike_parts_are_matched_as_few_are():
    rnd = random.Random(6)
    page = lambda: parsed("".join("<section>" + "".join(rnd.choice(["<p>a</p>", "<h2>b</h2>", "<ul></ul>"]) for _ in range(9)) + "</section>" for _ in range(170)))
    a, b = page(), page()
    x, y = (n.children[0].children for n in (a, b))
    assert len({c.shape for c in x}) * len({c.shape for c in y}) > 20_000
    assert len(checked(a, b)) == plain_match(a, b)


@pytest.mark.parametrize("cells, children", [(0, 1), (300, 1), (300, 10**9), (10**9, 10**9)])
def test_neither_arrays_nor_kept_rows_change_the_pairs(monkeypatch, cells, children):
    rnd = random.Random(9)
    trees = [parsed(wide(rnd, n)) for n in (70, 55, 90)]
    usual = [html.match_trees(a, b) for a, b in zip(trees, trees[1:])]
    monkeypatch.setattr(html, "GRID_CELLS", cells)
    monkeypatch.setattr(html, "ARRAY_CHILDREN", children)
    assert [html.match_trees(a, b) for a, b in zip(trees, trees[1:])] == usual


def test_a_box_between_many_blocks_of_its_tag_is_template():
    def page(i):
        rnd = random.Random(i)
        blocks = lambda n: "".join(f"<p>{say('p', i, 5)} {k} {n}</p>" if rnd.random() < 0.6 else f"<div><h3>{say('h', i, 3)} {k} {n}</h3></div>" for k in range(n))
        return f"<html><body><article>{blocks(60 + i)}{BOX}{blocks(70 - i)}</article><div>{MENU}</div>{FOOT}</body></html>"

    root, template = html.induce([page(i) for i in range(6)])
    text = html.main_text(page(7), root, set(template))
    assert "Join us" not in text and "News" not in text and f"{say('p', 7, 5)} 0" in text
