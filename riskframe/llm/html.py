"""Main text of web pages by wrapper induction.

Pages of one host are made from one template. From all of a host's distinct pages the wrapper is
induced: their DOM trees are aligned, a few pages with one another, by simple tree matching. A node whose whole
text is the same at its aligned places is constant, and the topmost constant nodes are template subtrees;
all other text varies and fills slots. The article or main element that holds most of the varying
text is the host's content root, or else the innermost place that holds nearly all of it.

Every page is then read through its host's wrapper: the blocks under the content root, without
template subtrees of several blocks (a box that all pages repeat). A single block is kept there even if
other pages have it too: articles share headings. Beside that, only what HTML itself or a class of
a plain name marks as no article goes. A host with too few pages has no wrapper; there the page's own
tree is used.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm import common

#: Distinct pages that are aligned with one another, least of them for a wrapper, and such pages of a host in one group (about).
SAMPLE_PAGES = 6
MIN_PAGES = 3
GROUP_PAGES = 32
#: Share of the aligned pages that must agree on a text for it to be template.
TEMPLATE_SHARE = 0.6
#: Share of the varying text that the content root holds where no article or main element holds most of it.
ROOT_SHARE = 0.9

# Fixed values of HTML: elements that are no block, have no end, or hold no text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object audio video canvas xmp".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("table ul ol dl div section article main aside nav header footer form blockquote body html td th li".split())
# Elements and roles that mark parts which are not the article (a header only outside of one), and names of classes
# and ids that do so: as the first part of a name or alone, alone only, and alone outside of an article only.
NOT_ARTICLE = frozenset("nav header footer aside form button select menu dialog head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset("advert adverts advertisement advertising sponsored promo cookie cookies newsletter breadcrumb breadcrumbs sidebar comments disqus pagination navbar".split())
WHOLE_NAMES = frozenset("ad ads navigation".split())
OUTER_NAMES = frozenset("banner sponsor consent gdpr notice notices popup modal signup side menu nav footer header masthead topbar share sharing social related recommended widget widgets toolbar login".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[^\s\-_]+[^\s]*")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

_MASK = (1 << 63) - 1


class Node:
    """A block element: its tag, the place it stands at (a hash of the tags above it), its own texts and its children."""

    __slots__ = ("tag", "parent", "place", "depth", "dropped", "in_article", "texts", "children", "shape", "content", "blocks", "size", "varying")

    def __init__(self, tag: str, parent: Node | None, drops: bool):
        self.tag, self.parent = tag, parent
        self.place = 0 if parent is None else (parent.place * 0x9E3779B97F4A7C15 + zlib.crc32(tag.encode()) + 1) & _MASK
        self.depth = 0 if parent is None else parent.depth + 1
        self.dropped = drops or parent is not None and parent.dropped
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        self.texts: list[str] = []
        self.children: list[Node] = []
        self.shape = self.content = self.blocks = self.size = self.varying = 0


class Tree:
    """Nodes in order of their beginnings, and the page's blocks in order as (node, text)."""

    def __init__(self):
        self.nodes = [Node("", None, False)]
        self.blocks: list[tuple[Node, str]] = []

    def measured(self) -> Tree:
        """Set, from the leaves up, each node's shape (hash of its tags), content (hash of shape and texts), and numbers of nodes and blocks."""
        for node in reversed(self.nodes):
            shape, content, blocks, size = zlib.crc32(node.tag.encode()), 0, len(node.texts), 1
            for t in node.texts:
                content = (content * 0x100000001B3 + zlib.crc32(t.encode("utf-8", "surrogatepass")) + 1) & _MASK
            for c in node.children:
                shape = (shape * 0xD6E8FEB86659FD93 + c.shape + 1) & _MASK
                content = (content * 0xC2B2AE3D27D4EB4F + c.content + 1) & _MASK
                blocks, size = blocks + c.blocks, size + c.size
            node.shape, node.content, node.blocks, node.size = shape, (content ^ shape) & _MASK, blocks, size
        return self


def _is_no_article(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOT_ARTICLE and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for word in _NAME.findall(value):
                first = re.split("[-_]", word, maxsplit=1)[0]
                if first in NAMES or word in WHOLE_NAMES or word in OUTER_NAMES and not in_article:
                    return True
    return False


def parse(page: str) -> Tree:
    """The tree of block elements of a page."""
    tree = Tree()
    stack, buffer = [tree.nodes[0]], []
    open_tags: dict[str, int] = {}

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                stack[-1].texts.append(text)
                tree.blocks.append((stack[-1], text))

    def close(to: int) -> None:
        flush()
        for node in stack[to:]:
            open_tags[node.tag] -= 1
        del stack[to:]

    at, low = 0, None
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            buffer.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1]:
                low = page.lower() if low is None else low
                end = low.find("</" + tag, at)
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
                buffer.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                buffer.append(" ")
            continue
        drops = not m[1] and _is_no_article(tag, m[3], stack[-1].in_article)
        if tag in INLINE and not drops and not open_tags.get(tag):
            continue
        if m[1]:
            if not open_tags.get(tag):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in INLINE and not drops:
            continue
        flush()
        if tag not in INLINE:  # a new block ends an open paragraph, items end their like
            ends = CLOSED_BY.get(tag, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends or (tag[0] == "h" and tag[1:].isdigit() and stack[k].tag[0] == "h" and stack[k].tag[1:].isdigit()):
                    close(k)
                elif stack[k].tag in SCOPE:
                    break
        node = Node(tag, stack[-1], drops)
        stack[-1].children.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        tree.nodes.append(node)
    if not _OPEN_TAG.match(page, at):  # all but an unfinished tag
        buffer.append(page[at:])
    flush()
    return tree


#: Children of the second node from which on rows of the dynamic program are computed as arrays, and cells of a grid whose rows are
#: kept as they are (of a larger one, every so many). Neither changes what is found.
ARRAY_CHILDREN = 40
GRID_CELLS = 1_000_000


def _ends(x: Node, y: Node) -> tuple[int, int]:
    """Children of equal shape at the beginning and at the end of both lists: they match as they stand."""
    a, b = x.children, y.children
    n, head, tail = min(len(a), len(b)), 0, 0
    while head < n and a[head].shape == b[head].shape:
        head += 1
    while tail < n - head and a[-1 - tail].shape == b[-1 - tail].shape:
        tail += 1
    return head, tail


class _Matcher:
    """Scores of the nodes of one tree against those of another: one more than the heaviest ordered matching of their children.

    Scores stand by shape, 4 bytes a pair of shapes that have children; a leaf's are known without."""

    def __init__(self, b: Node):
        self.scores: dict[int, array] = {}
        self.number: dict[int, int] = {}
        todo = [b]
        while todo:
            node = todo.pop()
            if node.children:
                self.number.setdefault(node.shape, len(self.number))
                todo += node.children

    def known(self, x: Node, y: Node) -> int:
        """The score of two nodes, -1 if it is not found yet."""
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        if not x.children or not y.children:
            return 1
        row = self.scores.get(x.shape)
        return -1 if row is None else row[self.number[y.shape]]

    def open(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        """Pairs of children of which the scores are not found yet, one of each pair of shapes."""
        unlike: dict[str, dict[int, Node]] = {}
        for d in q:
            if d.children:
                unlike.setdefault(d.tag, {})[d.shape] = d
        for c in {c.shape: c for c in p if c.children and c.tag in unlike}.values():
            for d in unlike[c.tag].values():
                if self.known(c, d) < 0:
                    yield c, d

    def score(self, x: Node, y: Node) -> None:
        """Find the score of two unlike nodes of one tag, and before that those of their children."""
        p, q, head = _middles(x, y)
        todo = [(x, y, p, q, head, self.open(p, q))]
        while todo:
            x, y, p, q, head, below = todo[-1]
            pair = next(below, None)
            if pair is not None:
                c, d = pair
                p, q, head = _middles(c, d)
                todo.append((c, d, p, q, head, self.open(p, q)))
                continue
            todo.pop()
            ends = sum(c.size for c in x.children[:head]) + sum(c.size for c in x.children[head + len(p):])
            if x.shape not in self.scores:
                self.scores[x.shape] = array("i", [-1]) * len(self.number)
            self.scores[x.shape][self.number[y.shape]] = 1 + ends + self.heaviest(p, q)

    def rows(self, q: list[Node]) -> tuple[list | np.ndarray, Callable]:
        """The first row of the grid over ``q`` and what makes the next one for a child of the other node."""
        if len(q) < ARRAY_CHILDREN:
            def after(above, c):
                row = [0]
                for j, d in enumerate(q, 1):
                    row.append(max(above[j], row[-1], above[j - 1] + self.known(c, d)))  # nothing added is never more than the cell above
                return row
            return [0] * (len(q) + 1), after
        tags = {t: k for k, t in enumerate({d.tag for d in q})}
        tag, shape = np.array([tags[d.tag] for d in q]), np.array([d.shape for d in q])
        leaf, number = np.array([not d.children for d in q]), np.array([self.number[d.shape] if d.children else 0 for d in q])
        weights: dict[int, np.ndarray] = {}

        def after(above, c):
            w = weights.get(c.shape)
            if w is None:
                scores = self.scores.get(c.shape)
                inner = 1 if scores is None else np.where(leaf, 1, np.frombuffer(scores, np.int32)[number])
                w = np.where(shape == c.shape, c.size, np.where(tag == tags.get(c.tag, -1), inner, 0)).astype(np.int32)
                if len(weights) * len(q) < GRID_CELLS:
                    weights[c.shape] = w
            row = np.zeros(len(q) + 1, np.int32)
            np.maximum(above[1:], above[:-1] + w, out=row[1:])
            return np.maximum.accumulate(row, out=row)
        return np.zeros(len(q) + 1, np.int32), after

    def heaviest(self, p: list[Node], q: list[Node]) -> int:
        if not p or not q:
            return 0
        row, after = self.rows(q)
        for c in p:
            row = after(row, c)
        return int(row[-1])

    def chosen(self, p: list[Node], q: list[Node]) -> Iterator[tuple[Node, Node]]:
        """The pairs of the heaviest ordered matching, from the last. Of a large grid every so many rows are kept, and those between are made again."""
        if not p or not q:
            return
        row, after = self.rows(q)
        step = len(p) if len(p) * len(q) <= GRID_CELLS else math.isqrt(len(p)) + 1
        kept = [row]
        for k in range(step, len(p), step):
            for c in p[k - step:k]:
                row = after(row, c)
            kept.append(row)
        i, j = len(p), len(q)
        while i and j:
            start = (i - 1) // step * step
            grid = [kept[start // step]]
            for c in p[start:i]:
                grid.append(after(grid[-1], c))
            while i > start and j:
                here, above = grid[i - start], grid[i - start - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield p[i], q[j]


def _middles(x: Node, y: Node) -> tuple[list[Node], list[Node], int]:
    """What is between the children of equal shape at both ends, and where it begins."""
    head, tail = _ends(x, y)
    return x.children[head:len(x.children) - tail], y.children[head:len(y.children) - tail], head


def match_trees(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Aligned nodes of two measured trees by simple tree matching (equal tags, order kept), without recursion.

    The score of two nodes is one more than the best ordered matching of their children, whatever their number. Children of
    equal shape at both ends match at once (no other matching is heavier), so the dynamic program has what is between
    them, and equal shapes are scored once.
    """
    pairs = []
    if a.tag != b.tag:
        return pairs
    matcher = _Matcher(b)
    if matcher.known(a, b) < 0:
        matcher.score(a, b)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo += zip(x.children, y.children, strict=True)
            continue
        p, q, head = _middles(x, y)
        tail = len(x.children) - head - len(p)
        todo += zip(x.children[:head], y.children[:head], strict=True)
        todo += zip(x.children[len(x.children) - tail:], y.children[len(y.children) - tail:], strict=True)
        todo += matcher.chosen(p, q)
    return pairs


def node_key(node: Node) -> int:
    """What a wrapper keeps of a template subtree: its place and its whole content."""
    return (node.place * 0xFF51AFD7ED558CCD + node.content) & _MASK


def held_text(trees: list[Tree], template: set[int]) -> dict[int, tuple[int, int, str, int | None]]:
    """Per place the varying text that lies in it, its depth, its tag and the place above."""
    held: dict[int, tuple[int, int, str, int | None]] = {}
    for tree in trees:
        fixed = template_nodes(tree, template)
        for node in tree.nodes:
            node.varying = 0 if node.dropped or id(node) in fixed else sum(map(len, node.texts))
        for node in reversed(tree.nodes):
            if node.parent is not None:
                node.parent.varying += node.varying
            if node.varying:
                found = held.get(node.place)
                held[node.place] = (node.varying + (found[0] if found else 0), node.depth, node.tag, None if node.parent is None else node.parent.place)
    return held


def root_of(held: dict[int, tuple[int, int, str, int | None]]) -> int:
    """The place of the article (or main) element that most of the varying text lies in; else of the innermost container that holds
    ``ROOT_SHARE`` of it. 0 is the page itself. Places that hold half of the text or less do not matter."""
    if not held:
        return 0
    total = held[0][0]
    innermost = lambda share: max((p for p, e in held.items() if e[0] > share * total), key=lambda p: (held[p][1], held[p][0], -p))
    above, at = [], innermost(0.5)
    while at is not None:
        above.append(at)
        at = held[at][3]
    for tag in ("article", "main"):
        for place in reversed(above):  # all of it, with the lead and the title beside its longest part
            if held[place][2] == tag:
                return place
    place = innermost(ROOT_SHARE)
    while held[place][3] is not None and held[place][2] not in ("body", "html", "div", "section", "td", "table"):
        place = held[place][3]  # a paragraph is a slot, not the place of the article
    return place


def content_root(trees: list[Tree], template: set[int]) -> int:
    """The content root (:func:`root_of`) of pages with these template subtrees."""
    return root_of(held_text(trees, template))


def template_nodes(tree: Tree, template: set[int]) -> set[int]:
    """Nodes of a measured tree that are template subtrees or lie in one."""
    out: set[int] = set()
    for node in tree.nodes:
        if node.parent is not None and (id(node.parent) in out or node.blocks and node_key(node) in template):
            out.add(id(node))
    return out


def constant_nodes(trees: list[Tree]) -> tuple[int, dict[int, int]]:
    """From the alignment of all pairs of pages: the pages that are no mere near copies of the others, and for each constant
    subtree how many of them have it."""
    sizes = [sum(len(t) for n, t in tree.blocks if not n.dropped) for tree in trees]
    votes: dict[int, set[int]] = {}
    aligned: set[int] = set()
    for i, a in enumerate(trees):
        for j in range(i + 1, len(trees)):
            constant = [x for x, y in match_trees(a.nodes[0], trees[j].nodes[0]) if x.blocks and x.content == y.content and x.place == y.place]
            whole = {id(x) for x in constant}
            text = sum(len(t) for x in constant if not x.dropped for t in x.texts)
            if 2 * text > min(sizes[i], sizes[j]) or id(a.nodes[0]) in whole:
                continue  # near copies of one article say nothing about the template
            aligned.update((i, j))
            for x in constant:
                votes.setdefault(node_key(x), set()).update((i, j))
    return len(aligned), {k: len(seen) for k, seen in votes.items()}


def agreed(aligned: int, votes: dict[int, int]) -> set[int]:
    """Subtrees that enough of the aligned pages have."""
    return {k for k, n in votes.items() if n >= max(MIN_PAGES, TEMPLATE_SHARE * aligned)}


def induce(pages: list[str]) -> tuple[int, list[int]] | None:
    """Content root and keys of the template subtrees from pages of one host; None if they are too few."""
    pages = list(dict.fromkeys(pages))  # copies of a page say nothing about the template
    if len(pages) < MIN_PAGES:
        return None
    trees = [parse(p).measured() for p in pages]
    template = agreed(*constant_nodes(trees))
    return content_root(trees, template), sorted(template)


def main_text(page: str | None, root: int | None, template: set[int]) -> str:
    """Blocks of a page under the content root but for template subtrees of several blocks, joined by newlines."""
    if not page:
        return ""
    tree = parse(page).measured()
    boxes: set[int] = set()
    for node in tree.nodes:
        if node.parent is not None and (id(node.parent) in boxes or node.blocks > 1 and node_key(node) in template):
            boxes.add(id(node))
    own = [(n, t) for n, t in tree.blocks if not n.dropped and id(n) not in boxes]

    def under(tops: Callable[[Node], bool]) -> list[str]:
        inside: set[int] = set()
        for node in tree.nodes:
            if tops(node) or node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
        return [t for n, t in own if id(n) in inside]

    found = [] if root is None else under(lambda n: n.place == root)
    if not found:  # no wrapper, or a page that is built another way
        place = content_root([tree], set())
        found = under(lambda n: n.tag == "article") or under(lambda n: n.tag == "main") or under(lambda n: n.place == place)
    return "\n".join(found)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]*)", 1), F.lit("")))


#: Rows of :func:`_align`: what a group of pages says about its host.
ALIGNED, VOTES, PLACE = 0, 1, 2
_EVIDENCE = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("depth", pa.int32()),
                       ("tag", pa.string()), ("above", pa.int64())])


def _align(key, group):
    """Deal a group's distinct pages to alignments of ``SAMPLE_PAGES`` at most and tell: the pages aligned, the pages that have each
    constant subtree, and the varying text at each place (``n``: of alignments that tell; ``m``: of all)."""
    pages = list(dict.fromkeys(group.sort_by("h").column("html").to_pylist()))
    parts = -(-len(pages) // SAMPLE_PAGES)
    aligned, votes, places = 0, {}, {}
    for k in range(parts):
        trees = [parse(p).measured() for p in pages[k::parts]]
        n, seen = constant_nodes(trees)
        aligned += n
        for subtree, count in seen.items():
            votes[subtree] = votes.get(subtree, 0) + count
        for place, (text, *where) in held_text(trees, agreed(n, seen)).items():
            told, whole, _ = places.get(place, (0, 0, None))
            places[place] = (told + text * (n > 0), whole + text, where)
    host = key[0].as_py()
    rows = [(host, ALIGNED, 0, aligned, 0, 0, None, None), *[(host, VOTES, k, n, 0, 0, None, None) for k, n in votes.items()],
            *[(host, PLACE, p, n, m, *where) for p, (n, m, where) in places.items()]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EVIDENCE, strict=True)], schema=_EVIDENCE)


def _once_a_task(batches):
    """Rows whose host, group and hash a task has not passed on yet: a page that has very many copies travels once a task."""
    passed = set()
    for batch in batches:
        keep = []
        for k in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "h")), strict=True):
            keep.append(k not in passed)
            passed.add(k)
        yield batch.filter(pa.array(keep, pa.bool_()))


def fit_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, root, template`` per host with enough pages, from all its distinct pages.

    A host's distinct pages are dealt by hash to groups of about ``GROUP_PAGES``, which are aligned apart, so a host that holds a
    third of all pages is read by all tasks. What the groups tell is added up: a subtree is template if enough of all
    aligned pages have it, and the root follows from the varying text of all pages. Copies count once.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")) \
        .where(F.col("html").isNotNull()).withColumn("h", F.xxhash64("html"))
    hosts = common.written(rows.select("host", "h").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES))
    part = F.pmod(F.col("h"), F.ceil(F.col("pages") / GROUP_PAGES)).alias("part")
    dealt = rows.join(hosts, "host").select("host", "html", "h", part)
    told = dealt.mapInArrow(_once_a_task, dealt.schema).groupBy("host", "part") \
        .applyInArrow(_align, "host string, kind int, key long, n long, m long, depth int, tag string, above long")
    told = common.written(told.groupBy("host", "kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("depth").alias("depth"),
                                                                  F.max("tag").alias("tag"), F.max("above").alias("above")))
    aligned = told.where(F.col("kind") == ALIGNED).select("host", F.col("n").alias("aligned"))
    enough = F.col("n") >= F.greatest(F.lit(MIN_PAGES), F.col("aligned") * TEMPLATE_SHARE)
    templates = told.where(F.col("kind") == VOTES).join(aligned, "host").where(enough) \
        .groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))
    # at most one place of a depth holds more than half of a host's text, so a host keeps few of them
    places = told.where(F.col("kind") == PLACE)
    all_of = places.where(F.col("key") == 0).select("host", F.col("n").alias("told"), F.col("m").alias("whole"))
    held = F.when(F.col("told") > 0, F.col("n")).otherwise(F.col("m"))
    chains = places.join(all_of, "host").where(held > F.when(F.col("told") > 0, F.col("told")).otherwise(F.col("whole")) / 2) \
        .groupBy("host").agg(F.collect_list(F.struct("key", held.alias("held"), "depth", "tag", "above")).alias("chain"))

    def roots(batches):
        for batch in batches:
            found = [root_of({e["key"]: (e["held"], e["depth"], e["tag"], e["above"]) for e in chain or ()}) for chain in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(1)], names=["host", "root", "template"])

    return aligned.join(templates, "host", "left").join(chains, "host", "left") \
        .select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"), "chain") \
        .mapInArrow(roots, "host string, root long, template array<long>")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. A null page gives an empty text.

    Wrappers are written once; Spark broadcasts them where they are small and joins by host
    otherwise.
    """
    wrappers = common.written(fit_wrappers(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host_of(F.col(url_col)).alias("host")).join(wrappers, "host", "left")
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part, htmls in common.chunks(batch, 2):
                texts = [main_text(h, root, set(template or ())) for h, root, template in
                         zip(htmls, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "root", "template").mapInArrow(run, schema)
