"""Operator 13, HTML extraction by wrapper induction.

A page becomes a tree of its block elements (label: tag and classes, digits
folded), in which runs of leaf text blocks and equal neighbouring subtrees
stand once: its shape. The distinct shapes of a host are merged into one
template by simple tree matching (dynamic programming over child sequences that
matches the most nodes of equal labels), in groups of ``GROUP`` shapes and then
of partial templates. Each shape is matched to its host's template, so blocks of
all pages of a host lie in common slots.

Over all pages of a host a line that stands in the same slot of at least ``CONSTANT``
per cent of the pages (of ``EVIDENCE`` or more) is a constant node: template. A slot
outside an article whose text is for the larger part links is a menu. Lines that vary are
content, but for what also varies and never is the article: elements that HTML
or their class names as navigation, header, footer, sidebar, notice, advert, form,
comments or code (``TAGS``, ``WORDS``), and hidden ones. Where a page marks its article
(``article``, else ``main``), only what lies inside counts.

Text: references are decoded, white space inside a block is one space, blocks are
trimmed and joined by one line feed, in page order. A line break (``br``) is white
space. A page whose lines are all template keeps them.

Defined cases: null or empty html, or html without text: an empty text; a null url
is a host of its own; broken markup is mended as browsers do (a block ends an open
paragraph, a missing end tag ends with its parent, stray end tags are ignored);
repeated pages count as pages; nodes deeper than ``DEPTH`` count for their ancestor there;
an empty table gives an empty result; other columns are not read.

Scale: pages are parsed twice, never shuffled whole; facts (host, shape, slot, line)
are counted before the shuffle; a group holds ``GROUP`` shapes of about equal share; wrappers are
joined by host and shape, broadcast only where Spark finds them small.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache
from html.parser import HTMLParser
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, small_batches, table, written

# Elements and words of class, id and role that are never part of an article.
TAGS = frozenset("head script style noscript template svg canvas iframe object embed audio video nav aside footer form button select textarea dialog menu title".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations "
    "footer foot colophon cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond reply replies discussion share sharing social search searchbox toolbar pagination pager skip complementary contentinfo".split()
)
HEADERS = frozenset("header masthead topbar".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption title".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dt dd li td th figcaption address legend summary caption".split())
MUTE = TAGS - BLOCKS
#: Start tags that end an open element, and the elements beyond which they do not look.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
SCOPES = frozenset("html body article aside div section main table td th ul ol dl blockquote form fieldset figure details".split())

GROUP, DEPTH = 64, 64
#: Share of a host's pages, in per cent, and pages that make a line a constant node; share of link text that makes a menu.
CONSTANT, EVIDENCE, LINKS = 90, 20, 50
#: Matched sizes of pairs of subtrees that are remembered; others are worked out again.
KNOWN = 1 << 20
#: Cells of a table that is faster weighed number by number than row by row; the weight is the same.
PLAIN = 256


@lru_cache(maxsize=1 << 12)
def _marks(tag: str, attrs: tuple) -> tuple[str, bool, bool, bool, bool, bool]:
    """Label of an element; whether it is hidden, or named as no content, as a header, as comments, as the main part."""
    given = {k: v or "" for k, v in attrs}
    classes = re.findall(r"[A-Za-z][\w-]*", given.get("class", ""))
    words = {w.lower() for x in [*classes, given.get("id", ""), given.get("role", "")] for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", x)}
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")) is not None
    label = ".".join([tag, *(re.sub(r"\d+", "", c) for c in sorted(c.lower() for c in classes))])
    return label, hidden, bool(words & WORDS), tag == "header" or bool(words & HEADERS), bool(words & COMMENTS), tag == "main" or given.get("role") == "main"


class _Page(HTMLParser):
    """Blocks of a page in order, and the tree of its block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # per node: tag, label, parent, children, barred by what it is, barred by its name, inside an article (2) or a main part (1)
        self.tag, self.label, self.parent, self.children, self.barred, self.named, self.region = ["root"], ["root"], [0], [[]], [False], [False], [0]
        self.open: list[tuple[str, int]] = [("root", 0)]  # open elements, with the node that their text belongs to
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters of it in links
        self.text: list[str] = []
        self.links = 0
        self.linked = self.muted = 0  # open links; open elements within a line whose text is none

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.open[-1][1], text, min(self.links, len(text))))
            self.text, self.links = [], 0

    def close_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.linked -= tag == "a"
            self.muted -= tag in MUTE
        if any(tag in BLOCKS for tag, _ in self.open[at:]):
            self.flush()
        del self.open[at:]

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img"):
                self.text.append(" ")
            return
        if tag not in BLOCKS:
            self.linked += tag == "a"
            self.muted += tag in MUTE
            self.open.append((tag, self.open[-1][1]))
            return
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        ends = ENDS.get(tag, ())
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t in ends or t == "p":
                self.close_to(i)
            elif t in MUTE or t in SCOPES and not (tag in ("tr", "tbody", "tfoot") and t in ("td", "th")):
                break
        self.flush()
        self.open.append((tag, self.node(tag, attrs)))

    def node(self, tag: str, attrs: list) -> int:
        up = self.open[min(len(self.open), DEPTH) - 1][1]
        label, hidden, words, headers, comments, main = _marks(tag, tuple(attrs)) if attrs else (tag, False, False, tag == "header", False, tag == "main")
        inside, is_region = self.region[up], tag in ("article", "main")
        barred = self.barred[up] or tag in TAGS or hidden
        named = tag not in ("html", "body") and (comments if is_region else words or (headers and inside < 2))
        region = 2 if tag == "article" else 1 if main else 0
        at = len(self.tag)
        if region and not barred and not named:
            x = up
            while x:  # an element around an article is no sidebar, whatever its name says
                self.named[x] = False
                x = self.parent[x]
            inside = max(region, inside)
        self.region.append(inside)
        self.named.append(named)
        self.tag.append(tag)
        self.label.append(label)
        self.parent.append(up)
        self.children.append([])
        self.barred.append(barred)
        self.children[up].append(at)
        return at

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        for i in range(len(self.open) - 1, 0, -1):
            t = self.open[i][0]
            if t == tag:
                if tag not in ("html", "body"):  # what follows still belongs to the page
                    self.close_to(i)
                return
            if t in BLOCKS and tag not in BLOCKS and tag not in MUTE:
                return

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        self.text.append(data)
        if self.linked:
            self.links += len(data.strip())

    def finish(self) -> tuple[str, list[tuple[int, bool, str, int]]]:
        """The shape, and blocks that may be content: (node of the shape, inside an article, text, link characters)."""
        self.flush()
        n = len(self.tag)
        for x in range(1, n):
            self.barred[x] = self.barred[x] or self.named[x] or self.barred[self.parent[x]]
        keys, groups = [""] * n, [[] for _ in range(n)]
        for x in range(n - 1, -1, -1):
            parts: list[list[int]] = []
            names: list[str] = []
            for c in [] if self.barred[x] else self.children[x]:
                if names and names[-1] == keys[c]:
                    parts[-1].append(c)
                else:
                    parts.append([c])
                    names.append(keys[c])
            groups[x] = parts
            leaf = self.tag[x] in LEAVES and not parts and not self.barred[x]
            keys[x] = "text" if leaf else self.label[x] + ("!" if self.barred[x] else "") + (f"({' '.join(names)})" if names else "")
        number, stack, count = [0] * n, [[0]], 0
        while stack:
            members = stack.pop()
            for m in members:
                number[m] = count
            count += 1
            stack += [[c for m in members for c in groups[m][k]] for k in range(len(groups[members[0]]) - 1, -1, -1)]
        free = [(x, t, k) for x, t, k in self.blocks if not self.barred[x]]
        best = max((self.region[x] for x, _, _ in free), default=0)
        return keys[0], [(number[x], best > 0, t, k) for x, t, k in free if self.region[x] == best or not best]


def parsed(html: str | None) -> tuple[str, list[tuple[int, bool, str, int]]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.finish()


# --- simple tree matching ---------------------------------------------------------------------


class Tree:
    """A shape as a tree: labels, and children by node, in preorder."""

    def __init__(self, shape: str) -> None:
        self.label: list[str] = []
        self.children: list[list[int]] = []
        open_nodes: list[int] = []
        for name, mark in re.findall(r"([^() ]+)|([()])", shape):
            if mark == "(":
                open_nodes.append(len(self.label) - 1)
            elif mark == ")":
                open_nodes.pop()
            else:
                self.label.append(name)
                self.children.append([])
                if open_nodes:
                    self.children[open_nodes[-1]].append(len(self.label) - 1)


def _aligned(n: int, m: int, weights: Callable[[int], np.ndarray], pairs: bool = True) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of the heaviest matching of n and m items that keeps their order.

    ``weights(i)`` holds what item i weighs with each of the m others, 0 where they do not match.
    Rows of the table are kept at intervals and made again between them, so memory grows with m times the root of n.
    """

    def after(row: np.ndarray, i: int) -> np.ndarray:
        w = weights(i)[: len(row) - 1]
        out = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0)), out=out[1:])
        return out

    step = isqrt(n) + 1
    row = np.zeros(m + 1, np.int32)
    kept = [row]
    for i in range(n):
        row = after(row, i)
        if pairs and (i + 1) % step == 0:
            kept.append(row)
    out, j = [], m
    for k in range(len(kept) - 1, -1, -1) if pairs else ():
        rows = [kept[k][: j + 1]]
        for i in range(k * step, min(k * step + step, n)):
            rows.append(after(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j = int(np.searchsorted(rows[i][: j + 1], rows[i][j])) - 1  # the first place of this weight is where the pair ends
                i -= 1
                out.append((k * step + i, j))
    return int(row[-1]), out[::-1]


def matching(a: Tree, b: Tree) -> dict[int, int]:
    """Nodes of ``a`` with their partners in ``b``: the most nodes that a top-down, order-keeping matching can have."""
    kinds: dict[tuple, int] = {}
    (kind_a, size_a), (kind_b, _) = (_kinds(t, kinds) for t in (a, b))
    one_a, one_b = ({k: x for x, k in enumerate(of)} for of in (kind_a, kind_b))  # a node of each kind

    @lru_cache(maxsize=KNOWN)
    def best(k: int, l: int) -> int:
        """Nodes matched below and with nodes of two kinds."""
        x, y = one_a[k], one_b[l]
        if k == l:
            return size_a[x]
        if a.label[x] != b.label[y]:
            return 0
        p, q = a.children[x], b.children[y]
        if len(p) * len(q) > PLAIN:
            return 1 + below(x, y, False)[0]
        row = [0] * (len(q) + 1)
        for c in p:
            corner = 0
            for j, d in enumerate(q):
                w = best(kind_a[c], kind_b[d]) if a.label[c] == b.label[d] else 0
                corner, row[j + 1] = row[j + 1], max(row[j], row[j + 1], corner + w if w else 0)
        return 1 + row[-1]

    def below(x: int, y: int, pairs: bool) -> tuple[int, list[tuple[int, int]]]:
        p, q = a.children[x], b.children[y]
        if len(p) == len(q) == 1:
            w = best(kind_a[p[0]], kind_b[q[0]])
            return w, [(p[0], q[0])] if w else []
        others, place = np.unique([kind_b[d] for d in q], return_inverse=True)

        @lru_cache(maxsize=64)
        def weights(k: int) -> np.ndarray:
            return np.array([best(k, l) for l in others.tolist()], np.int32)[place]

        total, found = _aligned(len(p), len(q), lambda i: weights(kind_a[p[i]]), pairs)
        return total, [(p[i], q[j]) for i, j in found]

    if not a.label or not b.label or a.label[0] != b.label[0]:
        return {}
    out, stack = {}, [(0, 0)]
    while stack:
        x, y = stack.pop()
        if kind_a[x] == kind_b[y]:  # node by node
            out.update(zip(range(x, x + size_a[x]), range(y, y + size_a[x])))
            continue
        out[x] = y
        if a.children[x] and b.children[y]:
            stack += below(x, y, True)[1]
    return out


def _kinds(t: Tree, known: dict[tuple, int]) -> tuple[list[int], list[int]]:
    """For each node a number, the same for equal subtrees, and the nodes of its subtree."""
    kind, size = [0] * len(t.label), [1] * len(t.label)
    for x in range(len(t.label) - 1, -1, -1):
        kind[x] = known.setdefault((t.label[x], *(kind[c] for c in t.children[x])), len(known))
        size[x] += sum(size[c] for c in t.children[x])
    return kind, size


def merged(a: Tree, b: Tree) -> str:
    """Both trees in one: matched nodes once, the others in their places."""
    partner = matching(b, a)
    back = {y: x for x, y in partner.items()}

    def whole(t: Tree, x: int) -> str:
        return t.label[x] + (f"({' '.join(whole(t, c) for c in t.children[x])})" if t.children[x] else "")

    def both(x: int) -> str:
        rest = iter(b.children[back[x]]) if x in back else iter(())
        parts = []
        for c in a.children[x]:
            if c in back:
                for d in rest:
                    if partner.get(d) == c:
                        break
                    parts.append(whole(b, d))
                parts.append(both(c))
            else:
                parts.append(whole(a, c))
        parts += [whole(b, d) for d in rest]
        return a.label[x] + (f"({' '.join(parts)})" if parts else "")

    return both(0)


# --- jobs ------------------------------------------------------------------------------------------


def _line(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _facts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(host, shape, node, line, pages, chars, links) of a batch of (host, html); node -1: the page itself."""
    found: dict[tuple, list[int]] = {}
    for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        shape, blocks = parsed(html)
        once = {(host, shape, -1, 0): [1, 0, 0]}
        for node, inside, text, links in blocks:
            fact = once.setdefault((host, shape, node, _line(text)), [1, 0, 0])
            fact[1] += len(text)
            fact[2] += 0 if inside else links
        for key, values in once.items():
            held = found.setdefault(key, [0, 0, 0])
            held[:] = [x + y for x, y in zip(held, values)]
    columns = list(zip(*found)) or [[]] * 4
    sums = list(zip(*found.values())) or [[]] * 3
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip([*columns, *sums], kinds)], names=["host", "shape", "node", "line", "pages", "chars", "links"])


def _unite(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One partial template for each list of shapes."""
    out = []
    for shapes in batch.column(1).to_pylist():
        held = shapes[0]
        for s in shapes[1:]:
            held = merged(Tree(held), Tree(s))
        out.append(held)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "shape"])


def _slots(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The template's node (slot) of every node of a shape."""
    out = []
    for shape, template in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        a = Tree(shape)
        found = matching(a, Tree(template))
        out.append([found.get(x, -1) for x in range(len(a.label))])
    return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], names=["host", "shape", "slots"])


def templates(shapes: DataFrame) -> DataFrame:
    """(host, template) from distinct (host, shape): merged by groups until each host has one."""
    held = shapes
    while True:
        share = held.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
        grouped = held.join(share, "host").groupBy("host", F.pmod(F.xxhash64("shape"), F.col("groups")).alias("g")).agg(F.sort_array(F.collect_set("shape")).alias("shapes"))
        held = written(map_batches(grouped.select("host", "shapes"), _unite, "host string, shape string").distinct(), "templates")
        if not held.groupBy("host").count().where("count > 1").limit(1).count():
            return held.withColumnRenamed("shape", "template")


def host_of(url: str) -> F.Column:
    """The host that a page is served from, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, shape, slots, menus, fixed): where each shape's nodes lie in its host's template, and what of it is not content.

    ``menus`` lists nodes whose slot is for the larger part links, ``fixed`` pairs (node, line) of constant lines.
    """
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("html"))
    facts = map_batches(rows, _facts, "host string, shape string, node int, line long, pages long, chars long, links long")
    facts = written(facts.groupBy("host", "shape", "node", "line").agg(*(F.sum(x).alias(x) for x in ("pages", "chars", "links"))), "page-facts")
    shapes = facts.where("node = -1").select("host", "shape", "pages")
    slots = written(map_batches(shapes.join(templates(shapes.select("host", "shape")), "host").select("host", "shape", "template"), _slots, "host string, shape string, slots array<int>"), "page-slots")
    placed = facts.where("node >= 0").join(slots, ["host", "shape"]).withColumn("slot", F.expr("slots[node]"))
    menus = placed.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).where(F.col("links") * 100 > F.col("chars") * LINKS).select("host", "slot", F.lit(True).alias("menu"))
    total = shapes.groupBy("host").agg(F.sum("pages").alias("all_pages"))
    constant = placed.groupBy("host", "slot", "line").agg(F.sum("pages").alias("n")).where(F.col("n") >= EVIDENCE).join(total, "host").where(F.col("n") * 100 >= F.col("all_pages") * CONSTANT).select("host", "slot", "line")
    nodes = slots.select("host", "shape", F.posexplode("slots").alias("node", "slot"))
    menu_nodes = nodes.join(menus, ["host", "slot"]).groupBy("host", "shape").agg(F.collect_list("node").alias("menus"))
    fixed = nodes.join(constant, ["host", "slot"]).groupBy("host", "shape").agg(F.collect_list(F.struct("node", "line")).alias("fixed"))
    none = F.array().cast("array<int>")
    return slots.join(menu_nodes, ["host", "shape"], "left").join(fixed, ["host", "shape"], "left").select("host", "shape", "slots", F.coalesce("menus", none).alias("menus"), F.coalesce("fixed", F.array().cast("array<struct<node:int,line:bigint>>")).alias("fixed"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host, n_blocks): the main text of every page."""
    spark = pages.sparkSession
    small_batches(spark)
    known = written(wrappers(pages, url, html), "wrappers")
    fields = "struct<shape:string,blocks:array<struct<node:int,inside:boolean,text:string,line:bigint>>>"
    block = pa.struct([("node", pa.int32()), ("inside", pa.bool_()), ("text", pa.string()), ("line", pa.int64())])

    def parse(column: pa.Array) -> pa.Array:
        shapes, blocks = [], []
        for x in column.to_pylist():
            shape, found = parsed(x)
            shapes.append(shape)
            blocks.append([{"node": n, "inside": i, "text": t, "line": _line(t)} for n, i, t, _ in found])
        return pa.StructArray.from_arrays([pa.array(shapes, pa.string()), pa.array(blocks, pa.list_(block))], names=["shape", "blocks"])

    parse_udf = F.arrow_udf(lambda c: parse(c), fields).asNondeterministic()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), parse_udf(F.col(html)).alias("p"))
    joined = rows.select("page_id", "url", "host", "p.shape", "p.blocks").join(known, ["host", "shape"], "left")
    vary = F.expr("filter(blocks, b -> not (not b.inside and coalesce(array_contains(menus, b.node), false)) and not coalesce(array_contains(fixed, struct(b.node as node, b.line as line)), false))")
    chosen = joined.withColumn("vary", vary).withColumn("lines", F.expr("transform(case when size(vary) > 0 then vary else blocks end, b -> b.text)"))
    text = F.array_join("lines", "\n")
    return chosen.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "host", F.size("lines").alias("n_blocks"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
