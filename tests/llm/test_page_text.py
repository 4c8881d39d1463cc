"""HTML extraction against pages whose main text is known."""

import itertools
import random

import pytest

from cellweave.llm import page_text

SENTENCES = [f"Sentence number {a} of {b}." for a in "one two three four five six seven eight".split() for b in "red green blue grey".split()]


def texts(rows, spark):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long, host string, lines string")
    return {r["page_id"]: r["text"] for r in page_text.extract(df).collect()}


def soup(rng, i):
    """A page without names or article: header, menu, sometimes a banner, body, footer."""
    body = [f"Page {i}.", *rng.sample(SENTENCES, rng.randrange(2, 6))]
    links = "".join(f'<li><a href="/{i}/{k}">{rng.choice(SENTENCES)}</a></li>' for k in range(4))
    banner = "<div><span>Special offer this week</span></div>" if i % 3 == 0 else ""
    html = f"<html><body><div><b>Our Site</b></div><div><ul>{links}</ul></div>{banner}<div>{''.join(f'<p>{x}' for x in body)}<p>Read our terms.</div><div><p>All rights reserved</p><p>Contact us</p></div></body></html>"
    return html, "\n".join(body)


def test_constant_nodes_become_template(spark):
    rng = random.Random(1)
    pages = [soup(rng, i) for i in range(90)]
    rows = [(i, f"http://Soup.example.com:80/{i}?x=1", html, i, "h", None) for i, (html, _) in enumerate(pages)]
    got = texts(rows, spark)
    for i, (_, want) in enumerate(pages):
        # the banner stands on a third of the pages only, so nothing says that it is template
        assert got[i] == (want if i % 3 else f"Special offer this week\n{want}")


def test_varying_parts_that_are_named_are_no_content(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        body = rng.sample(SENTENCES, 3)
        x = [rng.choice(SENTENCES) for _ in range(8)]
        rows.append((i, f"https://a.example.org/{i}", f'<title>{x[0]}</title><nav>{x[1]}</nav><div class="cookie-notice">{x[2]}</div><div class="has-sidebar"><article><header><h1>{x[3]}</h1></header><p>{body[0]}<br>{body[1]}</p><div class="adsBox">{x[4]}</div><p>&lt;{body[2]}&gt;&nbsp;&copy;</p><section id="comments"><article class="comment">{x[5]}</article></section></article><aside>{x[6]}</aside></div><footer>{x[7]}</footer><form>Name <input></form><script>var a="</p>";</script>', i, "", ""))
        want[i] = f"{x[3]}\n{body[0]} {body[1]}\n<{body[2]}> ©"
    assert texts(rows, spark) == want


def test_copies_and_small_hosts_keep_their_text(spark):
    html = "<body><div><p>Same text.</p><p>Twice.</p></div></body>"
    rows = [(i, "http://copies.example.com/", html, 0, "", "") for i in range(40)] + [(100, None, html, 0, "", ""), (101, "no host", "", 0, "", ""), (102, None, None, 0, "", ""), (103, "http://x/", "<p>", 0, "", ""), (104, "http://x/", "<div" + " a" * 50, 0, "", "")]
    got = texts(rows, spark)
    assert {got[i] for i in range(40)} == {"Same text.\nTwice."} == {got[100]}
    assert got[101] == got[102] == got[103] == ""
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_and_deep_markup():
    lines = lambda h: [x[2] for x in page_text.parsed(h)[1]]
    assert lines("<p>un<b>closed <i>x</p><p>next</b></p> & &lt;b&gt; &#233; &nbsp; <br>a<br/>b <!-- c --> z") == ["unclosed x", "next", "& <b> é a b z"]
    assert lines("<p>a<button>no</button>b<style>x</style>c<noscript><p>no</p></noscript>d") == ["abc", "d"]
    assert lines("<table><tr><td>1<td>2<tr><td>3</table>text<p>par<div>d</div>tail <a href=x>l</a>") == ["1", "2", "3", "text", "par", "d", "tail l"]
    deep = "<div>" * 5000 + "core" + "</div>" * 5000 + "<p>end"
    assert lines(deep) == ["core", "end"]
    long = "<p>" + "word " * 200_000 + "</p>" + "<p>x</p><h2>y</h2>" * 3000
    shape, found = page_text.parsed(long)
    assert shape == "root(text)" and len(found) == 6001 and len(found[0][2]) == 999_999


def every(a, b, x=0, y=0):
    """Size of the largest matching, tried exhaustively."""
    if a.label[x] != b.label[y]:
        return 0
    p, q, most = a.children[x], b.children[y], 0
    for k in range(min(len(p), len(q)) + 1):
        for c, d in itertools.product(itertools.combinations(p, k), itertools.combinations(q, k)):
            each = [every(a, b, i, j) for i, j in zip(c, d)]
            most = max(most, sum(each) if all(each) else 0)
    return 1 + most


def test_tree_matching_is_largest_and_merging_keeps_both():
    rng = random.Random(4)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(0, 4))] if depth else []
        return rng.choice("abc") + (f"({' '.join(kids)})" if kids else "")

    for _ in range(150):
        a, b = (page_text.Tree(f"r({tree(2)} {tree(2)})") for _ in range(2))
        found = page_text.matching(a, b)
        assert len(found) == every(a, b)
        assert all(a.label[x] == b.label[y] for x, y in found.items()) and len(set(found.values())) == len(found)
        union = page_text.Tree(page_text.merged(a, b))
        assert len(union.label) == len(a.label) + len(b.label) - len(found)
        assert len(page_text.matching(a, union)) == len(a.label) and len(page_text.matching(b, union)) == len(b.label)


@pytest.mark.parametrize("group", [2, 64])
def test_templates_take_in_every_shape(spark, monkeypatch, group):
    monkeypatch.setattr(page_text, "GROUP", group)
    shapes = [f"root(body({' '.join(rng_kids)}))" for n in (1, 2, 3) for rng_kids in itertools.permutations(["div.a", "div.b(text)", "text", "ul(text)"], n)]
    df = spark.createDataFrame([(h, s) for h in ("x", "y") for s in shapes[: 40 if h == "x" else 3]], "host string, shape string")
    found = {r["host"]: r["template"] for r in page_text.templates(df).collect()}
    assert set(found) == {"x", "y"}
    for s in shapes[:40]:
        a = page_text.Tree(s)
        assert len(page_text.matching(a, page_text.Tree(found["x"]))) == len(a.label)


def plain(a, b):
    """The largest matching by the whole table, however many children there are: nodes of a with their partners in b."""

    def best(x, y):
        if a.label[x] != b.label[y]:
            return 0, []
        p, q = a.children[x], b.children[y]
        score = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, c in enumerate(p, 1):
            for j, d in enumerate(q, 1):
                w = best(c, d)[0]
                score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + w if w else 0)
        i, j, pairs = len(p), len(q), [(x, y)]
        while i and j:
            if score[i][j] == score[i - 1][j]:
                i -= 1
            elif score[i][j] == score[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs += best(p[i], q[j])[1]
        return 1 + score[-1][-1], pairs

    return dict(best(0, 0)[1])


def test_wide_shapes_are_matched_as_small_ones():
    rng = random.Random(5)
    for n, m in ((3, 4), (40, 60), (520, 530)):  # the last product of lengths is over 2 ** 18
        one, two = (page_text.Tree(f"r({' '.join(rng.choice(['text', 'b', 'c(text)', 'c(b text)', 'c(text b)', *'defgh'[:k]]) for _ in range(x))})") for x, k in ((n, 3), (m, 5)))
        found = page_text.matching(one, two)
        assert found == plain(one, two)
    # a first child that stands late on the other side only must not use up that side
    wide = " ".join(["b c"] * 300)
    one, two = page_text.Tree(f"r(z {wide})"), page_text.Tree(f"r({wide} z)")
    assert len(page_text.matching(one, two)) == 601
    assert len(page_text.Tree(page_text.merged(one, two)).label) == 603


@pytest.mark.parametrize("cells", [0, 9, 1 << 40])
def test_matching_is_the_same_however_tables_are_weighed(monkeypatch, cells):
    monkeypatch.setattr(page_text, "PLAIN", cells)
    rng = random.Random(6)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(0, 7))] if depth else []
        return rng.choice("abc") + (f"({' '.join(kids)})" if kids else "")

    for _ in range(25):
        one, two = (page_text.Tree(f"r({tree(3)} {tree(2)} {tree(2)})") for _ in range(2))
        assert page_text.matching(one, two) == plain(one, two)
