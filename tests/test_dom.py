"""Elements, selectors and texts as columns against a tree that is searched step by step."""

import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webtel.functions import dom, html, urls

SELECTORS = ["p", "div > p", "#d p", ".a.b span p", "[id=d], span", "div[class~=b]", "b", "div div", "div > div > p", "* > p", "div p, p span", "[class^=a]", "[class$=b]", "p[class*=' ']", "div > span p"]


class Tree(HTMLParser):
    """(tag, attributes, parents from the nearest on) of each element, and its text."""

    def __init__(self, page):
        super().__init__()
        self.path, self.all = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in reversed(attrs)}, "parents": self.path[::-1], "text": ""}
        self.all.append(node)
        if tag not in dom.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n["tag"] == tag for n in self.path):
            while self.path.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for n in self.path:
            n["text"] += data


def simple(node, step):
    _, tag, more = step
    have = node["attrs"]
    ok = not tag or node["tag"] == tag
    for ident, cls, name, op, *want in more:
        want = "".join(want)
        ok &= not ident or have.get("id") == ident
        ok &= not cls or cls in have.get("class", "").split()
        if name:
            ok &= name in have
            value = have.get(name, "")
            ok &= not want or {"": value == want, "^": value.startswith(want), "$": value.endswith(want), "*": want in value, "~": want in value.split()}[op]
    return ok


def fits(node, steps, root=None):
    """Naive search upwards; nothing at or above `root` counts."""
    *before, last = steps
    if not simple(node, last):
        return False
    above = []
    for p in node["parents"]:
        if p is root:
            break
        above.append(p)
    return not before or any(fits(p, before, root) for p in (above[:1] if last[0] else above))


def hits(tree, selector, root=None):
    paths = dom.Selector(selector).paths
    return [n for n in tree.all if (root is None or any(p is root for p in n["parents"])) and any(fits(n, p, root) for p in paths)]


def random_page(seed):
    r = random.Random(seed)
    out = []
    for _ in range(r.randrange(60)):
        tag = r.choice(["div", "p", "span", "br", "b"])
        extra = r.choice(["", "", ' id="d"', ' class="a b"', ' class="b"', ' class="a"'])
        out.append(r.choice([f"<{tag}{extra}>", f"</{tag}>", f"<{tag}{extra}>", "x ", "&amp;", "é"]))
    return "".join(out)


@pytest.fixture(scope="module")
def random_pages(spark):
    rows = [(i, random_page(i)) for i in range(150)] + [(150, ""), (151, None), (152, "no tag"), (153, "<p>" * 3)]
    return rows, spark.createDataFrame(rows, "i int, html string")


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_against_a_tree(random_pages, selector):
    rows, df = random_pages
    page = F.col("page")
    found = df.withColumn("page", dom.elements("html")).select("i", F.transform(dom.Selector(selector).hits(page["nodes"]), lambda n: dom.text(n, dom.pieces(page))).alias("t"))
    got = {r.i: r.t for r in found.collect()}
    assert got == {i: None if p is None else [n["text"] for n in hits(Tree(p), selector)] for i, p in rows}


def test_fields_and_prunes_against_a_tree(random_pages):
    rows, df = random_pages
    rules = {"r": {"prune": [{"first": "b"}, "span.a"], "input": {"div": {"t": ("text", []), "c": {"select": "div p, p", "attr": "class"}, "f": {"firstMatch": [{"select": "div > span", "attr": "text"}, {"select": "p", "attr": "id"}]}}, "p": {"first": {"t": ("text", [])}}}}}
    got = sorted(((r.i, r.selector, r.position, r.t, r.c, r.f) for r in html.extract(df.withColumn("url", F.lit(None).cast("string")), rules).collect()), key=str)
    want = []
    for i, page in rows:
        tree = Tree(page or "")
        gone = []
        for how, s in (("first", "b"), ("all", "span.a")):
            open_ = [n for n in hits(tree, s) if not any(n is g or any(p is g for p in n["parents"]) for g in gone)]
            gone += open_[:1] if how == "first" else open_
        left = [n for n in tree.all if not any(n is g or any(p is g for p in n["parents"]) for g in gone)]
        cut = Pruned(page or "", [tree.all.index(g) for g in gone])
        text = {id(n): cut.all[k]["text"] for k, n in enumerate(tree.all)}
        stays = lambda found: [n for n in found if any(n is x for x in left)]  # noqa: E731, B023
        for at, n in enumerate(stays(hits(tree, "div"))):
            c = next((x["attrs"].get("class") for x in stays(hits(tree, "div p, p", n))), None)
            f = next((text[id(x)] for x in stays(hits(tree, "div > span", n))), None)
            if f is None:
                f = next((x["attrs"].get("id") for x in stays(hits(tree, "p", n))), None)
            want.append((i, "div", at, text[id(n)], c, f))
        want += [(i, "p", 0, text[id(n)], None, None) for n in stays(hits(tree, "p"))[:1]]
    assert got == sorted(want, key=str)


class Pruned(Tree):
    """The same tree, where what is inside the elements of these numbers adds no text."""

    def __init__(self, page, gone):
        self.gone = gone
        super().__init__(page)

    def handle_data(self, data):
        if not any(self.all[g] in self.path and any(self.all[g] is p for p in self.path) for g in self.gone if g < len(self.all)):
            super().handle_data(data)


PAGE = """<html lang="en-GB"><head><title> A &amp;
 B </title><link rel="Canonical" href="/c"><meta name="robots" content="all, noindex"><meta name="robots" content="index">
<meta property="og:title" content="T"><meta property="og:title" content="U"><meta property="og:url" content="">
<script type="application/ld+json">{"@context":"c","@graph":[{"@type":"Article","headline":" H ","name":["x"]},{"@type":"X","@context":"d","other":1}]}</script>
<script type="application/ld+json">{broken</script><script type="application/ld+json">[{"url":"u"},{"@graph":[{"url":"v"}]},3]</script></head>
<body><div id="d" class="a b"><p>one</p><span><p>two</p></span></div><meta property="og:image" content="no"></body></html>"""


def structure(spark, pages):
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(pages)], "i int, url string, html string")
    return [r.s for r in df.select("i", html.page_structure("html", "url").alias("s")).orderBy("i").collect()]


def test_page_structure(spark):
    s, empty, null, drawn, meta, asked = structure(
        spark,
        [
            ("https://h.test/x/y", PAGE),
            ("", ""),
            ("https://h.test/", None),
            (None, "<svg><title>no</title></svg><title>yes</title><link rel=canonical href=/late>"),
            (None, "<meta name=title content=M><link rel=canonical href=c><html lang=''>"),
            (None, "<meta name=robots content='follow,  max-image-preview:large'><meta name=robots>"),
        ],
    )
    assert (s.title, s.canonical, s.language, s.noindex, s.requested_index, s.og) == ("A & B", "https://h.test/c", "en-GB", True, False, {"title": "T"})
    assert s.jsonld == [{"@context": "c", "@type": "Article", "headline": "H"}, {"@context": "d", "@type": "X"}, {"url": "u"}, {}, {}]
    assert null is None
    assert (empty.title, empty.canonical, empty.language, empty.noindex, empty.og, empty.jsonld) == ("", None, None, False, {}, [])
    assert (drawn.title, drawn.canonical) == ("yes", None)
    assert (meta.title, meta.canonical, meta.language) == ("M", "c", None)
    assert (asked.noindex, asked.requested_index) == (False, True)


@pytest.mark.parametrize("selector", ["p:first-child", "a + b", "", "div >"])
def test_other_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        dom.Selector(selector)


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet=st.sampled_from("<>/!-=\"' abp&#;\0\n[]"), max_size=200))
def test_tokens_are_nested(page):
    t = dom._Tokens()
    t.page(page)
    for i, up in enumerate(t.up):
        assert up < i <= t.last[i] < len(t.tag) and t.begin[i] <= t.end[i] <= len(t.texts)
        assert up < 0 or t.last[i] <= t.last[up] and t.begin[up] <= t.begin[i] and t.end[i] <= t.end[up]


def test_hostile_pages(spark):
    page = '<link rel="canonical" href="http://["><script type="application/ld+json">' + "[" * 100000 + "</script><title>t</title>"
    got = structure(spark, [("https://a.example/", page)])[0]
    assert got.title == "t" and got.canonical is None and got.jsonld == []


@pytest.mark.parametrize("n", [5, 30_000])
def test_pages_of_any_depth_and_width(spark, n):
    pages = ["<a>" * n + "<title>deep</title>" + "</b>" * n, "<a>x</a>" * n + "<title>wide</title>"]
    assert [s.title for s in structure(spark, [(None, p) for p in pages])] == ["deep", "wide"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn("page", dom.elements("html"))
    got = df.select("i", *[F.size(dom.Selector(s).hits(F.col("page.nodes"))).alias(f"n{k}") for k, s in enumerate(["a > a b, a title", "a a", "a"])]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(1, n - 1, n), (0, 0, n)]


def test_references_are_resolved(spark):
    base = "http://h.test:8/a/b/c?x=1#f"
    refs = ["d", "./d", "../d", "../../../d", "/d/./e/../f", "d/..", ".", "..", "?y=2", "//o.test/p", "https://o.test/a/../b", "mailto:a@b.c", "d?z=/../q#../w", "d#s", "#s", "g;x=1/../y"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, r string")
    got = [r.x for r in df.select("i", urls.resolve(F.lit(base), F.col("r")).alias("x")).orderBy("i").collect()]
    assert got == [urljoin(base, r) for r in refs]
    more = spark.sql("SELECT * FROM VALUES (1, 'http://h', 'd'), (2, null, 'd'), (3, 'http://h/', ' d\n'), (4, 'http://h/', 'http://['), (5, 'http://h/', 'http://[::1]:80/x'), (6, 'http://h/a#f', ''), (7, 'http://h/', null) AS t(i, b, r)")
    assert [r.x for r in more.select("i", urls.resolve(F.col("b"), F.col("r")).alias("x")).orderBy("i").collect()] == ["http://h/d", "d", "http://h/d", None, "http://[::1]:80/x", "http://h/a", None]
