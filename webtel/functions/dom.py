"""Pages as arrays of elements: tokenising in Arrow batches, selectors and texts as columns.

A page is a struct of `nodes`, its elements in document order, and `texts`,
its pieces of text. An element has its place `at`, its parent's place `up`
(-1 at the top), the place of the last element inside it, and the range of
the pieces inside it. So an element is inside another exactly if its place
lies behind the other's and not behind its `last`: selectors compare places
and walk no tree, and a page of any depth takes time in its length.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtel.functions.urls import let

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INT, _STRING = T.IntegerType(), T.StringType()
_NODE = {"at": _INT, "up": _INT, "last": _INT, "tag": _STRING, "attrs": T.MapType(_STRING, _STRING), "start": _INT, "end": _INT}
_TEXT = {"of": _INT, "s": _STRING}


def _rows(fields: dict) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


PAGE = T.StructType([T.StructField("nodes", _rows(_NODE)), T.StructField("texts", _rows(_TEXT))])
_ATTRS = pa.map_(pa.string(), pa.string())


class _Tokens(HTMLParser):
    """Elements and pieces of text of one page after another, as flat lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at, self.up, self.last, self.tag, self.attrs, self.begin, self.end = [], [], [], [], [], [], []
        self.of, self.texts = [], []
        self.nodes_before, self.texts_before = [0], [0]

    def page(self, html: str) -> None:
        self.reset()
        self.path, self.open = [-1], {}
        self.feed(html)
        self.close()
        while len(self.path) > 1:
            self._close()
        self.end_page()

    def end_page(self) -> None:
        self.nodes_before.append(len(self.tag))
        self.texts_before.append(len(self.texts))

    def handle_starttag(self, tag, attrs):
        at, text = len(self.tag) - self.nodes_before[-1], len(self.texts) - self.texts_before[-1]
        self.at.append(at)
        self.up.append(self.path[-1])
        self.last.append(at)
        self.tag.append(tag)
        self.attrs.append(list({k: v or "" for k, v in reversed(attrs)}.items()))
        self.begin.append(text)
        self.end.append(text)
        if tag not in VOID:
            self.path.append(at)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _close(self) -> str:
        i = self.nodes_before[-1] + self.path.pop()
        self.last[i] = len(self.tag) - self.nodes_before[-1] - 1
        self.end[i] = len(self.texts) - self.texts_before[-1]
        self.open[self.tag[i]] -= 1
        return self.tag[i]

    def handle_endtag(self, tag):
        """Closes the innermost open element of that name and all inside; without one, nothing."""
        while self.open.get(tag) and self._close() != tag:
            pass

    def handle_data(self, data):
        self.of.append(self.path[-1])
        self.texts.append(data)


@F.arrow_udf(PAGE)
def elements(html: pa.Array) -> pa.Array:
    """The struct of a page's elements and texts; null for a null page."""
    t = _Tokens()
    for one in html:
        t.page(one.as_py()) if one.is_valid else t.end_page()
    ints = lambda v: pa.array(v, pa.int32())
    columns = [ints(t.at), ints(t.up), ints(t.last), pa.array(t.tag, pa.string()), pa.array(t.attrs, _ATTRS), ints(t.begin), ints(t.end)]
    nodes = pa.StructArray.from_arrays(columns, list(_NODE))
    texts = pa.StructArray.from_arrays([ints(t.of), pa.array(t.texts, pa.string())], list(_TEXT))
    lists = [pa.ListArray.from_arrays(ints(t.nodes_before), nodes), pa.ListArray.from_arrays(ints(t.texts_before), texts)]
    return pa.StructArray.from_arrays(lists, ["nodes", "texts"], mask=html.is_null())


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _outermost(hits: Column) -> Column:
    """(at, last) of the hits that are inside no other.

    A running maximum of `last` decides; it is taken in about the square
    root of n parts, first inside each and then over all of them, since an
    array is copied whenever it grows.
    """
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<at: int, last: int>>").alias("outer"))

    def grown(s: Column, n: Column) -> Column:
        one = F.array(F.struct(n["at"].alias("at"), n["last"].alias("last")))
        return F.when(n["at"] > s["last"], F.struct(n["last"].alias("last"), F.concat(s["outer"], one).alias("outer"))).otherwise(s)

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(-1)), lambda s, p: F.concat(s, F.array(F.greatest(F.element_at(s, -1), p["last"]))))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.filter(p["outer"], lambda m: m["at"] > F.get(b, i)))))

    def cut(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(x["h"]) - 1, F.lit(0)), x["w"])
        return let(F.transform(at, lambda i: F.aggregate(F.slice(x["h"], i + 1, x["w"]), start, grown)), joined)

    return let(hits, lambda h: let(F.struct(h.alias("h"), F.greatest(F.ceil(F.sqrt(F.size(h))), F.lit(16)).cast("int").alias("w")), cut))


def covers(hits: Column, size: Column, off: Column) -> Column:
    """For each of `size` places from `off` on, the last place inside the outermost hit that began most recently; -1 before the first."""

    def spread(outer: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(outer, i)["at"], off + size)
        runs = F.transform(outer, lambda m, i: F.array_repeat(m["last"], begin(i + 1) - m["at"]))
        return F.flatten(F.concat(F.array(F.array_repeat(F.lit(-1), begin(F.lit(0)) - off)), runs))

    return let(_outermost(hits), spread)


def inside(cover: Column, at: Column, index: Column | None = None) -> Column:
    """Whether the element at a place is a hit or inside one; with the index before its own, whether it is inside one."""
    return F.coalesce(F.get(cover, at if index is None else index) >= at, F.lit(False))


def is_gone(gone: tuple[Column, ...], at: Column) -> Column:
    return reduce(lambda a, b: a | b, [inside(c, at) for c in gone], F.lit(False))


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:[~^$*]?=(?:\"[^\"]*\"|'[^']*'|[^\]]*))?\])*)$")
_MORE = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*]?)=(?:\"([^\"]*)\"|'([^']*)'|([^\]]*)))?\]")


def _words(c: Column) -> Column:
    return F.split(c, r"\s+")


class Selector:
    """Tags, ids, classes, attributes, descendants, children and lists; anything else is refused."""

    def __init__(self, text: str):
        self.paths = [self._path(p.strip()) for p in text.split(",")]

    def _path(self, text: str) -> list[tuple]:
        steps, child = [], False
        for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", text):
            if word == ">":
                child = True
                continue
            m = _SIMPLE.match(word)
            if not m or not word:
                raise ValueError(f"unsupported selector: {text}")
            steps.append((child, m[1] if m[1] != "*" else None, _MORE.findall(m[2])))
            child = False
        if not steps or child:
            raise ValueError(f"unsupported selector: {text}")
        return steps

    @staticmethod
    def _fits(node: Column, tag: str | None, more: list[tuple]) -> Column:
        wanted = [node["tag"] == tag.lower()] if tag else []
        for ident, cls, name, op, a, b, c in more:
            if ident:
                wanted.append(attr(node, "id") == ident)
            if cls:
                wanted.append(F.array_contains(_words(attr(node, "class")), cls))
            if name:
                have, want = attr(node, name), a or b or c
                test = {"": lambda h, w: h == w, "^": F.startswith, "$": F.endswith, "*": F.contains, "~": lambda h, w: F.array_contains(_words(h), w)}[op]
                wanted.append(test(have, F.lit(want)) if want else have.isNotNull())
        return reduce(lambda x, y: x & y, [F.coalesce(w, F.lit(False)) for w in wanted], F.lit(True))

    def _flags(self, nodes: Column, steps: list[tuple], off: Column) -> Column:
        """For each element, whether the steps end at it."""
        child, tag, more = steps[-1]
        if len(steps) == 1:
            return F.transform(nodes, lambda n: self._fits(n, tag, more))
        before = self._flags(nodes, steps[:-1], off)
        if child:
            return let(before, lambda b: F.transform(nodes, lambda n: self._fits(n, tag, more) & F.coalesce(F.get(b, n["up"] - off), F.lit(False))))
        above = let(before, lambda b: covers(F.filter(nodes, lambda _, i: F.get(b, i)), F.size(nodes), off))
        return let(above, lambda c: F.transform(nodes, lambda n: self._fits(n, tag, more) & inside(c, n["at"], n["at"] - off - 1)))

    def hits(self, nodes: Column, off: Column | None = None, gone: tuple[Column, ...] = ()) -> Column:
        """Elements of `nodes`, whose first place is `off`, that fit, in document order; none that is inside something gone.

        `gone` holds covers of the whole page.
        """
        off = F.lit(0) if off is None else off
        flags = F.array(*[self._flags(nodes, p, off) for p in self.paths])
        fits = lambda f, i: reduce(lambda a, b: a | b, [F.get(F.get(f, F.lit(k)), i) for k in range(len(self.paths))])
        return let(flags, lambda f: F.filter(nodes, lambda n, i: fits(f, i) & ~is_gone(gone, n["at"])))

    def below(self, node: Column, nodes: Column, gone: tuple[Column, ...] = ()) -> Column:
        """Hits inside an element, where each step of the selector is inside it too."""
        return let(F.slice(nodes, node["at"] + 2, node["last"] - node["at"]), lambda part: self.hits(part, node["at"] + 1, gone))


def pruned(nodes: Column, prunes: list[tuple[str, str]], use, gone: tuple[Column, ...] = ()) -> Column:
    """`use` of the covers of what (first or all, selector) remove, one after the other."""
    if not prunes:
        return use(gone)
    (how, text), *rest = prunes
    hits = Selector(text).hits(nodes, gone=gone)
    hits = F.slice(hits, 1, 1) if how == "first" else hits
    return let(covers(hits, F.size(nodes), F.lit(0)), lambda c: pruned(nodes, rest, use, (*gone, c)))


def pieces(page: Column, gone: tuple[Column, ...] = ()) -> Column:
    """The pieces of a page's text; those of elements that are gone are empty."""
    return F.transform(page["texts"], lambda t: F.when(is_gone(gone, t["of"]), "").otherwise(t["s"]) if gone else t["s"])


def text(node: Column, pieces_: Column) -> Column:
    return F.array_join(F.slice(pieces_, node["start"] + 1, node["end"] - node["start"]), "")
