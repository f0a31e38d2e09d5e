"""Page structure, and extraction by rules, as columns over the elements of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtel.functions import dom, sanitize, urls
from webtel.functions.dom import Selector

ColumnOrName = Column | str

STRUCTURE = "struct<title: string, canonical: string, language: string, noindex: boolean, requested_index: boolean, og: map<string, string>, jsonld: array<map<string, string>>>"
#: What is kept of OpenGraph and JSON-LD, what asks to be indexed, and elements that don't begin a body.
OG = ("title", "url", "image", "video")
JSONLD = ("@context", "@type", "@id", "url", "name", "headline", "duration", "dateCreated", "dateModified", "datePublished", "uploadDate")
INDEX = ("all", "index", "max-image-preview:large", "max-image-preview:standard", "max-video-preview:-1")
HEAD = ("html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _string(v: Column) -> Column:
    """A variant if it is a string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>")


def _kept(keys: Column, value) -> Column:
    """Map of those keys that have a value."""
    pairs = F.transform(keys, lambda k: F.struct(k.alias("k"), value(k).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"] != "", F.lit(False))))


def jsonld(text: Column) -> Column:
    """Array of the kept strings of each item of a JSON-LD text, at most 2,048 characters each; null if it is broken.

    The items are those of a list, or of the graph of an object that has
    only a context and a graph, whose context they take if they have none.
    """

    def items(v: Column, members: Column) -> Column:
        context, graph = _string(F.try_element_at(members, F.lit("@context"))), F.try_variant_get(v, "$['@graph']", "array<variant>")
        lifted = context.isNotNull() & graph.isNotNull() & (F.size(members) == 2)
        found = F.coalesce(F.when(lifted, graph), F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))
        return F.transform(found, lambda x: urls.let(_members(x), lambda m: entry(m, F.when(lifted, context))))

    def entry(members: Column, context: Column) -> Column:
        def value(k: Column) -> Column:
            own = _stripped(_string(F.try_element_at(members, k)))
            return urls.let(F.coalesce(F.when(own != "", own), F.when(k == "@context", context)), lambda s: F.when(F.length(s) <= 2048, s))

        return _kept(F.array(*[F.lit(k) for k in JSONLD]), value)

    return urls.let(F.try_parse_json(text), lambda v: urls.let(_members(v), lambda m: items(v, m)))


def _structure(page: Column, url: Column) -> Column:
    nodes = page["nodes"]

    def named(head: Column, name: str | Column, by: str = "name") -> Column:
        return F.filter(head, lambda n: (n["tag"] == "meta") & F.coalesce(dom.attr(n, by) == name, F.lit(False)))

    def lowered(n: Column, name: str, value: str) -> Column:
        return F.coalesce(F.lower(dom.attr(n, name)) == value, F.lit(False))

    def content(metas: Column) -> Column:
        return dom.attr(F.get(metas, F.lit(0)), "content")

    def built(head: Column, texts: Column, svg: Column) -> Column:
        title = dom.text(F.get(dom.Selector("title").hits(nodes, gone=(svg,)), F.lit(0)), texts)
        title = F.regexp_replace(_stripped(title), r"[\t\n\f\r ]+", " ")
        title = F.coalesce(F.when(title != "", title), content(named(head, "title")), F.lit(""))
        link = F.get(F.filter(head, lambda n: (n["tag"] == "link") & lowered(n, "rel", "canonical")), F.lit(0))
        lang = _stripped(dom.attr(F.get(F.filter(nodes, lambda n: n["tag"] == "html"), F.lit(0)), "lang"))
        robots = F.flatten(F.transform(named(head, "robots"), lambda n: F.transform(F.split(F.coalesce(dom.attr(n, "content"), F.lit("")), ","), _stripped)))
        noindex = F.arrays_overlap(robots, F.array(F.lit("noindex"), F.lit("none")))
        asked = F.arrays_overlap(robots, F.array(*[F.lit(w) for w in INDEX]))
        og = _kept(F.array(*[F.lit(k) for k in OG]), lambda k: content(named(head, F.concat(F.lit("og:"), k), "property")))
        scripts = F.filter(nodes, lambda n: (n["tag"] == "script") & lowered(n, "type", "application/ld+json"))
        values = {
            "title": title,
            "canonical": F.when(link.isNotNull(), urls.resolve(url, F.coalesce(dom.attr(link, "href"), F.lit("")))),
            "language": F.when((F.length(lang) > 0) & (F.length(lang) <= 10), lang),
            "noindex": noindex,
            "requested_index": ~noindex & asked,
            "og": og,
            "jsonld": F.flatten(F.array_compact(F.transform(scripts, lambda n: jsonld(dom.text(n, texts))))),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def in_head(body: Column) -> Column:
        above = lambda n: F.coalesce(F.get(nodes, n["up"])["tag"].isin("html", "head"), F.lit(True))
        return F.filter(nodes, lambda n: (n["at"] < body) & above(n))

    body = F.coalesce(F.get(F.filter(nodes, lambda n: ~n["tag"].isin(*HEAD)), F.lit(0))["at"], F.size(nodes))
    svg = dom.covers(F.filter(nodes, lambda n: n["tag"] == "svg"), F.size(nodes), F.lit(0))
    found = F.struct(urls.let(body, in_head).alias("head"), dom.pieces(page).alias("texts"), svg.alias("svg"))
    return urls.let(found, lambda f: built(f["head"], f["texts"], f["svg"]))


def page_structure(html: ColumnOrName, url: ColumnOrName) -> Column:
    """Struct of a page's title, canonical URL, language, index wishes, OpenGraph and JSON-LD; null for a null page.

    The title is the first one outside of drawings, else the meta title,
    else empty. What has to stand in the head must come before the first
    element of a body, where the tags of head and body may be left out.
    One `noindex` outweighs all wishes to be indexed. JSON-LD that is
    broken, repeats a name or is nested beyond what Spark reads has no items;
    an item without kept strings is an empty map.
    """
    url = F.col(url) if isinstance(url, str) else url
    return urls.let(dom.elements(html), lambda page: F.when(page.isNotNull(), _structure(page, url)).cast(STRUCTURE))


def _prunes(rule: dict) -> list[tuple[str, str]]:
    """(first or all, selector) of what is removed before; a bare selector means all."""
    return [("all", p) if isinstance(p, str) else next(iter(p.items())) for p in rule.get("prune", [])]


def _inputs(rule: dict) -> dict[str, tuple[str, dict]]:
    """selector -> (first or all, {field: alternatives of (relative selector or null, attribute, transforms)})."""

    def alternatives(field):
        if isinstance(field, (tuple, list)):
            return [(None, field[0], list(field[1]))]
        return [(f.get("select"), f["attr"], list(f.get("transform", []))) for f in field.get("firstMatch", [field])]

    out = {}
    for selector, given in rule["input"].items():
        how = next((h for h in ("first", "all") if set(given) == {h}), None)
        out[selector] = (how or "all", {k: alternatives(f) for k, f in (given[how] if how else given).items()})
    return out


def validate_rules(rules: dict, version: int = 1) -> None:
    """Refuse rules that are too new, or have unknown transforms, selectors or sources."""
    if rules.get("_meta", {}).get("minVersion", 0) > version:
        raise ValueError("the rules need a newer version")
    for name, rule in rules.items():
        if name == "_meta":
            continue
        for how, sel in _prunes(rule):
            if how not in ("first", "all"):
                raise ValueError(f"unknown way to prune: {how}")
            Selector(sel)
        inputs = _inputs(rule)
        for sel, (_, fields) in inputs.items():
            Selector(sel)
            for key, ways in fields.items():
                for inner, _, steps in ways:
                    if inner:
                        Selector(inner)
                    for step in steps:
                        if step[0] not in TRANSFORMS:
                            raise ValueError(f"unknown transform {step[0]} of {key}")
        for action, schema in rule.get("output", {}).items():
            for field in schema["fields"]:
                source = field.get("source")
                if source is not None and (source not in inputs or inputs[source][0] == "first" and field["key"] not in inputs[source][1]):
                    raise ValueError(f"action {action} has an unknown source for {field['key']}")


def _json(c, path: str, objects: bool = False):
    """The value at a dotted path of a JSON text; empty if there is none, or it is no scalar and only scalars are wanted."""
    found = F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")))
    return F.coalesce(found if objects else F.when(~found.rlike(r"^\s*[\[{]"), found), F.when(c.isNotNull(), ""))


def _masked(c, **how):
    return sanitize.sanitize(c, **how)["safe_url"]


#: Transforms of extracted columns: name -> column builder. They keep null as null.
TRANSFORMS = {
    "trim": lambda c: F.trim(c),
    "require_url": lambda c: F.when(urls.part(c, "scheme").isNotNull(), c),
    "filter_exact": lambda c, *allowed: F.when(c.isin(*allowed), c),
    "split": lambda c, sep, i: F.when(F.contains(c, F.lit(sep)), F.split_part(c, F.lit(sep), F.lit(i + 1))),
    "try_split": lambda c, sep, i: F.coalesce(F.when(F.split_part(c, F.lit(sep), F.lit(i + 1)) != "", F.split_part(c, F.lit(sep), F.lit(i + 1))), c),
    "query_param": lambda c, name: urls.query_param(c, name),
    "strip_fragment": lambda c: F.substring_index(c, "#", 1),
    "remove_params": lambda c, *names: F.when(urls.part(c, "scheme").isNotNull(), urls.remove_params(c, list(names))),
    "decode_component": lambda c: urls.decode_component(c),
    "try_decode_component": lambda c: F.coalesce(urls.decode_component(c), c),
    "json": _json,
    "mask_url": lambda c: _masked(c),
    "strict_mask_url": lambda c: _masked(c, is_id=lambda p: F.length(p) >= 12),
    "relaxed_mask_url": lambda c: _masked(c, preserve_path=True),
}

def _way(key: str, i: int) -> str:
    return f"{key}#{i}"


def _value(node: Column, what: str, base: Column, texts: Column) -> Column:
    if what == "text":
        return dom.text(node, texts)
    value = dom.attr(node, what)
    return urls.resolve(base, value) if what == "href" else value


def _raw(page: Column, base: Column, rules: dict) -> Column:
    """Array of (rule, selector, position, raw): what the selectors of all rules find, before any transform.

    Of a field with several alternatives only the first that matches has a
    value, under its number.
    """
    nodes = page["nodes"]

    def one(node: Column, inner: str | None, what: str, texts: Column, gone: tuple) -> Column:
        if not inner:
            return _value(node, what, base, texts)
        return urls.let(F.get(Selector(inner).below(node, nodes, gone), F.lit(0)), lambda n: _value(n, what, base, texts))

    def first(values: Column) -> Column:
        before = lambda i: F.exists(F.slice(values, F.lit(1), i), lambda v: v.isNotNull())
        return F.transform(values, lambda v, i: F.when(~before(i), v))

    def raw(node: Column, fields: dict, texts: Column, gone: tuple) -> Column:
        names = [F.lit(_way(key, i)) for key, ways in fields.items() for i in range(len(ways))]
        values = [urls.let(F.array(*[one(node, inner, what, texts, gone) for inner, what, _ in ways]), first) for ways in fields.values()]
        return F.map_from_arrays(F.array(*names), F.concat(*values)) if names else F.create_map().cast("map<string, string>")

    def row_of(rule: str, name: str, fields: dict, texts: Column, gone: tuple):
        return lambda n, i: F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("selector"), i.alias("position"), raw(n, fields, texts, gone).alias("raw"))

    def of_rule(rule: str, inputs: dict, texts: Column, gone: tuple) -> Column:
        found = []
        for name, (how, fields) in inputs.items():
            hits = Selector(name).hits(nodes, gone=gone)
            hits = F.slice(hits, 1, 1) if how == "first" else hits
            found.append(F.transform(hits, row_of(rule, name, fields, texts, gone)))
        return F.concat(*found)

    def rule_hits(rule: str, r: dict) -> Column:
        return dom.pruned(nodes, _prunes(r), lambda gone: urls.let(dom.pieces(page, gone), lambda texts: of_rule(rule, _inputs(r), texts, gone)))

    kind = "array<struct<rule: string, selector: string, position: int, raw: map<string, string>>>"
    found = [rule_hits(rule, r).cast(kind) for rule, r in rules.items() if rule != "_meta" and r["input"]]
    return F.coalesce(F.concat(*found), F.array().cast(kind)) if found else F.array().cast(kind)


def _field(raw, key: str, ways: list):
    """A field after its transforms; a null in a chain stays null."""
    out = []
    for i, (_, _, steps) in enumerate(ways):
        c = F.try_element_at(raw, F.lit(_way(key, i)))
        for name, *args in steps:
            c = TRANSFORMS[name](c, *args)
        out.append(c)
    return F.coalesce(*out)


def _with_hits(pages: DataFrame, rules: dict, html: str, url: str) -> DataFrame:
    """`pages` with the array _x of what the rules find; each page is tokenised once, a null one has no hits.

    It is exploded with `explode_outer`: of a plain `explode`, Spark makes a
    filter on the array's size, for which pages would be tokenised again.
    """
    return pages.withColumn("_page", dom.elements(F.col(html))).withColumn("_x", _raw(F.col("_page"), F.col(url), rules))


def extract(pages: DataFrame, rules: dict, html: str = "html", url: str = "url") -> DataFrame:
    """(rule, selector, position, fields): a row for each node that a rule's selector finds, in document order.

    A rule has `prune` (selectors to remove first: all hits, or {"first":
    selector}) and `input`: selector -> {field: (attribute or 'text',
    [(transform, args...)])}, for all hits or as {"first": {...}} for the
    first. A field may also be {"select": inside the hit, "attr": ...,
    "transform": [...]}, or {"firstMatch": [...]} of such. A page is parsed
    once; transforms are columns.
    """
    validate_rules(rules)
    kept = [c for c in pages.columns if c != html]
    rows = _with_hits(pages, rules, html, url).select(*kept, F.explode_outer("_x").alias("_x")).where("_x is not null").select(*kept, "_x.*")
    values: dict[str, list] = {}
    for rule, r in rules.items():
        if rule == "_meta":
            continue
        for sel, (_, fields) in _inputs(r).items():
            for key, ways in fields.items():
                here = (F.col("rule") == rule) & (F.col("selector") == sel)
                values.setdefault(key, []).append(F.when(here, _field(F.col("raw"), key, ways)))
    return rows.withColumns({k: F.coalesce(*values[k]) for k in sorted(values)}).drop("raw")


def _present(c):
    return F.coalesce(F.length(c) > 0, F.lit(False))


def _all(conditions: list):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _hits(found, rule: str, source: str):
    return F.filter(found, lambda x: (x["rule"] == rule) & (x["selector"] == source))


def _records(hits, inner: dict, required: list[str]):
    """Records of the hits that have all required fields."""
    records = F.transform(hits, lambda x: F.struct(*[_field(x["raw"], k, w).alias(k) for k, w in inner.items()]))
    return F.filter(records, lambda r: _all([_present(r[k]) for k in required]))


def messages(pages: DataFrame, rules: dict, context: dict[str, str] | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """(rule, action, payload, deduplicate_by): the messages that the `output` of rules makes of each page.

    `output`: action -> {"fields": [{"key", "source", "optional",
    "requiredKeys"}], "omitIfExistsAny": [actions], "deduplicateBy": text}.
    A field of a `first` source is a value, of an `all` source a map of
    numbers to records that have all required keys (by default all), and
    without a source a value of the context (name -> column of `pages`).
    Empty counts as absent. A message lacks no field unless it is optional;
    context values that are absent are left out. Messages are built inside
    the row of their page, so nothing is shuffled.
    """
    validate_rules(rules)
    context = context or {}
    found = F.col("_x")
    made, shown = [], []
    for rule, r in rules.items():
        if rule == "_meta":
            continue
        inputs = _inputs(r)
        of_rule = []
        for action, schema in r.get("output", {}).items():
            fields, needed = [], []
            for f in schema["fields"]:
                key, source, optional = f["key"], f.get("source"), f.get("optional", False)
                if source is None:
                    value = F.col(f"`{context[key]}`").cast("string") if key in context else F.lit(None).cast("string")
                    fields.append(F.when(_present(value), value).alias(key))
                    continue
                how, inner = inputs[source]
                hits = _hits(found, rule, source)
                if how == "first":
                    value = _field(F.get(hits, F.lit(0))["raw"], key, inner[key])
                    ok = _present(value)
                else:
                    records = _records(hits, inner, f.get("requiredKeys", list(inner)))
                    ok = F.size(records) > 0
                    value = F.map_from_arrays(F.transform(records, lambda _, i: i.cast("string")), records)
                fields.append(value.alias(key))
                if not optional:
                    needed.append(ok)
            body = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}) if fields else F.lit("{}")
            row = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), body.alias("payload"), F.lit(schema.get("deduplicateBy", "")).alias("deduplicate_by"))
            of_rule.append((F.when(_all(needed), row), schema.get("omitIfExistsAny", []), action))
        if not of_rule:
            continue
        at = {action: len(made) + i for i, (_, _, action) in enumerate(of_rule)}
        made += [m for m, _, _ in of_rule]
        shown += [([at[a] for a in omit if a in at], at[action]) for _, omit, action in of_rule]
    kept = [c for c in pages.columns if c != html]
    rows = _with_hits(pages, rules, html, url).select(*kept, F.array(*made).alias("_made"))
    m = lambda i: F.get("_made", F.lit(i))
    left = [F.when(_all([m(j).isNull() for j in others]), m(i)) for others, i in shown]
    return rows.select(*kept, F.explode_outer(F.array_compact(F.array(*left))).alias("_m")).where("_m is not null").select(*kept, "_m.*")
