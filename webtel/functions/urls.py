"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, user, password, host, port, path, search, fragment.
PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@:]*)(?::([^/?#@]*))?@)?([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
PARTS = ("scheme", "user", "password", "host", "port", "path", "search", "fragment")

#: Public suffixes of more than one label that are known without a full list; others are the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.br", "com.mx", "com.ar", "co.in", "co.kr", "com.tr", "com.cn", "com.tw", "co.za", "github.io", "blogspot.com")


_MARK = "\0"


def _fields(url: Column) -> Column:
    """All parts by one run of the pattern, as an array behind an empty entry; a malformed URL is its only entry."""
    marked = F.regexp_replace(F.replace(url, F.lit(_MARK), F.lit("%00")), PATTERN, "".join(f"{_MARK}${i + 1}" for i in range(len(PARTS))))
    return F.split(marked, _MARK)


def part(url: Column, name: str) -> Column:
    """One part of a URL; empty if absent, null if the URL is null or malformed.

    Parts of one URL in one projection share the parsed array.
    """
    found = F.get(_fields(url), F.lit(PARTS.index(name) + 1))
    if name in ("scheme", "host"):
        return F.lower(found)
    if name == "path":
        return F.when(found == "", "/").otherwise(found)
    return found


def let(value: Column, use) -> Column:
    """`use` of a column that is computed once for each row, however often it stands in the result."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def parts(url: Column) -> Column:
    """Struct of all parts; null if the URL is null or malformed."""

    def named(f: Column) -> Column:
        field = {p: F.get(f, F.lit(i + 1)) for i, p in enumerate(PARTS)}
        field |= {"scheme": F.lower(field["scheme"]), "host": F.lower(field["host"]), "path": F.when(field["path"] == "", "/").otherwise(field["path"])}
        return F.when(F.size(f) > 1, F.struct(*[field[p].alias(p) for p in PARTS]))

    return let(_fields(url), named)


def is_page(url: Column) -> Column:
    """Real pages are http or https URLs; null is none."""
    return F.coalesce(url.rlike("^https?://"), F.lit(False))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def strip_search(url: Column) -> Column:
    return F.substring_index(strip_fragment(url), "?", 1)


def params(search: Column) -> Column:
    """Array of key=value strings of a search part (with or without the question mark)."""
    bare = F.regexp_replace(search, r"^\?", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "&"))


def query_param(url: Column, name: str) -> Column:
    """Decoded value of the first parameter of that name; null if absent. A plus is a space."""
    hit = F.filter(params(part(url, "search")), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.get(hit, F.lit(0))
    return F.try_url_decode(F.when(value.contains("="), F.regexp_replace(value, "^[^=]*=", "")).otherwise(F.when(value.isNotNull(), "")))


def remove_params(url: Column, names: list[str]) -> Column:
    """The URL without these parameters; what stays is not encoded again."""
    kept = F.filter(params(part(url, "search")), lambda p: ~F.substring_index(p, "=", 1).isin(*names))
    head, fragment = strip_search(url), part(url, "fragment")
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("?"), F.array_join(kept, "&"), fragment)).when(F.size(kept) == 0, F.concat(head, fragment)).otherwise(url)


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?$")


def is_local_ip(ip: Column) -> Column:
    """Loopback, private and link-scope addresses."""
    v4 = ip.rlike(r"^(?:127\.|0\.|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    return F.coalesce(v4 | (ip == "::1") | F.lower(ip).rlike("^f[de]"), F.lit(False))


def _registrable_pattern(suffixes: tuple[str, ...], depth: int) -> str:
    """Up to `depth` labels, one label, and a known suffix of several labels or any single one; a bare suffix does not fit.

    The search starts at the left, so the longest known suffix is found.
    """
    known = "|".join(s.replace(".", r"\.") for s in suffixes)
    bare = f"(?!(?:{known})$)" if known else ""
    more = f"(?:[^.]+\\.){{0,{depth}}}" if depth else ""
    return rf"(?:^|\.)({more}{bare}[^.]+\.(?:{known}{'|' if known else ''}[^.]+))$"


def registrable_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Public suffix and one more label; null for addresses and bare suffixes."""
    return F.when(~is_ipv4(host), F.nullif(F.regexp_extract(F.lower(host), _registrable_pattern(suffixes, 0), 1), F.lit("")))


def truncate_domain(host: Column, depth: int = 2, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registrable domain with at most `depth` further labels; addresses and bare suffixes stay whole."""
    found = F.regexp_extract(F.lower(host), _registrable_pattern(suffixes, depth), 1)
    return F.when(is_ipv4(host), host).when(found == "", F.lower(host)).otherwise(found)


def is_third_party(first: Column, other: Column) -> Column:
    """Registrable domains known and different, their first labels too (so that one name under two suffixes is one party)."""
    head = lambda c: F.substring_index(c, ".", 1)
    return F.coalesce((first != other) & (head(first) != head(other)), F.lit(False))


def trusted_url(url: Column, base: Column) -> Column:
    """An https URL of the same origin as `base`, without its fragment; else null."""
    same = (part(url, "host") == part(base, "host")) & (part(url, "port") == part(base, "port"))
    return F.when(same & (part(url, "scheme") == "https"), strip_fragment(url))


def resolve(base: Column, href: Column) -> Column:
    """A reference resolved against a URL; null where its host has brackets but is no IPv6 address.

    White space around it is dropped; without a hierarchical base it stays as it is. The
    base's fragment is never kept.
    """
    h = F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]+", "")
    b = F.coalesce(base, F.lit(""))
    origin = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)

    def rest(h: Column, o: Column) -> Column:
        path = F.regexp_extract(b, r"^[^/?#]*//[^/?#]*([^?#]*)", 1)
        own, tail = F.regexp_extract(h, r"^[^?#]*", 0), F.regexp_extract(h, r"(?s)[?#].*$", 0)
        folder = F.regexp_extract(path, r"^.*/", 0)
        merged = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
        return (
            F.when(h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*[\[\]]") & ~h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@\[\]]*@)?\[[0-9A-Fa-f:.]+\](?::[0-9]*)?(?:[/?#]|$)"), None)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (o == ""), h)
            .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(o, r"^[^/]*", 0), h))
            .when((h == "") | F.startswith(h, F.lit("#")), F.concat(F.regexp_extract(b, r"^[^#]*", 0), h))
            .when(F.startswith(h, F.lit("?")), F.concat(o, path, h))
            .otherwise(F.concat(o, let(merged, without_dots), tail))
        )

    return let(F.struct(h.alias("h"), origin.alias("o")), lambda x: rest(x["h"], x["o"]))


def without_dots(path: Column) -> Column:
    """An absolute path without its segments of one or two dots."""
    steps = F.split(path, "/")
    shorter = lambda s: F.when(F.size(s) > 1, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
    kept = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")), lambda s, x: F.when(x == ".", s).when(x == "..", shorter(s)).otherwise(F.concat(s, F.array(x))))
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(closed, "/")).otherwise(path)


def decode_component(c: Column) -> Column:
    """Percent decoding that leaves a plus alone; null for broken sequences."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def decode_repeatedly(c: Column) -> Column:
    """Decoded until nothing changes; what cannot be decoded stays.

    A round turns each %25 into a % at most, so each sequence lives no longer than the longest row of 25 behind a %.
    """
    state = lambda t, done: F.struct(t.alias("text"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        new = F.coalesce(decode_component(s["text"]), s["text"])
        return F.when(s["done"], s).otherwise(state(new, new == s["text"]))

    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("%(?:25)*"), F.lit(0)), F.length))
    rounds = F.sequence(F.lit(0), F.coalesce(F.floor(longest / 2), F.lit(0)).cast("int") + 1)
    return F.aggregate(rounds, state(c, c.isNull() | ~F.contains(c, F.lit("%"))), step, lambda s: s["text"])


def search_landing(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(category, query) by the first of (category, host pattern, parameter) that fits with a query; else null."""
    out = F.lit(None).cast("struct<category:string,query:string>")
    for category, host, name in reversed(rules):
        q = query_param(url, name)
        out = F.when(part(url, "host").rlike(host) & (F.length(q) > 0), F.struct(F.lit(category).alias("category"), q.alias("query"))).otherwise(out)
    return out


#: Search engines as (category, pattern, prefix of the request, parameters of the query, host of the request or null).
#: The first pattern that fits decides.
SEARCH_RULES = (
    ("search-gos", r"^https://scholar\.google\.[^/]+/scholar.*[?&]q=", "scholar?q=", ("q",), None),
    ("search-goi", r"^https://[^/]*\.google\..*?[#?&;]((q=[^&]+&([^&]+&)*udm=2)|(udm=2&([^&]+&)*q=[^&]+))", "search?udm=2&q=", ("q",), None),
    ("search-gov", r"^https://[^/]*\.google\..*?[#?&;]((q=[^&]+&([^&]+&)*udm=7)|(udm=7&([^&]+&)*q=[^&]+))", "search?udm=7&q=", ("q",), None),
    ("search-go", r"^https://[^/]*\.google\..*?[#?&;]", "search?q=", ("q",), None),
    ("search-ya", r"^https://[^/]*\.search\.yahoo\..*?[#?&;][pq]=[^$&]+", "search?q=", ("q", "p"), None),
    ("search-bii", r"^https://[^/]*\.bing\.[^/]+/images/search[?]q=[^$&]+", "images/search?q=", ("q",), None),
    ("search-bi", r"^https://[^/]*\.bing\..*?[#?&;]q=[^$&]+", "search?q=", ("q",), None),
    ("search-am", r"^https://[^/]*\.amazon\.[^/]+/(s[?]k=[^$&]+|.*[?&]field-keywords=[^$&]+)", "s/?field-keywords=", ("field-keywords", "k"), None),
    ("search-dd", r"^https://(?:html\.)?duckduckgo\.com/.*([?&]q=[^&]+.*&ia=web|[?]q=[^&]+$)", "html?q=", ("q",), "html.duckduckgo.com"),
    ("search-br", r"^https://search\.brave\.com/search[?]q=[^&]+", "search?q=", ("q",), None),
    ("search-bri", r"^https://search\.brave\.com/images[?]q=[^&]+", "images?q=", ("q",), None),
    ("search-brn", r"^https://search\.brave\.com/news[?]q=[^&]+", "news?q=", ("q",), None),
    ("search-brv", r"^https://search\.brave\.com/videos[?]q=[^&]+", "videos?q=", ("q",), None),
    ("search-ec", r"^https://www\.ecosia\.org/search[?](?:method=index&)?q=[^&]+", "search?q=", ("q",), None),
    ("search-qw", r"^https://www\.qwant\.com/.*[?&]((q=[^&]+&([^&]+&)*t=web)|(t=web&([^&]+&)*q=[^&]+))", "?q=", ("q",), None),
)


def encode_component(c: Column) -> Column:
    """Percent encoding where a space is %20 and !~'() stand for themselves."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def analyse_search(url: Column, rules: tuple = SEARCH_RULES) -> Column:
    """Struct (category, query, request_url) of a search page, by the first rule that fits; null if none does or there is no query.

    A plus in the query is a space, and is one again in the request.
    """
    spaced = F.replace(url, F.lit("+"), F.lit("%20"))
    first = F.coalesce(*[F.when(url.rlike(r[1]), F.lit(i)) for i, r in enumerate(rules)])
    of_rule = lambda i: F.get(F.array(*[F.lit(r[i]) for r in rules]), first)
    ways = {names: [i for i, r in enumerate(rules) if r[3] == names] for names in dict.fromkeys(r[3] for r in rules)}
    by_name = {n: F.nullif(query_param(spaced, n), F.lit("")) for names in ways for n in names}
    query = F.coalesce(*[F.when(first.isin(at), F.coalesce(*[by_name[n] for n in names])) for names, at in ways.items()])
    request = F.concat(F.lit("https://"), F.coalesce(of_rule(4), part(spaced, "host")), F.lit("/"), of_rule(2), F.replace(encode_component(query), F.lit("%20"), F.lit("+")))
    return F.when(query.isNotNull(), F.struct(of_rule(0).alias("category"), query.alias("query"), request.alias("request_url")))


def randomised_params(url: Column, names: list[str], key: Column) -> Column:
    """The URL with new values of 6 to 14 characters for these parameters where they are present, drawn by a hash of `key`."""

    def fresh(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        digest = F.sha2(F.concat_ws("\n", key, name), 256)
        length = F.lit(6) + (F.conv(F.substring(digest, 57, 8), 16, 10).cast("long") % 9).cast("int")
        return F.when(name.isin(*names), F.concat(name, F.lit("="), F.substr(digest, F.lit(1), length))).otherwise(p)

    values = F.transform(params(part(url, "search")), fresh)
    changed = F.concat(strip_search(url), F.lit("?"), F.array_join(values, "&"), part(url, "fragment"))
    return F.when(F.size(values) > 0, changed).otherwise(url)
