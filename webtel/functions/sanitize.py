"""URL sanitising: ordered rules as one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtel.functions import text, urls

#: Path parts (in lower case, underscores as hyphens) that may expose an account or a session.
RISKY_PARTS = (
    "login", "login.php", "login-actions", "logout", "signin", "recover", "forgot", "forgot-password",
    "reset-credentials", "authenticate", "not-confirmed", "reset", "oauth", "password", "token", "edit",
    "checkout", "account", "share", "sharing", "admin", "console", "wp-admin", "wp-admin.php", "weblogic",
)
#: Patterns of URLs that carry redirects, orders, log-ins or places.
RISKY_PATTERNS = {
    "redirect": r"(?i)[&?]redirect(?:-?url)?=",
    "embedded url": r"[&?#/=;](?:http|https)(?::/|%3A%2F)",
    "order": r"(?i)/order/.",
    "realm": r"(?i)/auth/realms/",
    "openid": r"(?i)/protocol/openid-connect/",
    "coordinates": r"(?i)(?:(?:maps|route[^r-]).*|@)[0-9]{1,2}[^0-9]-?[0-9]{6}.+[0-9]{1,2}[^0-9]-?[0-9]{6}",
}
PROTECTED = " (PROTECTED)"


def _value(p: Column) -> Column:
    return F.regexp_replace(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(""), r"\+", " ")


def _bad_param(p: Column) -> Column:
    def unsafe(v: Column) -> Column:
        return F.when((F.length(v) >= 18) & ~v.rlike("^[a-z-_]+$"), text.suspicious(v).isNotNull()).otherwise(F.lit(False))

    return urls.let(F.coalesce(F.try_url_decode(_value(p)), _value(p)), unsafe)


def _reasons(url: Column, p: Column, is_id=None) -> tuple[Column, Column]:
    """(why a URL is dropped, why it is truncated), each null if it isn't; `p` has its parts. `is_id` tests strings for identifiers (strict mode)."""
    host, search = p["host"], p["search"]
    params = urls.params(search)
    drop = (
        F.when(p.isNull(), "invalid")
        .when(p["user"] != "", "user name")
        .when(p["password"] != "", "password")
        .when(~p["port"].isin("", "80", "443"), "port")
        .when(~p["scheme"].isin("http", "https"), "protocol")
        .when(host.isin("localhost", "127.0.0.1"), "not public")
        .when(host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "address")
        .when(F.length(host) > 50, "long host")
    )
    decoded = F.coalesce(urls.decode_component(url), url)
    pieces = F.split(p["path"], "/")
    risky = lambda x: F.replace(F.lower(x), F.lit("_"), F.lit("-")).isin(*RISKY_PARTS)
    cut = (
        F.when(F.length(url) > 800, "long url")
        .when(F.length(search) > 150, "long search")
        .when(F.size(params) > 8, "many parameters")
        .when(text.has_email(url) | text.has_email(decoded), "email")
        .when(F.size(pieces) > 8, "many path parts")
        .when(F.exists(pieces, risky), "risky path part")
    )
    if is_id is not None:
        cut = cut.when(F.exists(pieces, lambda x: is_id(x)), "identifier in path")
    for name, pattern in RISKY_PATTERNS.items():
        cut = cut.when(url.rlike(pattern), name)
    cut = cut.when(F.exists(params, _bad_param), "problematic parameter")
    if is_id is not None:
        cut = cut.when(F.exists(params, lambda x: is_id(_value(x))), "identifier in parameter")
    return drop, cut


def reasons(url: Column, is_id=None) -> Column:
    """Struct (url, p, drop, cut): a URL, its parts, and why it is dropped or truncated, each null if it isn't."""

    def judged(s: Column) -> Column:
        drop, cut = _reasons(s["url"], s["p"], is_id)
        return F.struct(s["url"].alias("url"), s["p"].alias("p"), drop.alias("drop"), cut.alias("cut"))

    return urls.let(F.struct(url.alias("url"), urls.parts(url).alias("p")), judged)


def sanitize(url: Column, preserve_path: bool = False, is_id=None) -> Column:
    """Struct (result, safe_url, reason): safe, truncated or dropped.

    A truncated URL keeps scheme and host; with `preserve_path` also its
    path, if the URL without search and fragment is safe. A fragment alone
    is cut off.
    """
    row = lambda result, safe, reason: F.struct(F.lit(result).alias("result"), safe.alias("safe_url"), reason.alias("reason"))
    nothing = F.lit(None).cast("string")

    def verdict(s: Column) -> Column:
        short = F.concat(s["p"]["scheme"], F.lit("://"), s["p"]["host"], F.lit("/" + PROTECTED))
        if preserve_path:
            bare = short
            stem = lambda t: F.when((t["url"] != s["url"]) & t["drop"].isNull() & t["cut"].isNull(), F.concat(t["url"], F.lit(PROTECTED))).otherwise(bare)
            short = urls.let(reasons(urls.strip_search(s["url"]), is_id), stem)
        return (
            F.when(s["drop"].isNotNull(), row("dropped", nothing, s["drop"]))
            .when(s["cut"].isNotNull(), row("truncated", short, s["cut"]))
            .when(s["p"]["fragment"] != "", row("truncated", F.concat(urls.strip_fragment(s["url"]), F.lit(PROTECTED)), F.lit("fragment")))
            .otherwise(row("safe", s["url"], nothing))
        )

    return urls.let(reasons(url, is_id), verdict)


def protect(url: Column, publishable: Column) -> Column:
    """The URL if it may be published or is a bare domain, else its scheme and host."""
    pure = (urls.part(url, "path") == "/") & (urls.part(url, "search") == "") & (urls.part(url, "fragment") == "")
    bare = F.concat(urls.part(url, "scheme"), F.lit("://"), urls.part(url, "host"), F.lit("/" + PROTECTED))
    return F.when(publishable | pure, url).otherwise(bare)


#: The mark of a broken character, the most broken ones of a title, and how much shorter a title may become.
BROKEN, MOST_BROKEN, LEAST_KEPT = "\ufffd", 0.2, 0.75


def _broken_encoding(before: Column, after: Column) -> Column:
    """Whether `before` stands in `after` but for characters beyond ASCII that became broken ones, and these are few."""
    odd = lambda c: F.regexp_replace(c, r"[^\x20-\x7f]", BROKEN)
    at = F.instr(odd(after), odd(before))
    pairs = F.arrays_zip(F.split(before, "").alias("b"), F.split(F.substr(after, at, F.length(before)), "").alias("a"))
    lost = lambda p: (p["b"] != p["a"]) & (p["a"] == BROKEN) & p["b"].rlike(r"[^\x20-\x7f]")
    tolerable = F.forall(pairs, lambda p: (p["b"] == p["a"]) | lost(p))
    few = F.size(F.filter(pairs, lost)) < MOST_BROKEN * F.length(after)
    return F.contains(after, F.lit(BROKEN)) & (at > 0) & tolerable & few & ~F.contains(after, F.lit(BROKEN * 3))


def runs_through(text: Column, part: Column) -> Column:
    """Whether the characters of `part` stand in `text` in their order, with others between."""
    step = lambda n, ch: n + F.when(F.substr(part, n + 1, F.lit(1)) == ch, 1).otherwise(0)
    return F.aggregate(F.split(text, ""), F.lit(0), step) == F.length(part)


def titles_match(before: Column, after: Column) -> Column:
    """Whether a title may be published, given that of the anonymous copy, which is public. False if either is null or empty.

    Equal, but for case and white space too; six characters or more that
    stand in the copy's; the same with a few broken characters; or longer
    than the copy's, from which only small parts were cut. The order matters:
    what only the title before has is not public.
    """
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))

    def judged(t: Column) -> Column:
        b, a = t["b"], t["a"]
        inside = (F.length(b) >= 6) & F.contains(a, b)
        shorter = (F.length(b) > F.length(a)) & (F.length(a) > 12) & (F.length(a) > LEAST_KEPT * F.length(b))
        return (b == a) | inside | (F.contains(a, F.lit(BROKEN)) & _broken_encoding(b, a)) | (shorter & runs_through(b, a))

    given = (F.length(before) > 0) & (F.length(after) > 0)
    return F.coalesce(given & ((before == after) | urls.let(F.struct(norm(before).alias("b"), norm(after).alias("a")), judged)), F.lit(False))


def structure_gate(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Why a page and its anonymous copy differ (fields url, title, noindex); null if they match."""
    return (
        F.when(F.coalesce(before["noindex"], F.lit(False)), "noindex before")
        .when(F.coalesce(after["noindex"], F.lit(False)), "noindex after")
        .when(before["title"].isNull() | after["title"].isNull(), "no title")
        .when(~titles_match(before["title"], after["title"]), "title")
        .when(urls.strip_fragment(before["url"]) != urls.strip_fragment(after["url"]), "url")
    )
