"""Checks of free text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtel.functions.urls import let

#: Common Chinese characters, kana, Hangul syllables, Thai.
LOGOGRAMS = "[一-鿿぀-ヿ가-힯฀-๿]"
#: Fixed value: what looks like an address, with a sign that may be percent-encoded, more than once too. It may be found
#: where there is none, but is never missed. The look-behind only keeps long runs from being tried at every character.
EMAIL = r"(?i)(?<![a-z0-9_@-])[a-z0-9_@-]+(?:@|%40|%(?:25)+40)[a-z0-9_-]+\.[a-z0-9_-]"
ISSN = "[0-9]{4}-?[0-9]{3}[0-9xX]"
#: A password in a URL, and long words that are still words.
HTTP_PASSWORD = "[^:]+:[^@]+@"
PLAIN_WORD = "^[a-zA-ZäöüéÄÖÜ][a-zäöüéß]+$"


def has_logograms(c: Column) -> Column:
    return c.rlike(LOGOGRAMS)


def has_email(c: Column) -> Column:
    """Also text that only looks like an address."""
    return c.rlike(EMAIL)


def _digit(c: Column, i: int) -> Column:
    return F.try_to_number(F.substring(c, i, 1), F.lit("9")).cast("int")


def is_ean13(c: Column) -> Column:
    """EAN-13 with a valid check digit other than 0: codes that end in a valid 0 are refused."""
    weighted = sum((_digit(c, i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    return F.coalesce(c.rlike("^[0-9]{13}$") & (10 - weighted % 10 == _digit(c, 13)), F.lit(False))


def is_issn(c: Column) -> Column:
    bare = F.replace(c, F.lit("-"), F.lit(""))
    last = F.when(F.upper(F.substring(bare, 8, 1)) == "X", 10).otherwise(_digit(bare, 8))
    total = sum((_digit(bare, i) * (9 - i) for i in range(1, 8)), F.lit(0)) + last
    return F.coalesce(c.rlike(f"^{ISSN}$") & (total % 11 == 0), F.lit(False))


def has_long_number(c: Column) -> Column:
    """More than seven digits in a row, once everything but letters and digits is gone.

    The first ISSN does not count, and a single EAN-13 is fine.
    """
    issn = F.get(F.filter(F.split(c, " "), is_issn), F.lit(0))
    rest = let(issn, lambda i: F.when(i.isNotNull(), F.replace(c, i, F.lit(" "))).otherwise(c))

    def of_runs(x: Column) -> Column:
        only = F.when(F.size(x["runs"]) == 1, F.get(x["runs"], F.lit(0)))
        single = F.coalesce((F.length(only) == 13) & F.contains(x["rest"], only), F.lit(False))
        return F.when(single, ~is_ean13(only)).otherwise(F.exists(x["runs"], lambda d: F.length(d) > 7))

    def of_rest(r: Column) -> Column:
        digits = F.split(F.trim(F.regexp_replace(F.regexp_replace(r, "[^A-Za-z0-9]", ""), "[^0-9]+", " ")), " ")
        return let(F.struct(r.alias("rest"), F.filter(digits, lambda d: F.length(d) > 2).alias("runs")), of_runs)

    return let(rest, of_rest)


def suspicious(c: Column) -> Column:
    """Why a search query may hold personal data; null if it is fine or null."""
    return let(F.regexp_replace(c, r"[ \t\n\r\f]+", " "), _suspicious)


def _suspicious(q: Column) -> Column:
    words = F.split(q, " ")
    many = F.size(words) > 9
    return (
        F.when(F.length(q) > 120, "too long")
        .when((F.length(q) > 50) & has_logograms(q), "too long with logograms")
        .when(many & (F.size(F.filter(words, lambda w: F.length(w) >= 4)) > 16), "too many words")
        .when(many & has_logograms(q), "too many words with logograms")
        .when(has_long_number(q), "long number")
        .when(has_email(q), "email")
        .when(q.rlike(HTTP_PASSWORD), "http password")
        .when(F.exists(words, lambda w: F.length(w) > 45), "long word")
        .when(F.exists(words, lambda w: (F.length(w) > 20) & ~w.rlike(PLAIN_WORD)), "long word of odd shape")
    )


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars: Column) -> Column:
        count = lambda ch: F.size(F.filter(chars, lambda x: x == ch)).cast("double")
        total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, ch: a + let(count(ch), lambda n: n * F.log2(n)))
        return F.log2(F.size(chars)) - total / F.size(chars)

    return let(F.split(c, ""), of)


def share(c: Column, pattern: str) -> Column:
    """Share of characters that a class matches."""
    return F.when(F.length(c) > 0, (F.length(c) - F.length(F.regexp_replace(c, pattern, ""))) / F.length(c)).otherwise(0.0)


def language(c: Column, allowed: tuple[str, ...]) -> Column:
    """The part before the first hyphen, in lower case, if allowed; else two hyphens."""
    lang = F.lower(F.split_part(c, F.lit("-"), F.lit(1)))
    return F.when(lang.isin(*allowed), lang).otherwise("--")


def is_timestamp(c: Column) -> Column:
    """Strings that may be a date with or without a time."""
    return c.rlike(r"^(?=.{4,40}$)[0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$")


def is_duration(c: Column) -> Column:
    """ISO 8601 durations of at most 20 characters."""
    return c.rlike(r"^(?=.{3,20}$)P(?!$)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+W)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?$")


def is_hostname(c: Column) -> Column:
    return c.rlike("^(?:[a-zA-Z0-9-]+\\.)*[a-zA-Z0-9-]+$")


def includes_inside(c: Column, char: str) -> Column:
    """Whether a character stands in a text other than at its ends."""
    return F.instr(F.substring(F.trim(c), 2, F.greatest(F.length(F.trim(c)) - 2, F.lit(0))), F.lit(char)) > 0


def country(c: Column, allowed: tuple[str, ...]) -> Column:
    """A country code from an allow list; others become two hyphens."""
    return F.when(c.isin(*allowed), c).otherwise("--")


def fill_template(template: Column, values: Column) -> Column:
    """{{a||b}} replaced by the first of the named values in a map that is not empty; unresolved ones by nothing."""
    slots = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1)))
    found = lambda s: F.get(F.filter(F.transform(F.split(s, r"\|\|"), lambda n: F.try_element_at(values, F.trim(n))), lambda v: F.length(v) > 0), F.lit(0))
    return F.aggregate(slots, template, lambda out, s: F.replace(out, F.concat(F.lit("{{"), s, F.lit("}}")), F.coalesce(found(s), F.lit(""))))


def requested_names(templates: Column, prefix: str, allowed: Column) -> Column:
    """Sorted names that placeholders of an array of templates ask for behind a prefix, as far as they are allowed."""
    slots = F.flatten(F.transform(templates, lambda t: F.regexp_extract_all(t, F.lit(r"\{\{([^{}]*)\}\}"), F.lit(1))))
    wanted = F.flatten(F.transform(slots, lambda s: F.split(s, r"\|\|")))
    names = F.transform(F.filter(wanted, lambda w: F.startswith(w, F.lit(prefix))), lambda w: F.substr(w, F.lit(len(prefix) + 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.array_contains(allowed, n))))


def to_base64(c: Column) -> Column:
    return F.base64(F.encode(c, "utf-8"))


def from_base64(c: Column) -> Column:
    """The text of a Base64 value; null if it is none."""
    return F.try_validate_utf8(F.try_to_binary(c, F.lit("base64")).cast("string"))


def fast_hash(c: Column, bits: int = 53) -> Column:
    """A hash of so many bits, for use inside one job only."""
    return F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
