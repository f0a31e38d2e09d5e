"""Tables of examples for the pure functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webtel.functions import classify, codec, html, nested, numbers, sanitize, text, times, urls
from webtel.operators import gates


def values(spark, build, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_long_numbers(spark):
    given_ = ["order 12345678", "call 555 1234", "book 2049-3630", "ean 4006381333931", "ean 4006381333930", "a 1234567890123", "", None]
    assert values(spark, text.has_long_number, given_) == [True, False, False, False, True, True, False, None]


def test_ean_that_ends_in_zero_is_refused(spark):
    assert values(spark, text.is_ean13, ["4006381333931", "0000000000000", "123"]) == [True, False, False]


def test_issn(spark):
    assert values(spark, text.is_issn, ["2049-3630", "20493630", "2049-3631", "0378-595x", "x"]) == [True, True, False, False, False]


def test_suspicious(spark):
    cases = {
        "cheap flights": None,
        "x" * 121: "too long",
        "写" + "a" * 51: "too long with logograms",
        "mail me at jane.doe@mail.test": "email",
        "http://u:p@host": "http password",
        "a" * 46: "long word",
        "Abc1" * 6: "long word of odd shape",
        "Donaudampfschifffahrtsgesellschaft": None,
        "number 123456789": "long number",
    }
    assert values(spark, text.suspicious, list(cases)) == list(cases.values())


def test_urls(spark):
    u = ["https://a.b.co.uk/x?q=1+2&r=%41#f", "http://user:pw@h.test:8080", "ftp://x", "no url", None, "https://10.0.0.1/"]
    assert values(spark, lambda c: urls.part(c, "host"), u) == ["a.b.co.uk", "h.test", "x", None, None, "10.0.0.1"]
    assert values(spark, lambda c: urls.part(c, "path"), u)[:2] == ["/x", "/"]
    assert values(spark, lambda c: urls.query_param(c, "q"), u)[0] == "1 2"
    assert values(spark, lambda c: urls.query_param(c, "r"), u)[0] == "A"
    assert values(spark, lambda c: urls.remove_params(c, ["q"]), u)[0] == "https://a.b.co.uk/x?r=%41#f"
    hosts = ["a.b.co.uk", "x.y.z.example.com", "com", "1.2.3.4", "example.com"]
    assert values(spark, urls.registrable_domain, hosts) == ["b.co.uk", "example.com", None, None, "example.com"]
    assert values(spark, urls.truncate_domain, hosts) == ["a.b.co.uk", "y.z.example.com", "com", "1.2.3.4", "example.com"]


def test_third_party_ignores_the_suffix(spark):
    df = spark.createDataFrame([("shop.com", "shop.de"), ("shop.com", "ads.net"), ("a.com", "a.com"), (None, "a.com")], "a string, b string")
    assert [r.x for r in df.select(urls.is_third_party(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, False, False]


def test_local_ips(spark):
    ips = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "8.8.8.8", "::1", "fd00::1", "2001:db8::1", None]
    assert values(spark, urls.is_local_ip, ips) == [True, True, True, False, True, False, True, True, False, False]


def test_sanitize(spark):
    cases = {
        "https://shop.test/a": ("safe", "https://shop.test/a"),
        "https://u@shop.test/": ("dropped", None),
        "https://shop.test:8443/": ("dropped", None),
        "ftp://shop.test/": ("dropped", None),
        "https://localhost/": ("dropped", None),
        "https://1.2.3.4/": ("dropped", None),
        "no": ("dropped", None),
        "https://shop.test/Wp_Admin": ("truncated", "https://shop.test/ (PROTECTED)"),
        "https://shop.test/?redirect_url=x": ("safe", "https://shop.test/?redirect_url=x"),
        "https://shop.test/?redirect=x": ("truncated", "https://shop.test/ (PROTECTED)"),
        "https://shop.test/a#frag": ("truncated", "https://shop.test/a (PROTECTED)"),
        "https://shop.test/?u=https://x": ("truncated", "https://shop.test/ (PROTECTED)"),
        "https://shop.test/a/b/c/d/e/f/g/h": ("truncated", "https://shop.test/ (PROTECTED)"),
        "https://shop.test/?m=jane%40mail.test": ("truncated", "https://shop.test/ (PROTECTED)"),
        "https://shop.test/?q=" + "x1" * 12: ("truncated", "https://shop.test/ (PROTECTED)"),
    }
    got = values(spark, sanitize.sanitize, list(cases))
    assert [(g.result, g.safe_url) for g in got] == list(cases.values())
    kept = values(spark, lambda c: sanitize.sanitize(c, preserve_path=True), ["https://shop.test/a?redirect=x", "https://shop.test/login?redirect=x"])
    assert [g.safe_url for g in kept] == ["https://shop.test/a (PROTECTED)", "https://shop.test/ (PROTECTED)"]


def test_times(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-01 00:00:00' AS a, TIMESTAMP_NTZ '2024-03-01 20:30:00' AS b")
    r = df.select(times.day(F.col("a")).alias("d"), times.hour(F.col("b")).alias("h"), times.next_midnight(F.col("a")).alias("m"), times.daily_cooldown(F.col("b")).alias("c")).first()
    assert (r.d, r.h, str(r.m), str(r.c)) == ("20240301", "2024030120", "2024-03-02 00:00:00", "2024-03-02 04:30:00")


def test_durations_and_timestamps(spark):
    assert values(spark, text.is_duration, ["PT1H", "P1Y2M", "P", "PT", "1H"]) == [True, True, False, False, False]
    assert values(spark, text.is_timestamp, ["2024", "2024-01-01T10:00:00Z", "20 May", "2024-01-01"]) == [True, True, False, True]


def test_padding_round_trip(spark):
    long = "".join(chr(33 + i * i % 90) for i in range(9000))
    got = values(spark, codec.compress_and_pad, ["x", long, None, "y" * 40000])
    assert len(got[0]) == 1024 and len(got[1]) & (len(got[1]) - 1) == 0 and got[2] is None and got[3] is None
    assert codec.unpad(bytes(got[0])) == "x" and codec.unpad(bytes(got[1])) == long


def test_bloom(spark):
    members = spark.range(0, 200).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("v"))
    other = spark.range(0, 2000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("v"))
    a = codec.bloom_table(members.where("v < 'm5'"), "v", 5, 1 << 14)
    b = codec.bloom_table(members.where("v >= 'm5'"), "v", 5, 1 << 14)
    both = codec.merge_blooms(a, b)
    assert codec.bloom_contains(members, "v", both, 5, 1 << 14).where("not might_contain").count() == 0
    assert codec.bloom_contains(other, "v", both, 5, 1 << 14).where("might_contain").count() < 20


def test_packed_bloom():
    assert codec.read_packed_bloom(b"\0\0\0\2\x05\0\0\0\1\xff\0\0\0")[1].tolist() == [1, 0xFF000000]


def test_headers_and_records(spark):
    df = spark.sql("SELECT array(named_struct('name','A','value','1'), named_struct('name','a','value','2'), named_struct('name','B','value','3')) AS h, array('x','','z') AS p, array('1','2','3') AS q")
    r = df.select(nested.headers(F.col("h")).alias("h"), nested.zip_records({"p": F.col("p"), "q": F.col("q")}, ["p"]).alias("z"), nested.chunks(F.col("q"), 2).alias("c")).first()
    assert r.h == {"a": "2", "B".lower(): "3"} and [x.q for x in r.z] == ["1", "3"] and r.c == [["1", "2"], ["3"]]


def test_first_wins(spark):
    df = spark.sql("SELECT array(map('a','1','b','2'), map('a','1','c','3'), map('b','9')) AS r")
    assert df.select(nested.first_wins(F.col("r")).alias("x")).first().x == {"a": "1", "c": "3"}


def test_template(spark):
    df = spark.sql("SELECT 'x={{cookie:a||param:b}}&y={{none}}' AS t, map('param:b','7') AS v")
    assert df.select(text.fill_template(F.col("t"), F.col("v")).alias("x")).first().x == "x=7&y="


def test_rules_are_validated():
    with pytest.raises(ValueError):
        html.validate_rules({"_meta": {"minVersion": 9}})
    with pytest.raises(ValueError):
        html.validate_rules({"r": {"input": {"a": {"x": ("text", [("nonsense",)])}}}})


@pytest.fixture(scope="module")
def model(spark):
    words = "the quick brown fox jumps over lazy dogs while every other animal watches and nothing else happens around here today"
    return classify.bigram_model(spark.createDataFrame([(words,)] * 3, "t string"), "t", 0.2)


def test_identifiers(spark, model):
    p = classify.mean_probability(model)
    got = values(spark, lambda c: classify.is_identifier(c, p(c), 0.03), ["the", "brownfox", "x7qz9k2vw4", "123e4567-e89b-12d3-a456-426614174000", "123456789", "200x300", "SW1A1AA", None])
    assert got == [False, False, True, True, False, False, False, False]


def test_email_signs_may_be_encoded(spark):
    given_ = ["a@b.c", "a%40b.c", "a%2540b.1", "a%252540b_c.d", "a@b", "@b.c", "x" * 50_000, None]
    assert values(spark, text.has_email, given_) == [True, True, True, True, False, False, False, None]


def test_decoding_goes_on_until_nothing_changes(spark):
    assert values(spark, urls.decode_repeatedly, ["%252525252541", "%25zz", "a+b", "", None]) == ["A", "%zz", "a+b", "", None]


def test_registrable_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.github.io", "b.c.example.com", "localhost", "1.2.3.4", "A.Example.org", "", None]
    assert values(spark, urls.registrable_domain, hosts) == ["b.co.uk", None, "x.github.io", "example.com", None, None, "example.org", None, None]
    assert values(spark, urls.truncate_domain, ["a.b.c.d.example.com", "co.uk", "1.2.3.4", None]) == ["c.d.example.com", "co.uk", "1.2.3.4", None]


def test_search_pages(spark):
    cases = {
        "https://www.google.de/search?q=a+b%2Bc": ("search-go", "a b+c", "https://www.google.de/search?q=a+b%2Bc"),
        "https://www.google.de/search?q=x&udm=2": ("search-goi", "x", "https://www.google.de/search?udm=2&q=x"),
        "https://de.search.yahoo.com/search?p=it's(1)": ("search-ya", "it's(1)", "https://de.search.yahoo.com/search?q=it's(1)"),
        "https://duckduckgo.com/?q=x": ("search-dd", "x", "https://html.duckduckgo.com/html?q=x"),
        "https://www.qwant.com/?t=web&q=y": ("search-qw", "y", "https://www.qwant.com/?q=y"),
        "https://www.google.de/maps?x=1": None,
        "https://example.com/?q=x": None,
        "bad": None,
    }
    got = values(spark, urls.analyse_search, list(cases))
    assert [None if g is None else tuple(g) for g in got] == list(cases.values())


def test_random_parameters(spark):
    fresh, same = values(spark, lambda c: urls.randomised_params(c, ["q"], c), ["https://a.com/?q=old&b=1#f", "https://a.com/?b=1"])
    assert same == "https://a.com/?b=1" and fresh.startswith("https://a.com/?q=") and fresh.endswith("&b=1#f") and "old" not in fresh


def test_requested_names(spark):
    allowed = F.array(F.lit("a"), F.lit("z"))
    build = lambda c: text.requested_names(F.array(c, F.lit("{{safecookie:z}}")), "safecookie:", allowed)
    assert values(spark, build, ["x={{safecookie:a||safecookie:no}} {{cookie:a}}", ""]) == [["a", "z"], ["z"]]


def test_base64(spark):
    assert values(spark, lambda c: text.from_base64(text.to_base64(c)), ["é", "", None]) == ["é", "", None]
    assert values(spark, text.from_base64, ["!!", "/w=="]) == [None, None]


RULES = {
    "r": {
        "prune": [{"first": "p"}],
        "input": {
            "h1": {"first": {"t": {"select": "b", "attr": "text"}, "q": {"firstMatch": [{"select": "i", "attr": "text"}, {"select": "u", "attr": "text", "transform": [["trim"]]}]}}},
            "li > a": {"all": {"href": ("href", [("require_url",)]), "label": ("text", [])}},
        },
        "output": {
            "one": {"fields": [{"key": "t", "source": "h1"}, {"key": "q", "source": "h1", "optional": True}, {"key": "none"}], "deduplicateBy": "t"},
            "list": {"fields": [{"key": "results", "source": "li > a", "requiredKeys": ["href"]}], "omitIfExistsAny": ["one"]},
            "always": {"fields": [{"key": "results", "source": "li > a"}, {"key": "qurl"}]},
        },
    }
}


def test_messages_of_rules(spark):
    pages = [
        (1, "http://e.com/", "<h1><b>T</b><p><b>no</b></p><u> z </u></h1><ul><li><a href='/p'>P</a><li><a href='http://['>bad</a></ul>"),
        (2, "http://e.com/", "<li><a href='q'></a>"),
        (3, None, None),
        (4, "u", ""),
    ]
    df = spark.createDataFrame(pages, "id int, url string, html string")
    got = [(r.id, r.action, r.payload, r.deduplicate_by) for r in html.messages(df, RULES, {"qurl": "url"}).orderBy("id", "action").collect()]
    assert got == [
        (1, "always", '{"results":{"0":{"href":"http://e.com/p","label":"P"}},"qurl":"http://e.com/"}', ""),
        (1, "one", '{"t":"T","q":"z"}', "t"),
        (2, "list", '{"results":{"0":{"href":"http://e.com/q","label":""}}}', ""),
    ]


def test_unknown_sources_are_refused():
    with pytest.raises(ValueError):
        html.validate_rules({"r": {"input": {"a": {"x": ("text", [])}}, "output": {"m": {"fields": [{"key": "x", "source": "b"}]}}}})


def test_coprime():
    assert numbers.pairwise_coprime([4, 9, 25]) and not numbers.pairwise_coprime([6, 9])


def test_fetch_requests():
    rule = {"followRedirects": True, "emptyHtml": False, "timeout": 0, "onError": {"headers": {"a": "b"}, "onError": {"timeout": 5}}}
    assert gates.fetch_request(rule, "u") == {"url": "u", "redirect": "follow", "emptyHtml": False, "onError": {"headers": {"a": "b"}, "onError": {"timeout": 5}}}
    assert gates.fetch_request({}, "u") == {"url": "u"}


def test_deep_equality_and_nulls(spark):
    df = spark.sql("SELECT struct(1 AS a, array(2, NULL) AS b) AS x, struct(1 AS a, array(2, NULL) AS b) AS y, struct(CAST(NULL AS INT) AS a, array(2) AS b) AS z")
    r = df.select(nested.provably_equal(F.col("x"), F.col("y")).alias("same"), nested.provably_equal(F.col("x"), F.col("z")).alias("other"), nested.without_nulls(F.col("z")).alias("j")).first()
    assert (r.same, r.other, r.j) == (True, False, '{"b":[2]}')
