import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlweave.functions import numeric as N
from crawlweave.functions import text as T
from crawlweave.functions import urls as U
from crawlweave.functions.html import anchors

U.add_suffixes("co.example")  # the invented network of the tests


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(expr.alias("r")).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://www.Example.com/a", "example.com"),
        ("https://user:pw@shop.example.co.uk:8080/x?y", "example.co.uk"),
        ("http://a.b.c.co.example/", "c.co.example"),
        ("http://192.0.2.7/x", ""),
        ("http://localhost/", ""),
        ("no address", ""),
        (None, None),
    ],
)
def test_registered_domain(spark, url, want):
    assert one(spark, U.registered_domain(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Ex.com/A?b=2&a=1#f", "http://ex.com/A?a=1&b=2"),
        ("http://ex.com", "http://ex.com/"),
        ("http://ex.com/?", "http://ex.com/"),
        ("mailto:A@b.c", "mailto:A@b.c"),
        ("", ""),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, U.canonical(F.col("u")), u=url) == want


def test_path_query(spark):
    assert one(spark, U.path_query(F.col("u")), u="http://example.com/foo/bar?k=v&egg=spam#id9") == "/foo/bar?k=v&egg=spam"
    assert one(spark, U.path_query(F.col("u")), u="http://example.com/A%20b+c") == "/a b c?"


def test_js_target(spark):
    assert one(spark, U.js_target(F.col("u")), u="javascript:location.href='/x'") == "/x"
    assert one(spark, U.js_target(F.col("u")), u='foo; location.href="/y"') == "/y"
    assert one(spark, U.js_target(F.col("u")), u="javascript:void(0)") is None


@pytest.mark.parametrize("href", ["/x", "x", "?q=1", "#f", "//h.test/y", "http://o.test/z", "", "a/b?c"])
def test_resolve_forms_agree(spark, href):
    for base in ("http://ex.com/a/b?c=d", "http://ex.com"):
        df = spark.createDataFrame([(base, href)], "b string, h string")
        a, b = df.select(U.resolve(F.col("b"), F.col("h")), U.resolve_exact(F.col("b"), F.col("h"))).first()
        assert a.rstrip("/#?") == b.rstrip("/#?")


def test_ignored_extension_and_base(spark):
    assert one(spark, U.ignored_extension(F.col("u")), u="http://a.b/x.PDF?y=.html")
    assert not one(spark, U.ignored_extension(F.col("u")), u="http://a.pdf/x")
    df = spark.createDataFrame([("<head><base href='http://o.test/'>", "http://a.b/")], "h string, u string")
    assert df.select(U.base_url(F.col("h"), F.col("u"))).first()[0] == "http://o.test/"


def test_priorities(spark):
    assert one(spark, N.score_to_priority(F.col("x")), x=0.99999) == 9999
    assert one(spark, N.score_to_priority(F.col("x")), x=-0.55559) == -5555
    assert one(spark, N.reschedule_interval(F.col("x")), x=1_000_000) == int(1_000_000 / 30000 / (0.33 / 0.67) / 0.1)
    assert [one(spark, N.batch_size(F.col("x")), x=n) for n in (5, 2500, 10**7)] == [1, 2, 1000]
    assert one(spark, N.top2_margin(F.array(F.lit(0.2), F.lit(0.9), F.lit(0.5)))) == pytest.approx(0.4)
    assert one(spark, N.top2_margin(F.array(F.lit(0.2)))) is None


def test_softmax(spark):
    df = spark.createDataFrame([(-2.85,), (0.86,), (0.28,)], "z double")
    w = Window.partitionBy(F.lit(1))
    e = df.select("z", N.softmax_weight(F.col("z"), w).alias("e"))
    got = {round(r.z, 2): r.p for r in e.select("z", (F.col("e") / F.sum("e").over(w)).alias("p")).collect()}
    assert got[-2.85] == pytest.approx(0.015, abs=1e-3) and got[0.86] == pytest.approx(0.631, abs=1e-3) and got[0.28] == pytest.approx(0.353, abs=1e-3)


def test_ngrams_and_relevancy(spark):
    df = spark.createDataFrame([("A good page, a GOOD one",), ("",), (None,)], "t string")
    grams = [r[0] for r in df.select(T.ngrams(T.tokens(F.lower("t")), 2)).collect()]
    assert grams[0][:3] == ["a", "good", "page"] and "good page" in grams[0] and grams[1] == [] and grams[2] == []
    pos, neg = T.parse_keywords(["good", "awesome", "-bad", "", " "])
    assert (pos, neg) == (["good", "awesome"], ["bad"]) and T.max_ngram(["foo", "foo bar baz"]) == 3 and T.max_ngram([]) == 1
    score = [r[0] for r in df.select(T.relevancy(F.col("t"), pos, neg)).collect()]
    assert score[0] == pytest.approx(math.log(2) / math.log(3)) and score[1:] == [0.0, 0.0]
    assert df.select(T.relevancy(F.col("t"), [], ["good"])).first()[0] == 0.0


def test_char_ngrams(spark):
    assert sorted(one(spark, T.char_ngrams(F.col("t"), 3, 4), t="abcab")) == ["abc", "abca", "bca", "bcab", "cab"]
    assert one(spark, T.char_ngrams(F.col("t"), 3, 5), t="ab") == []


def test_html_text(spark):
    assert one(spark, T.html_text(F.col("h")), h="<p>A&amp;B<script>x<y</script><!-- c --> C</p>") == "a&b c"


def test_anchors():
    page = "<A HREF='/a' title=\"x>y\">one <b>two</b><a href=/b><img alt='pic'> t</a><a>no</a><script><a href='/no'></script><a href='/c'>unclosed"
    assert anchors(page) == [(0, "/a", [("title", "x>y")], "one two"), (1, "/b", [], "t pic"), (2, "/c", [], "unclosed")]
    assert anchors("") == []


def test_relative_addresses_as_the_standard_library_resolves_them(spark):
    from urllib.parse import urljoin

    bases = ["http://a.test/a/b.html", "http://a.test", "http://a.test/a/b/?q=/x/y", "http://a.test/a/"]
    hrefs = ["./y", "../x", "../../../x", "y?z=../..", "/p/./q/../r", "//o.test/x", "#f", "?k", "", "http://x.test/", "a/../b/.", "..", "."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    got = df.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("r")).collect()
    assert [(r.b, r.h, r.r) for r in got] == [(b, h, urljoin(b, h)) for b in bases for h in hrefs]


def test_canonical_escapes_and_ports(spark):
    want = {
        "HTTP://A.test:80/%7euser/%c3%a9?b=%41&a=1#f": "http://a.test/~user/%C3%A9?a=1&b=A",
        "https://a.test:443": "https://a.test/",
        "https://a.test:80/x": "https://a.test:80/x",
        "http://a.test:8080/": "http://a.test:8080/",
        "http://a.test/a b?%zz=%2f&&": "http://a.test/a%20b?%zz=%2F",
        "http://b.test/100%": "http://b.test/100%",
    }
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.c for r in df.select("u", U.canonical(F.col("u")).alias("c")).collect()} == want


def test_registry_suffixes(spark):
    want = {"http://x.foo.co.id/": "foo.co.id", "http://foo.com.br": "foo.com.br", "http://co.uk": "", "http://a.b.example.com": "example.com", "http://a.co.de": "co.de", "http://10.0.0.1/": ""}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.d for r in df.select("u", U.registered_domain(F.col("u")).alias("d")).collect()} == want
