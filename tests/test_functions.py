"""URL, type, timing and name functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from siteaudit.functions import text, timing, urls

JOINS = [
    ("https://foo.com/a/b", "/x", "https://foo.com/x"), ("https://foo.com/a/b?q#z", "c d", "https://foo.com/a/c%20d"), ("https://foo.com", "x\ty\n", "https://foo.com/xy"),
    ("https://foo.com/a/b/", "../é/./z", "https://foo.com/a/%C3%A9/z"), ("https://foo.com/", "https:/p", "https://foo.com/p"), ("http://foo.com/", "https:/p.com/q", "https://p.com/q"),
    ("https://foo.com/x?y", "#f", "https://foo.com/x?y#f"), ("https://foo.com/x?y#k", "", "https://foo.com/x?y"), ("https://foo.com/x?y", "?z='1'", "https://foo.com/x?z=%271%27"),
    ("https://foo.com/", "//BAR.com:443/k", "https://bar.com/k"), ("https://foo.com/", "mailto:a b@c", "mailto:a b@c"), ("https://foo.com/", "https://", None), ("https://foo.com/", "http://a b/", None),
    ("https://foo.com/a/b", "..\\q", "https://foo.com/q"), ("https://foo.com/", "https://x.com:99999/", None), ("https://foo.com/", "http://x.com:65536/", None), ("https://foo.com/", "http://x.com:65535", "http://x.com:65535/"), ("https://foo.com/", "http://x.com:00000000081/", "http://x.com:81/"), ("https://foo.com/", "http://x.com:99999999999/", None), ("https://foo.com/a/b/c", "../..", "https://foo.com/"), ("https://f.com/a", "x#", "https://f.com/x#"),
    ("https://f.com/a", "/𝄞", "https://f.com/%F0%9D%84%9E"), (None, "https://a.b", "https://a.b/"), (None, "x", None), ("data:x,y", "#q", "data:x,y#q"), ("https://foo.com/", "  /t  ", "https://foo.com/t"),
    ("https://u:p@foo.com:8080/a", "b", "https://u:p@foo.com:8080/b"), ("https://foo.com/a", None, None),
]


def test_resolve_url(spark):
    df = spark.createDataFrame([(b, h) for b, h, _ in JOINS], "b string, h string")
    got = [r[0] for r in df.select(urls.resolve_url(F.col("b"), F.col("h"))).collect()]
    assert got == [w for _, _, w in JOINS]


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_url_parts(spark):
    p = value(spark, urls.url_parts(F.lit("HTTPS://u@Foo.com:8443/a/b?c=d#e#f")))
    assert (p.scheme, p.host, p.port, p.path, p.query, p.fragment, p.origin) == ("https", "foo.com", 8443, "/a/b", "c=d", "e#f", "https://foo.com:8443")
    assert value(spark, urls.url_parts(F.lit(None).cast("string"))) is None
    for port, want in (("99999999999", None), ("0000000000080", 80), ("", None), ("65536", 65536)):
        assert value(spark, urls.url_parts(F.lit(f"http://h:{port}/"))["port"]) == want


@pytest.mark.parametrize(("url", "want"), [("data:x", "data"), ("HTTP://x", "document"), ("mailto:x", "other"), (None, None)])
def test_link_class(spark, url, want):
    assert value(spark, urls.link_class(F.lit(url).cast("string"))) == want


def test_truncate_url(spark):
    long = "DATA:" + "x" * 80
    assert value(spark, urls.truncate_url(F.lit(long))) == long[:64] + "..."
    assert value(spark, urls.truncate_url(F.lit("https://" + "x" * 80))) == "https://" + "x" * 80


@pytest.mark.parametrize(("span", "ms"), [("500ms", 500), ("30s", 30_000), ("1w", 604_800_000), ("5", None), ("x", None)])
def test_duration(spark, span, ms):
    assert value(spark, timing.duration_ms(F.lit(span))) == ms


def test_backoff(spark):
    delays = timing.backoff_schedule(F.lit(500), F.lit(2.0), F.lit(300), F.lit(4))
    assert value(spark, delays) == [500.0, 300.0, 300.0, 300.0]  # the first delay has no cap
    assert value(spark, timing.backoff_schedule(F.lit(100), F.lit(0.0), F.lit(None), F.lit(3))) == [100.0, 0.0, 0.0]
    assert value(spark, timing.backoff_schedule(F.lit(100), F.lit(2.0), F.lit(None), F.lit(0))) == []


TYPES = [
    (None, "css", "css", None), ("text/css", "css", "css", None), ("Text/Html", "css", None, "content_type_invalid"), ("application/xml", "sitemap", "sitemap", None), ("text/xml", "sitemap", "sitemap", None),
    ("text/plain", "robots", "robots", None), ("image/svg+xml", None, "svg", None), ("image/png", None, None, None), (None, None, None, None), ("text/plain", "sitemap", None, "content_type_invalid"),
]


def test_document_type(spark):
    df = spark.createDataFrame([(m, h) for m, h, _, _ in TYPES], "m string, h string")
    assert [tuple(r[0]) for r in df.select(text.document_type(F.col("m"), F.col("h"))).collect()] == [(d, e) for _, _, d, e in TYPES]


def test_media_type(spark):
    assert value(spark, text.media_type(F.create_map(F.lit("content-type"), F.lit(" Text/HTML ; charset=x")))) == "Text/HTML"
    assert value(spark, text.media_type(F.create_map(F.lit("x"), F.lit("y")))) is None


def test_values(spark):
    literals = F.array(F.struct(F.lit("ci").alias("match"), F.lit("yes").alias("literal")), F.struct(F.lit("token").alias("match"), F.lit("a b").alias("literal")))
    ok = lambda mode, v: value(spark, text.value_matches(F.lit(mode), literals, F.lit(v)))
    assert ok("any", "zzz") and ok("literal", "YES") and ok("literal", "  a \n b ") and ok("token_list", "no yes")
    assert not ok("literal", "no yes") and not ok("token_list", "no")


@pytest.mark.parametrize(("pattern", "name", "want"), [("data-*", "data-x", True), ("data-*", "dat", False), (":*", "plain", True), (":*", "x:y", False), ("href", "href", True)])
def test_wildcards(spark, pattern, name, want):
    assert value(spark, text.wildcard_match(F.lit(pattern), F.lit(name))) is want


def test_messages(spark):
    none = F.lit(None).cast("string")
    say = lambda kind, **k: value(spark, text.error_message(F.lit(kind), *(k.get(n, none) for n in ("status", "scheme", "fragment", "expected", "actual"))))
    assert say("http_status", status=F.lit(404)) == "invalid status 404 Not Found"
    assert say("invalid_scheme", scheme=F.lit("http")) == 'invalid scheme "http"'
    assert say("element_not_found", fragment=F.lit("x")) == "element for #x not found"
    assert say("content_type_invalid", expected=F.lit("css"), actual=F.lit("Text/Html")) == "content type expected css but got Text/Html"
