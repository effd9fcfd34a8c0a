"""Small sites and hand-written rows for the operators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from siteaudit.operators import check, crawl, elements, extract, markup, redirects, report, requestlog, robots, store
from siteaudit.plans import queries
from siteaudit.plans.audit import page_links, site_audit, site_markup
from siteaudit.sources.scratch import cleared, scratch, small
from siteaudit.sources.tables import read_responses, read_sites, write_report_json, write_report_text, write_store
from siteaudit.streaming import jobs

HTML = {"content-type": "text/html"}
ROOT = "https://foo.com/"


def responses_of(spark, rows):
    """rows: url, status, headers."""
    return spark.createDataFrame([(u, s, h, None) for u, s, h in rows], "url string, status int, headers map<string,string>, request_error string")


def audit(spark, docs, responses, sites=None, **more):
    """(documents ok, failed, items ok, failed) and the kinds of errors."""
    body = spark.createDataFrame(docs, "url string, doc_type string, body string")
    checked, metrics = site_audit(body, responses_of(spark, responses), read_sites(spark, sites or []), **more)
    run = report.run_metrics(metrics).first()
    return (run.documents_ok, run.documents_failed, run.items_ok, run.items_failed), sorted(r.error_kind for r in check.broken_links(checked).collect())


def page(body, url=ROOT):
    return (url, "html", body)


def test_linked_pages_and_cycle(spark):
    known = [(ROOT, 200, HTML), (ROOT + "bar", 200, HTML)]
    assert audit(spark, [page('<a href="bar"/>'), page("", ROOT + "bar")], known) == ((2, 0, 1, 0), [])
    assert audit(spark, [page('<a href="bar"/>'), page('<a href="/"/>', ROOT + "bar")], known) == ((2, 0, 2, 0), [])


BASED = [("/b/", ROOT + "b/x"), ("c/", ROOT + "a/c/x"), ("https://bar.com/d/", "https://bar.com/d/x"), ("https://", None), (None, ROOT + "a/x")]


def test_links_go_to_the_base(spark, tmp_path):
    rows = [(f"{ROOT}a/{i}", ("" if b is None else f'<base target="_top" href="{b}"><base href="/late/">') + '<a href="x">t</a>') for i, (b, _) in enumerate(BASED)]
    pages, want = spark.createDataFrame(rows, "url string, html string"), sorted((u, t) for (u, _), (_, t) in zip(rows, BASED))
    assert sorted((r.doc_url, r.target) for r in page_links(pages).collect()) == want
    twice = spark.createDataFrame(rows + rows, "url string, html string")
    assert sorted((r.doc_url, r.target) for r in page_links(twice).collect()) == sorted(want + want)
    path = str(tmp_path / "pages.parquet")
    ids = spark.createDataFrame([(u, k) for (u, _), k in zip(rows, (1, 2, 3, 5, 6))], "url string, page_id long")  # to which the query adds no base of its own
    pages.join(ids, "url").write.parquet(path)
    assert sorted((r.doc_url, r.target) for r in queries.q_resolve_url(spark, str(tmp_path)).collect()) == want
    targets = spark.createDataFrame([(t, t, 200, "text/html", None, None, True) for t in {t for _, t in want if t}], "url string, final_url string, status int, media string, request_error string, redirect_error string, allowed boolean")
    out = scratch(spark, "checked")
    jobs.run(jobs.stream_results(jobs.read_stream(spark, path, pages.schema), targets, read_sites(spark, [])), out, scratch(spark, "state"))
    assert sorted((r.doc_url, r.target, r.ok) for r in spark.read.parquet(out).collect()) == [(*w, w[1] is not None) for w in want]


def test_fragments(spark):
    known = [(ROOT, 200, HTML)]
    assert audit(spark, [page('<a href="#x"/><div id="x"/>')], known) == ((1, 0, 1, 0), [])
    assert audit(spark, [page('<a href="#x"/>')], known) == ((0, 1, 0, 1), ["element_not_found"])
    assert audit(spark, [page('<a href="#x"/>')], known, [{"host": "foo.com", "site": "s", "ignored_fragments": ["x|y"]}]) == ((1, 0, 1, 0), [])
    assert audit(spark, [page('<a href="#"/>')], known)[1] == ["element_not_found"]


def test_schemes_and_ignored(spark):
    known = [("http://foo.com/", 200, HTML)]
    https = [{"host": "foo.com", "site": "s", "schemes": ["https"]}]
    doc = [page('<a href="http://foo.com/"/>')]
    assert audit(spark, doc, known, https) == ((0, 1, 0, 1), ["invalid_scheme"])
    assert audit(spark, doc, known, https, ignored=["foo\\.com"]) == ((1, 0, 1, 0), [])
    assert audit(spark, [page('<a href="mailto:x"/><a href="https://"/>')], known) == ((0, 1, 1, 1), ["url_parse"])


def test_redirects_statuses_and_types(spark):
    known = [(ROOT + "a", 301, {"location": "b"}), (ROOT + "b", 302, {"location": "/c"}), (ROOT + "c", 200, HTML), (ROOT + "d", 301, {}), (ROOT + "e", 302, {"location": "e"}), (ROOT + "g", 404, HTML), (ROOT + "s", 200, HTML)]
    doc = [page("".join(f'<a href="{x}"/>' for x in "abcdefg") + '<link rel="stylesheet" href="s">')]
    assert audit(spark, doc, known) == ((0, 1, 3, 5), ["content_type_invalid", "http_status", "missing_response", "redirect_location", "too_many_redirects"])
    assert audit(spark, [page('<a href="a"/>')], known, max_redirects=1)[1] == ["too_many_redirects"]


def test_robots_blocked_link_is_ok(spark):
    docs = spark.createDataFrame([(ROOT + "robots.txt", "User-agent: *\nDisallow: /bar\n")], "url string, robots string")
    assert audit(spark, [page('<a href="bar"/>')], [(ROOT + "bar", 404, HTML)], rules=robots.robots_rules(docs)) == ((1, 0, 1, 0), [])


def test_sitemap_and_css_documents(spark):
    docs = [(ROOT + "robots.txt", "robots", f"Sitemap: {ROOT}map.xml"), (ROOT + "map.xml", "sitemap", f"<urlset><url><loc>{ROOT}p</loc></url></urlset>"), (ROOT + "s.css", "css", '@import "t.css"; p { a: url(i.png) }')]
    known = [(ROOT + "map.xml", 200, {"content-type": "text/xml"}), (ROOT + "p", 200, HTML), (ROOT + "t.css", 200, {"content-type": "text/css"}), (ROOT + "i.png", 200, {"content-type": "image/png"})]
    assert audit(spark, docs, known) == ((3, 0, 4, 0), [])


SRCSETS = [("a.png", ["a.png"]), ("a.png 1x, b.png 2x", ["a.png", "b.png"]), (" ,a.png,, b.png ,", ["a.png", "b.png"]), ("data:image/png;base64,AA,BB 2x,c", ["data:image/png;base64,AA,BB", "c"]), ("a.png,", ["a.png"]), ("", []), (" , ", [])]


def test_srcset(spark):
    df = spark.createDataFrame([(s,) for s, _ in SRCSETS], "s string")
    assert [r[0] for r in df.select(extract.srcset_urls(F.col("s"))).collect()] == [w for _, w in SRCSETS]


def test_tags(spark):
    html = """<!-- <a href="no"> --><script>var a = '<a href="no">'</script><A HREF='x&amp;y' data-b="1>2"><img src=plain srcset="q 1x"><link rel="preconnect" href="no"><meta property="og:image" content="m">"""
    tags = extract.start_tags(spark.createDataFrame([("u", html), ("v", None)], "url string, html string"))
    assert [r.name for r in tags.orderBy("ord").collect()] == ["script", "a", "img", "link", "meta"]
    one = sorted(r.raw for r in extract.html_links(tags).collect())
    kinds = [extract.href_links, extract.src_links, extract.srcset_links, extract.link_element_links, extract.meta_links]
    assert one == ["m", "plain", "q", "x&y"] == sorted(r.raw for f in kinds for r in f(tags).collect())


def test_data_svgs(spark):
    rows = ["data:image/svg+xml,%3Csvg/%3E#a", "data:image/svg+xml,%3Csvg/%3E#b", "DATA:image/SVG+xml;charset=utf-8;base64,PHN2Zy8+".replace("DATA", "data"), "data:image/svg+xml;base64,***", "data:text/plain,x", "data:image/svg+xml,%FF"]
    got = extract.data_svg_documents(spark.createDataFrame([(r,) for r in rows], "target string")).collect()
    assert sorted((r.body or "", r.error or "") for r in got) == [("", "data_url"), ("", "data_url"), ("<svg/>", ""), ("<svg/>", "")]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: SiteAudit\nDisallow: /x\nAllow: /x/y\nDisallow: /*.gif$\nUser-agent: *\nDisallow: /"
    rules = robots.robots_rules(spark.createDataFrame([(ROOT + "robots.txt", body)], "url string, robots string"))
    paths = {"x/z": False, "x/y/q": True, "a.gif": False, "a.gif?b": False, "a.gifs": True, "q": True, "robots.txt": True, "x?y": False}
    got = robots.robots_filter(spark.createDataFrame([(ROOT + p,) for p in paths], "url string"), rules).collect()
    assert {r.url.removeprefix(ROOT): r.allowed for r in got} == paths
    other = robots.robots_rules(spark.createDataFrame([(ROOT + "robots.txt", body)], "url string, robots string"), "other")
    assert [(r.allow, r.pattern) for r in other.collect()] == [(False, "/")]


def test_elements(spark):
    html = "<html><head><title>t</title><body><p><b>one<p>two<ul><li>a<li>b</ul><br>x<svg xmlns:xlink='x'><a/></svg></html>"
    rows = elements.elements(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("ord").collect()
    assert [(r.name, r.parent_ord) for r in rows] == [("html", None), ("head", 0), ("title", 1), ("body", 0), ("p", 3), ("b", 4), ("p", 3), ("ul", 3), ("li", 7), ("li", 7), ("br", 3), ("svg", 3), ("a", 11)]
    assert rows[3].children == ["p", "p", "ul", "br", "#text", "svg"] and rows[11].namespace == elements.SVG_NS


def test_tags_without_values_and_open_comments(spark):
    html = """<a href id=k><input disabled value=x/y data-a='1>2' checked><a href=/q?a=b&#38;c=&eacute;&#x2f;&#128;&nope;&amp;amp;><!-- <a href="/no">"""
    tags = extract.start_tags(spark.createDataFrame([("u", html)], "url string, html string")).orderBy("ord").collect()
    assert [[tuple(a) for a in r.attributes] for r in tags] == [[("href", ""), ("id", "k")], [("disabled", ""), ("value", "x/y"), ("data-a", "1>2"), ("checked", "")], [("href", "/q?a=b&c=é/€&nope;&amp;")]]
    assert [r.target for r in page_links(spark.createDataFrame([(ROOT + "d?e#f", html)], "url string, html string")).orderBy("ord").collect()] == [ROOT + "d?e", ROOT + "q?a=b&c=%C3%A9/%E2%82%AC&nope;&amp;"]
    signs = [("&#0;&#xD800;&#x110000;", "\ufffd" * 3), ("&lt;&#x1F600;&NotEqualTilde;", "<\U0001f600\u2242\u0338"), ("a&b &#; &copy=1", "a&b &#; &copy=1"), ("", ""), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in signs], "t string").select(extract.decode_entities(F.col("t"))).collect()] == [w for _, w in signs]


def test_a_bad_base_fails_its_document(spark):
    assert audit(spark, [page('<base href="https://"><a href="x">t</a>')], [(ROOT + "x", 200, HTML)]) == ((0, 1, 0, 1), ["url_parse"])


DATA = "data:image/svg+xml,"


def test_links_in_data_svgs(spark):
    known = [(ROOT + "x", 200, HTML)]
    inner = DATA + "%3Csvg xmlns='s'%3E%3Ca href='https://foo.com/{}' id='k'/%3E%3C/svg%3E"
    assert audit(spark, [page(f'<img src="{inner.format("x")}"><img src="{inner.format("x")}">')], known) == ((2, 0, 3, 0), [])
    assert audit(spark, [page(f'<img src="{inner.format("y")}">')], known) == ((1, 1, 1, 1), ["missing_response"])
    assert audit(spark, [page(f'<img src="{inner.format("x")}#k"><img src="{inner.format("x")}#n">')], known) == ((1, 1, 2, 1), ["element_not_found"])
    nested = DATA + "%3Csvg%3E%3Cimage href='data:image/svg+xml,%253Csvg%253E%253Ca href=%2522https://foo.com/y%2522/%253E%253C/svg%253E'/%3E%3C/svg%3E"
    assert audit(spark, [page(f'<img src="{nested}">')], known) == ((2, 1, 2, 1), ["missing_response"])
    assert audit(spark, [page('<img src="data:image/svg+xml;base64,***">')], known) == ((0, 1, 0, 1), ["data_url"])


def test_site_options(spark):
    hops = [(ROOT + "a", 301, {"location": "b"}), (ROOT + "b", 302, {"location": "/c"}), (ROOT + "c", 200, HTML)]
    site = [{"host": "foo.com", "site": "s", "max_redirects": 1}]
    assert audit(spark, [page('<a href="a"/><a href="b"/>')], hops, site) == ((0, 1, 1, 1), ["too_many_redirects"])
    docs = spark.createDataFrame([(ROOT, "html", '<blink foo="1"><i bar="2">x</i></blink>'), ("https://bar.com/", "html", "<blink>"), (ROOT + "s", "svg", f'<svg xmlns="{elements.SVG_NS}" viewBox="0 0 1 1"><path/><nope/></svg>')], "url string, doc_type string, body string")
    options = [{"host": "foo.com", "site": "s", "validate_html": True, "validate_svg": True, "html_ignored_elements": ["bl.*"]}]
    got = site_markup(docs, read_sites(spark, options), markup.html_rules(spark), markup.svg_rules(spark)).collect()
    assert sorted((r.doc_url, r.message) for r in got) == [(ROOT, 'attribute "bar" not allowed'), (ROOT + "s", 'child "nope" not allowed'), (ROOT + "s", "missing attributes: d"), (ROOT + "s", 'unknown tag "nope"')]


def test_robots_that_fail_or_move(spark):
    other, rows = "https://bar.com/", "url string, status int, headers map<string,string>, body binary, request_error string"
    known = responses_of(spark, [(u + p, 200, HTML) for u in (ROOT, other) for p in ("x", "y")])
    body = spark.createDataFrame([(other, "html", f'<a href="x"/><a href="y"/><a href="{ROOT}x"/>')], "url string, doc_type string, body string")

    def run(*robots_rows):
        checked, _ = site_audit(body, known, read_sites(spark, []), robots_responses=spark.createDataFrame(robots_rows, rows))
        return sorted((r.target, r.error_kind) for r in checked.collect() if not r.ok)

    moved = (other + "robots.txt", 301, {"location": ROOT + "r"}, None, None), (ROOT + "r", 200, {}, b"User-agent: *\nDisallow: /y", None)
    assert run(*moved) == [] and run((other + "robots.txt", 404, {}, b"\xff", None)) == []
    failed = [(other + "x", "robots_fetch"), (other + "y", "robots_fetch")]
    for row in ((other + "robots.txt", None, {}, None, "timeout"), (other + "robots.txt", 200, {}, b"\xff", None), (other + "robots.txt", 301, {"location": "gone"}, None, None)):
        assert run(row) == failed


def test_elements_of_svgs_keep_their_names(spark):
    svg = f'<s:svg xmlns:s="{elements.SVG_NS}" xmlns:x="http://www.w3.org/1999/xlink" xmlns:xlink="other" viewBox="0 0 1 1"><s:linearGradient x:href="#a&amp;b" xlink:href="n"/><own:e xmlns:own="u"/></s:svg>'
    rows = elements.elements(spark.createDataFrame([("u", svg, True)], "url string, html string, svg boolean"), svg_col="svg").orderBy("ord").collect()
    assert [(r.name, r.namespace, [tuple(a) for a in r.attributes]) for r in rows] == [("svg", elements.SVG_NS, [("viewBox", "0 0 1 1")]), ("linearGradient", elements.SVG_NS, [("xlink:href", "#a&b"), ("other:href", "n")]), ("own:e", "u", [])]
    assert rows[0].children == ["linearGradient", "own:e"] and rows[2].parent_ord == 0


RULES = {
    "elements": [("x", 0, "a b"), ("x", 1, "(a & b & c?)"), ("y", 0, None), ("z-*", 0, None)],
    "attributes": [("x", 0, 0, "p", True), ("x", 1, 0, "q", True), ("y", 0, 0, "p", True), ("y", 0, 0, "r", False), ("y", 0, 1, "q", True), ("y", 0, 1, "s*", True)],
    "values": [("y", "r", "exact", "1")], "children": [("x", "a"), ("x", "b"), ("x", "c")],
}


def test_best_variants_and_sets(spark):
    kinds = ["name string, variant int, content_regex string", "element string, variant int, attribute_set int, attribute string, required boolean", "element string, attribute string, match string, literal string", "parent string, child string"]
    rules = {n: spark.createDataFrame(RULES[n], k) for n, k in zip(RULES, kinds)}
    rules["attributes"] = rules["attributes"].withColumn("mode", F.expr("CASE attribute WHEN 'r' THEN 'literal' ELSE 'any' END"))
    cases = [
        ('<x q="1"><b></b><a></a></x>', []),  # the second variant's content
        ("<x><a></a><b></b></x>", [("missing_attribute", "p")]),
        ('<x p="1"><b></b><a></a></x>', [("misplaced_child", "b")]),  # against a conflict and a missing attribute of the second
        ('<x p="1"><a></a><d></d></x>', [("child_not_allowed", "d"), ("missing_child", "b"), ("unknown_tag", "d")]),
        ('<y p="1" r="2"></y>', [("invalid_value", "r")]),
        ('<y q="1" s1="" r="1"></y>', [("conflicting_attribute", "r"), ("missing_attribute", "s*")]),
        ('<y t="1" p=""></y>', [("attribute_not_allowed", "t")]),
        ("<z-1></z-1>", []),
    ]
    for name in "abc":
        rules["elements"] = rules["elements"].union(spark.createDataFrame([(name, 0, None)], kinds[0]))
    rows = elements.elements(spark.createDataFrame([(str(i), h) for i, (h, _) in enumerate(cases)], "url string, html string"))
    got = markup.markup_errors(rows, rules).collect()
    assert [sorted((r.kind, r.name) for r in got if r.doc_url == str(i)) for i in range(len(cases))] == [sorted(w) for _, w in cases]
    none = markup.markup_errors(rows, rules, ["[dxyz].*"]).collect()
    assert none == []


def test_order_in_syntax_errors(spark):
    css = spark.createDataFrame([("a", "}{"), ("b", "a{b{}}"), ("c", '{"}"')], "url string, css string")
    assert {r.doc_url: r.errors for r in report.css_syntax_errors(css).collect()} == {"a": ["unexpected }"]}  # what is open at the end is closed by it
    svg = spark.createDataFrame([("a", "<g></a>"), ("b", "<g><a/><?x?><b>t</b></g>"), ("c", "<a><b></a></b>")], "url string, svg string")
    assert {r.doc_url: r.errors for r in report.svg_syntax_errors(svg).collect()} == {"a": ["unclosed element", "unexpected end tag"], "c": ["unclosed element", "unexpected end tag"]}


def test_overall_rate(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4000)], "site string, s long").select("site", F.timestamp_seconds("s").alias("ts"))
    got = requestlog.rate_limit_violations(log, 1, overall=2).collect()
    assert sorted(((r.site or "*"), r.n) for r in got) == [("*", 3), ("a", 2)]


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("Exchange")


def test_plans_read_once(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = pages.select("url", F.lit("html").alias("doc_type"), F.col("html").alias("body"))
    assert scans(extract.all_links(docs)) == (1, 0)
    assert scans(report.summary_table(pages.select(F.col("url").alias("doc_url"), F.lit(1).alias("success"), F.lit(0).alias("error")))) == (1, 1)
    path = scratch(spark, "elements")
    elements.elements(pages).write.parquet(path)
    plan = markup.markup_errors(spark.read.parquet(path), markup.html_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_only_small_tables_are_broadcast(spark):
    narrow, wide = spark.range(3), spark.range(3).select(*[F.lit("x").alias(f"c{i}") for i in range(10)])
    hinted = lambda df, rows: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() if (df := small(df, rows)) is not None else None
    assert hinted(narrow, 500_000) and not hinted(narrow, 500_001) and hinted(wide, 50_000) and not hinted(wide, 51_000)


def test_scratch_is_shared_and_cleared(spark):
    with cleared(spark):
        path = scratch(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(path.removeprefix("file://")) and "run" not in scratch(spark, "y")


def test_content_models():
    assert markup.content_errors("(a )&(b )", ["b", "a"]) == ([], [])
    assert markup.content_errors("(a b)& c?", ["a", "c", "b"]) == ([], []) and markup.content_errors("(a b)& c", ["b", "a"]) == (["b"], [])
    assert markup.content_errors("a & b & c", ["b"]) == ([], ["a", "c"]) and markup.content_errors("(a b)*", ["b", "a"], ["b"]) == ([], ["b"])
    for wrong in ("a, b", "(a", "a)", "* a"):
        with pytest.raises(ValueError):
            markup.content_of(wrong)
    assert markup.content_errors("(head )?(body )?", ["head", "body"]) == ([], [])
    assert markup.content_errors("(head )?(body )?", ["body", "head"]) == (["head"], [])
    assert markup.content_errors("((dt )+(dd )+)*", ["dt", "dd", "dt"]) == ([], ["dd"])
    assert markup.content_errors("(a |b )c ", []) == ([], ["a", "b"])
    assert markup.content_errors("(a b |c )", []) == ([], ["c"])


def test_reports(spark):
    rows = [("u", 0, "a", [("href", "x")], 0, True, None, None, ("https://x/", 200, 7)), ("u", 0, "a", [("href", "x")], 1, False, "k", 'bad "x"', None), ("u", 2, "img", [], 0, True, None, None, None)]
    results = spark.createDataFrame(rows, "doc_url string, ord int, element string, attributes array<struct<name:string,value:string>>, item int, ok boolean, error_kind string, error string, response struct<url:string,status:int,latency:long>")
    nested = report.nest_report(results)
    want = {"url": "u", "elements": [{"element": {"name": "a", "attributes": [["href", "x"]]}, "results": [{"response": {"url": "https://x/", "status": 200, "latency": 7}}, {"error": 'bad "x"'}]}, {"element": {"name": "img", "attributes": []}, "results": [{"response": None}]}]}
    path = scratch(spark, "json")
    write_report_json(nested, path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [want]
    lines = [r.line for r in report.report_lines(nested).orderBy("place").collect()]
    assert lines == ["u", '\ta href="x"', "\t\t✅ 200 OK https://x/ 7 ms", '\t\t❌ bad "x"', "\timg", "\t\t✅ valid URL"]
    path = scratch(spark, "text")
    write_report_text(report.report_lines(nested), path)
    assert [r.value for r in spark.read.text(path).collect()] == lines


def test_store(spark):
    rows = [("u", 200, {"A": "1"}, b"x", 1, "2024-01-02", None), ("u", 404, {}, b"y", 1, "2024-01-01", None), ("v", None, {}, None, 1, "2024-01-01", "timeout")]
    df = spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body binary, duration_ms long, at string, request_error string")
    df = df.select("url", "status", "headers", "body", "duration_ms", F.col("at").cast("timestamp").alias("fetched_at"), "request_error")
    path = scratch(spark, "store")
    write_store(df, path)
    back = read_responses(spark, path)
    assert sorted((r.url, r.status, list(r.headers)) for r in back.collect()) == [("u", 200, ["a"]), ("v", None, [])]
    ask = spark.createDataFrame([("u", 1000), ("v", 1000), ("w", 1000)], "url string, max_age_ms long").withColumn("now", F.lit("2024-01-02").cast("timestamp")).withColumn("swr_ms", F.lit(0)).withColumn("retry_statuses", F.array(F.lit(503)))
    assert {r.url: r.lookup for r in store.cache_lookup(ask, back).collect()} == {"u": "hit", "v": "evicted", "w": "miss"}


def test_retries(spark):
    rows = [("a", 0, 503, None), ("a", 1, 200, None), ("a", 2, 200, None), ("b", 0, None, "timeout"), ("b", 1, 503, None), ("b", 2, 200, None), ("c", 0, 404, None)]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, request_error string")
    got = {r.url: (r.attempt, r.used, r.settled) for r in requestlog.retry_outcome(df, 1, [503]).collect()}
    assert got == {"a": (1, 2, True), "b": (1, 2, False), "c": (0, 1, True)}


def test_schedule_of_a_hot_site(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("site"), "id")
    got = requestlog.rate_limited_schedule(df, 7, ["id"]).groupBy("site", "slot").count().collect()
    assert all(r["count"] == 7 or (r.site, r.slot) in {("hot", 285), ("cold", 142)} for r in got) and len(got) == 286 + 143


def test_crawl_of_a_cycle_and_shuffled_input(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "url string")
    want = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.url: r.depth for r in crawl.crawl_depth(edges, roots).collect()} == want
    assert {r.url: r.depth for r in crawl.crawl_depth(edges.repartition(7), roots.union(roots)).collect()} == want


def test_cross_origin_headers(spark):
    df = spark.createDataFrame([("https://a/", "https://a/b", {"Cookie": "1", "X": "2"}), ("https://a/", "https://a:8443/", {"Cookie": "1", "X": "2"})], "url string, next string, headers map<string,string>")
    assert [sorted(r.headers) for r in redirects.forwarded_headers(df).collect()] == [["Cookie", "X"], ["X"]]
