"""Tables that the registered queries derive from the given ones; all grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.functions.urls import url_parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def based_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages; of each eight one has a base of another origin, one a base that can't be parsed."""
    base = F.expr("""CASE page_id % 8 WHEN 0 THEN '<base href="https://base.example.org/b/">' WHEN 4 THEN '<base href="https://">' ELSE '' END""")
    return pages(spark, sf_dir).withColumn("html", F.concat(base, "html"))


def faulty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a markup fault each at the beginning of their body, by page_id; each fifth has none."""
    fault = F.expr(
        """CASE page_id % 5 WHEN 0 THEN '<blink>x</blink>' WHEN 1 THEN '<p><img alt="a"></p>' WHEN 2 THEN '<a href="/" target="nowhere" foo="1">t</a>' WHEN 3 THEN '<ul><p>x</p></ul>' ELSE '' END"""
    )
    return pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), fault)))


STATUS = "CASE page_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 ELSE 200 END"
TARGET_STATUS = "CASE length(target) % 7 WHEN 0 THEN 404 ELSE 200 END"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses: statuses by page_id; a 301 leads to the page with the next page_id."""
    p = pages(spark, sf_dir)
    to = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to"))
    rows = p.drop("html").join(to, "page_id", "left").withColumn("status", F.expr(STATUS).cast("int"))
    headers = F.map_filter(F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"), F.lit("location"), F.when(F.col("status") == 301, F.col("to"))), lambda _, v: v.isNotNull())
    at = F.timestamp_add("HOUR", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    return rows.select("page_id", "url", "status", headers.alias("headers"), at.alias("fetched_at"), F.lit(None).cast("string").alias("request_error"))


def extra_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with elements of each kind after their own: url, page_id, html."""
    block = F.expr(
        """concat(html, '<link rel="stylesheet" href="/s/', page_id, '.css"><link rel="preconnect" href="https://cdn.example.com"><link rel="sitemap" href="/map.xml">',
        '<meta property="og:image" content="/og/', page_id, '.png"><meta property="og:title" content="t"><script src="/x', page_id % 5, '.js">var s = "<a href=\\'/no\\'>";</script>',
        '<img src="/i/', page_id, '.png" srcset="/i/', page_id, '-1.png 1x, /i/', page_id, '-2.png 2x,data:image/png;base64,AA,BB 3x"><a xlink:href="#x', page_id, '" id="x', page_id, '" name="n', page_id % 3, '">t</a>',
        '<a href="#x', page_id % 4, '">u</a><a href="data:image/svg+xml,%3Csvg%20id=%22d', page_id % 7, '%22/%3E">v</a>')"""
    )
    return pages(spark, sf_dir).select("page_id", "url", block.alias("html"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for each host, recursive for every second page_id's host, and one for /en or /de of hosts that begin with m. or blog.; plus the default site."""
    hosts = pages(spark, sf_dir).select(url_parts(F.col("url"))["host"].alias("host")).distinct()
    rest = [F.array(F.lit("http"), F.lit("https")).alias("schemes"), F.array(F.lit(200)).alias("statuses"), F.array().cast("array<string>").alias("ignored_fragments")]
    root = hosts.select(F.concat("host", F.lit("/")).alias("site"), "host", F.lit("/").alias("path"), (F.length("host") % 2 == 0).alias("recursive"), *rest)
    deep = hosts.where("host LIKE 'm.%' OR host LIKE 'blog.%'").select("host", F.when(F.col("host").startswith("m."), "/en").otherwise("/de").alias("path"))
    deep = deep.select(F.concat("host", "path").alias("site"), "host", "path", (F.length("host") % 3 == 0).alias("recursive"), *rest)
    default = hosts.sparkSession.range(1).select(F.lit("default").alias("site"), F.lit(None).cast("string").alias("host"), F.lit("/").alias("path"), F.lit(False).alias("recursive"), *rest)
    return root.unionByName(deep).unionByName(default)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: page k links to pages (7 k + 3) and (2 k + 1) modulo their number."""
    p = pages(spark, sf_dir).select("page_id", "url")
    n = p.count()
    k = F.col("page_id")
    to = p.select("url", F.explode(F.array((k * 7 + 3) % n, (k * 2 + 1) % n)).alias("to"))
    return to.join(p.select(F.col("page_id").alias("to"), F.col("url").alias("dst")), "to").select(F.col("url").alias("src"), "dst")


CSS_TEXT = (
    """concat('\\ufeff/* url(no.png) */ @charset "utf-8"; @import "a', page_id, '.css"; @import url(b.css) screen; p { background: url(\\'c', page_id % 9, '.png\\') } ',
        'q { background: image-set("d.png" 1x, url(e.png) 2x) } r { fill: url(#f); mask: url("") } t { content: "url(no.png) /*"; src: url(f\\\\)', page_id, '\\\\26 .png) } ',
        CASE page_id % 5 WHEN 0 THEN '}' WHEN 1 THEN concat('@un', page_id % 3, ' x; s {') WHEN 2 THEN '@import "late.css";' ELSE '' END)"""
)


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, page_id, css."""
    return pages(spark, sf_dir).select("page_id", "url", F.expr(CSS_TEXT).alias("css"))


SITEMAP_TEXT = (
    """CASE WHEN page_id % 2 = 0 THEN concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><!-- <url><loc>no</loc></url> --><url><loc> https://example.com/', page_id, '?a=1&amp;b=2 </loc><image:image><image:loc>https://example.com/no.png</image:loc></image:image></url><s:url><s:loc><![CDATA[https://example.com/c', page_id, ']]></s:loc></s:url><url><loc></loc></url></urlset>')
        ELSE concat('<sitemapindex><sitemap><loc>https://example.com/m', page_id, '.xml</loc><lastmod>2024</lastmod></sitemap></sitemapindex>') END"""
)


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, page_id, xml: a sitemap for even pages, an index for odd ones."""
    return pages(spark, sf_dir).select("page_id", "url", F.expr(SITEMAP_TEXT).alias("xml"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, robots: the robots.txt of each origin, by the length of its host."""
    root = pages(spark, sf_dir).select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("root")).distinct()
    text = F.expr(
        """concat('# robots\\r\\nUser-agent: other\\nDisallow: /\\n\\nUser-agent: *\\nUser-agent: thing\\nDisallow: /en/1\\nAllow: /en/1', length(root) % 10, '\\nDisallow: /*.html$\\n',
        CASE WHEN length(root) % 4 = 0 THEN 'User-agent: SiteAudit\\nDisallow: /fr/\\nDisallow:\\n' ELSE '' END, 'SITEMAP:', root, '/map.xml\\n  sitemap: ', root, '/news.xml # x\\n')"""
    )
    return root.select(F.concat("root", F.lit("/robots.txt")).alias("url"), "root", text.alias("robots"))


SVG_TEXT = (
    """concat('<', CASE page_id % 4 WHEN 0 THEN 'g' ELSE 'svg' END, ' xmlns="', CASE page_id % 3 WHEN 0 THEN 'http://example.com/ns' ELSE 'http://www.w3.org/2000/svg' END, '" xmlns:xlink="http://www.w3.org/1999/xlink"><use xlink:href="#a', page_id, '"/><a href="/svg/', page_id, '"><text id="a', page_id, '">t</text></a></',
        CASE page_id % 4 WHEN 0 THEN 'g' ELSE 'svg' END, '>')"""
)


def svgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, page_id, svg: every fourth has another root, every third another namespace."""
    return pages(spark, sf_dir).select("page_id", "url", F.expr(SVG_TEXT).alias("svg"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, url, ts, event_id of the events table."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("site"), F.concat(F.lit("/"), "event_type").alias("url"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, attempt, status, request_error, duration_ms: ten events in a row are attempts at one URL."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "signup", F.lit(None)).when(F.col("event_type") == "error", 503).otherwise(200).cast("int")
    return e.select(F.concat(F.lit("u"), F.call_function("div", F.col("event_id"), F.lit(10)).cast("string")).alias("url"), (F.col("event_id") % 10).cast("int").alias("attempt"), status.alias("status"), F.when(F.col("event_type") == "signup", F.lit("timeout")).alias("request_error"), F.round("value").cast("long").alias("duration_ms"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the pages' own links, with the page_id: their targets' statuses by the length of the target."""
    from siteaudit.operators.extract import html_links, resolve_links, start_tags

    links = resolve_links(html_links(start_tags(pages(spark, sf_dir), keep=["page_id"]), ["page_id"]))
    status = F.expr(TARGET_STATUS).cast("int")
    return links.select(
        "doc_url", "page_id", "ord", "element", F.array(F.struct(F.col("attribute").alias("name"), F.col("raw").alias("value"))).alias("attributes"), "item", (status == 200).alias("ok"),
        F.when(status != 200, F.lit("http_status")).alias("error_kind"), F.when(status != 200, F.lit("invalid status 404 Not Found")).alias("error"),
        F.when(status == 200, F.struct(F.col("target_nofrag").alias("url"), status.alias("status"), F.lit(0).cast("long").alias("latency"))).alias("response"),
    )


def tricky_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and, after their own text, tags beside what is none: in a script, in comments of all ends, in elements of text only, and cut off by the end."""
    more = F.expr(
        """concat(html, '<script>var s = "<!--"; <u></script><input disabled value=x data-a="1>2" checked><!--><i title="<!-- y" lang=it\\'s>q</i><!-- <u> --!><textarea><u></textarea><title><u></title><b hidden>t</b></><p/>',
        CASE page_id % 3 WHEN 0 THEN '<!-- <u>' WHEN 1 THEN '<noscript><u>' ELSE '<u title="><u>' END)"""
    )
    return pages(spark, sf_dir).withColumn("html", more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, doc_type, body (bytes): a document of some kind for each page, on the page's host; each sixth can't be read. HTML is the page's own text and more."""
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    kind = F.expr("CASE page_id DIV 7 % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'css' WHEN 2 THEN 'svg' WHEN 3 THEN 'sitemap' WHEN 4 THEN 'robots' ELSE CASE page_id % 2 WHEN 0 THEN 'css' ELSE 'sitemap' END END")
    html = F.concat("html", F.expr("""concat('<script>"<!--"</script><a href="/d/', page_id + 1, '">n</a><title><a href="/no"></title><a href="#t" id="t">t</a><a href="#none">u</a>')"""))
    text = F.when(F.col("doc_type") == "html", html).when(F.col("doc_type") == "css", F.expr(CSS_TEXT)).when(F.col("doc_type") == "svg", F.expr(SVG_TEXT)).when(F.col("doc_type") == "sitemap", F.expr(SITEMAP_TEXT)).otherwise(F.concat(F.lit("Sitemap: "), root, F.lit("/map.xml\n")))
    body = F.encode(text, "utf-8")
    body = F.when(F.expr("page_id DIV 7 % 6 = 5"), F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)
    return pages(spark, sf_dir).withColumn("doc_type", kind).select(F.concat(root, F.lit("/d/"), F.col("page_id").cast("string")).alias("url"), "doc_type", body.alias("body"))
