"""Metrics and reports of result rows: doc_url, ord, element, attributes, item, ok, error_kind, error, response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.text import status_text
from siteaudit.functions.urls import let, truncate_url
from siteaudit.operators.extract import BEFORE_IMPORT, at_keyword, css_tokens


def document_metrics(results: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_url, success, error. With documents (doc_url), those without items count 0 and 0."""
    counted = results.groupBy("doc_url").agg(F.count_if(F.col("ok")).alias("success"), F.count_if(~F.col("ok")).alias("error"))
    return counted if documents is None else listed_metrics(documents.select("doc_url").distinct(), counted)


def listed_metrics(documents: DataFrame, doc_metrics: DataFrame) -> DataFrame:
    """doc_metrics of each row of documents (doc_url): a URL that is listed twice has two rows. Those without items count 0 and 0."""
    rows = documents.select("doc_url").join(doc_metrics, "doc_url", "left")
    return rows.select("doc_url", F.coalesce("success", F.lit(0)).cast("long").alias("success"), F.coalesce("error", F.lit(0)).cast("long").alias("error"))


def run_metrics(doc_metrics: DataFrame) -> DataFrame:
    """One row: documents and items, ok and failed; the run fails if a document did."""
    bad = F.col("error") > 0
    out = doc_metrics.agg(
        F.count_if(~bad).alias("documents_ok"), F.count_if(bad).alias("documents_failed"),
        F.coalesce(F.sum("success"), F.lit(0)).alias("items_ok"), F.coalesce(F.sum("error"), F.lit(0)).alias("items_failed"),
    )
    return out.withColumn("failed", F.col("documents_failed") > 0)


def summary_table(doc_metrics: DataFrame) -> DataFrame:
    """Rows documents and elements: success, error, total. One aggregate, whose row is then stacked."""
    return summary_rows(run_metrics(doc_metrics))


def summary_rows(run: DataFrame) -> DataFrame:
    """summary_table of the row of run_metrics."""
    rows = run.select(F.stack(F.lit(2), F.lit("documents"), "documents_ok", "documents_failed", F.lit("elements"), "items_ok", "items_failed").alias("what", "success", "error"))
    return rows.withColumn("total", F.col("success") + F.col("error"))


def error_histogram(results: DataFrame, by: list[str]) -> DataFrame:
    """Number of failed items by error kind and the columns of by. Partial counts come before the shuffle."""
    return results.where(~F.col("ok")).groupBy(*by, "error_kind").agg(F.count(F.lit(1)).alias("n"))


def _messages(docs: DataFrame, url_col: str, found: Column) -> DataFrame:
    """doc_url, errors of documents that have any."""
    return docs.select(F.col(url_col).alias("doc_url"), found.alias("errors")).where(F.size("errors") > 0)


def _sorted(messages: Column) -> Column:
    return F.array_sort(F.array_compact(messages))


# At-rules of CSS, without prefixes of makers; and what is said of an import that comes too late.
AT_RULES = "charset color-profile container counter-style custom-media document font-face font-feature-values font-palette-values import keyframes layer media namespace nest page position-try property scope starting-style supports view-transition viewport".split()
LATE_IMPORT = "@import rules must precede all rules aside from @charset and @layer statements"


def css_faults(css: Column) -> Column:
    """Messages, sorted, of a stylesheet: closing braces without an open block, unknown at-rules, imports after other rules. What is open at the end is closed by it, which is no fault."""
    start = F.struct(F.lit(0).alias("open"), F.lit(True).alias("prelude"), F.array().cast("array<string>").alias("told"))
    fixed = lambda t: F.regexp_replace(t, "^@(?:-[a-z]+-)?", "")

    def step(s: Column, t: Column) -> Column:
        new = lambda open_=None, prelude=None, told=None: F.struct((s["open"] if open_ is None else open_).alias("open"), (s["prelude"] if prelude is None else prelude).alias("prelude"), (s["told"] if told is None else F.array_union(s["told"], F.array(told))).alias("told"))
        low = at_keyword(t)
        return (
            F.when(t == "{", new(s["open"] + 1, F.lit(False)))
            .when((t == "}") & (s["open"] > 0), new(s["open"] - 1))
            .when(t == "}", new(told=F.lit("unexpected }")))
            .when((low == "@import") & ~s["prelude"], new(told=F.lit(LATE_IMPORT)))
            .when(low.isin(*BEFORE_IMPORT), s)
            .when(t.startswith("@") & (s["open"] == 0) & ~fixed(low).isin(*AT_RULES), new(prelude=F.lit(False), told=F.concat(F.lit("Unknown at rule: "), t)))
            .when(t.startswith("@"), new(prelude=F.lit(False)))
            .otherwise(s)
        )

    return F.aggregate(css_tokens(css), start, step, lambda s: F.array_sort(s["told"]))


def css_syntax_errors(styles: DataFrame, url_col: str = "url", css_col: str = "css") -> DataFrame:
    """doc_url, errors of stylesheets with faults; see css_faults."""
    return _messages(styles, url_col, css_faults(F.col(css_col)))


def svg_faults(svg: Column) -> Column:
    """Messages, sorted, of an XML text whose tags, by name and in their order, or comments don't balance."""
    text = F.regexp_replace(F.regexp_replace(svg, "(?s)<!--.*?-->", ""), "(?s)<!\\[CDATA\\[.*?\\]\\]>", "")
    tag = "</?[A-Za-z_](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"

    def found(t: Column) -> Column:
        tags = F.filter(F.regexp_extract_all(t, F.lit(tag), F.lit(0)), lambda x: ~x.endswith("/>"))
        named = F.transform(tags, lambda x: F.regexp_extract(x, "^<(/?[^\\s/>]++)", 1))
        start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(False).alias("stray"))
        inner = lambda s: F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)
        closes = lambda s, x: F.concat(F.lit("/"), F.coalesce(F.get(s["open"], F.size(s["open"]) - 1), F.lit(""))) == x
        step = lambda s, x: F.when(~x.startswith("/"), F.struct(F.concat(s["open"], F.array(x)).alias("open"), s["stray"].alias("stray"))).when(closes(s, x), F.struct(inner(s).alias("open"), s["stray"].alias("stray"))).otherwise(F.struct(s["open"].alias("open"), F.lit(True).alias("stray")))
        told = lambda s: F.array(F.when(F.size(s["open"]) > 0, F.lit("unclosed element")), F.when(s["stray"], F.lit("unexpected end tag")), F.when(t.contains("<!--"), F.lit("unclosed comment")))
        return F.aggregate(named, start, step, told)

    return let(lambda s: _sorted(found(s["t"])), t=text)


def svg_syntax_errors(svgs: DataFrame, url_col: str = "url", svg_col: str = "svg") -> DataFrame:
    """doc_url, errors of SVG documents with faults; see svg_faults."""
    return _messages(svgs, url_col, svg_faults(F.col(svg_col)))


def nest_report(results: DataFrame, documents: list[str] | None = None) -> DataFrame:
    """url and elements, in document order: each element's name, attributes and results. A document's rows meet once; two sorts inside it put them in order.

    documents: columns that tell documents of one URL apart. Their elements stay apart; at one place of the order they come by these columns.
    """
    result, own = F.struct("item", "ok", "error", "response"), documents or []
    rows = results.groupBy("doc_url", "ord", *own).agg(F.first("element").alias("element"), F.first("attributes").alias("attributes"), F.array_sort(F.collect_list(result)).alias("results"))
    element = F.struct("ord", *own, "element", "attributes", "results")
    return rows.groupBy("doc_url").agg(F.array_sort(F.collect_list(element)).alias("elements")).withColumnRenamed("doc_url", "url")


def report_json(report: DataFrame) -> DataFrame:
    """url, json: a line of keys url and elements; attributes are pairs; a result is a response, null for none, or an error."""
    pairs = lambda e: F.transform(e["attributes"], lambda a: F.array(a["name"], truncate_url(a["value"])))
    answer = lambda r: F.to_json(F.struct(F.struct(truncate_url(r["response"]["url"]).alias("url"), r["response"]["status"].alias("status"), r["response"]["latency"].alias("latency")).alias("response")))
    shown = lambda r: F.when(~r["ok"], F.to_json(F.struct(r["error"].alias("error")))).when(r["response"].isNull(), F.lit('{"response":null}')).otherwise(answer(r))
    one = lambda e: F.concat(F.lit('{"element":'), F.to_json(F.struct(e["element"].alias("name"), pairs(e).alias("attributes"))), F.lit(',"results":['), F.array_join(F.transform(e["results"], shown), ","), F.lit("]}"))
    url = F.get(F.split(F.to_json(F.struct("url")), '^\\{"url":'), F.lit(1))
    body = F.concat(F.lit('{"url":'), F.regexp_replace(url, "\\}$", ""), F.lit(',"elements":['), F.array_join(F.transform("elements", one), ","), F.lit("]}"))
    return report.select("url", body.alias("json"))


def report_lines(report: DataFrame) -> DataFrame:
    """doc_url, place, line: the document's URL, its elements behind one tab, their results behind two."""
    head = lambda e: F.concat_ws(" ", F.concat(F.lit("\t"), e["element"]), F.array_join(F.transform(e["attributes"], lambda a: F.concat(a["name"], F.lit('="'), truncate_url(a["value"]), F.lit('"'))), " "))
    good = lambda r: F.when(r["response"].isNull(), F.lit("\t\t✅ valid URL")).otherwise(F.concat(F.lit("\t\t✅ "), status_text(r["response"]["status"]), F.lit(" "), truncate_url(r["response"]["url"]), F.lit(" "), r["response"]["latency"].cast("string"), F.lit(" ms")))
    lines = lambda e: F.concat(F.array(F.rtrim(head(e))), F.transform(e["results"], lambda r: F.when(r["ok"], good(r)).otherwise(F.concat(F.lit("\t\t❌ "), r["error"]))))
    rows = F.concat(F.array(F.col("url")), F.flatten(F.transform("elements", lines)))
    return report.select(F.col("url").alias("doc_url"), F.posexplode(rows).alias("place", "line"))
