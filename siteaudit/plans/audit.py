"""The three main workloads, from tables of responses to metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.operators import extract
from siteaudit.operators.check import check_links, checked_targets
from siteaudit.operators.crawl import crawl
from siteaudit.operators.elements import elements
from siteaudit.operators.extract import all_links, data_svg_documents, document_anchors
from siteaudit.operators.faults import document_faults
from siteaudit.operators.markup import split_markup_errors
from siteaudit.operators.report import document_metrics
from siteaudit.operators.robots import robots_bodies, robots_filter, robots_rules
from siteaudit.operators.sites import match_site
from siteaudit.sources.scratch import cut
from siteaudit.sources.tables import SITE_DEFAULTS


def page_links(pages: DataFrame) -> DataFrame:
    """Links of HTML pages (url, html), resolved to their page's base, written: bodies are read and parsed once, and only links go further."""
    return cut(extract.page_links(pages), "links")


def link_audit(pages: DataFrame, targets: Callable[[DataFrame], DataFrame], sites: DataFrame, ignored: list[str] | None = None, with_anchors: bool = False) -> DataFrame:
    """Links of pages, checked. targets gives the checked targets of a link table."""
    links = page_links(pages)
    return check_links(links, targets(links), sites, ignored, document_anchors(pages) if with_anchors else None)


def data_svgs(docs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, their links): the SVG documents in data: links of links, and those within them; documents has url, body and error."""
    kind = "url string, body string, error string"
    found, inner, fresh = docs.sparkSession.createDataFrame([], kind), links.limit(0), links
    while True:  # each round finds what the last one's documents hold, which are shorter than they are
        new = cut(data_svg_documents(fresh).select("url", "body", "error").join(found.select("url"), "url", "left_anti"), "data_svgs")
        if not new.take(1):
            return found, inner
        fresh = cut(all_links(new.where("body IS NOT NULL").select("url", F.lit("svg").alias("doc_type"), "body")), "links")
        found, inner = found.unionByName(new), inner.unionByName(fresh)


def site_audit(docs: DataFrame, responses: DataFrame, sites: DataFrame, rules: DataFrame | None = None, ignored: list[str] | None = None, max_redirects: int | None = None, robots_responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(checked links, metrics by document) of documents of all kinds: url, doc_type and body (text), and of the SVG documents in their data: links.

    responses: the responses of all requested URLs. max_redirects: at most so many for all sites, else the greatest
    of the sites' own. Faults of documents (see operators.faults) are items of the element #document before their links;
    a document without a body has failed. Data: SVGs go by the options of the default site. rules: robots rules; or robots_responses: responses of robots.txt files (with body), which
    give the rules, and whose errors fail the links of their origin.
    """
    links = cut(all_links(docs), "links")
    inner, more = data_svgs(docs, links)
    links = links.unionByName(more)
    if max_redirects is None:
        max_redirects = sites.agg(F.max("max_redirects")).first()[0] or SITE_DEFAULTS["max_redirects"]
    robots = None
    if robots_responses is not None:
        bodies = cut(robots_bodies(robots_responses, max_redirects), "robots")
        robots = robots_filter(responses.select("url"), robots_rules(bodies.where("robots IS NOT NULL")), bodies=bodies)
    elif rules is not None:
        robots = robots_filter(responses.select("url"), rules)
    held = inner.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("image/svg+xml").alias("media"), F.col("error").alias("request_error"), F.lit(None).cast("string").alias("redirect_error"), F.lit(True).alias("allowed"))
    targets = cut(checked_targets(responses, max_redirects, robots, sites).unionByName(held), "targets")
    bodies = docs.select("url", "doc_type", "body").unionByName(inner.select("url", F.lit("svg").alias("doc_type"), "body"))
    anchors = document_anchors(bodies.where("doc_type IN ('html', 'svg')"), "url", "body", F.col("doc_type") == "svg")
    checked = check_links(links, targets, sites, ignored, anchors)
    # what can't be read in a data: link fails that link, not a document
    faults = document_faults(docs.unionByName(inner.where("body IS NOT NULL").select("url", F.lit("svg").alias("doc_type"), "body"), allowMissingColumns=True), sites)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in checked.schema.fields if f.name not in ("doc_url", "ord", "element", "attribute", "item", "ok", "error_kind", "error")]
    faults = faults.select("doc_url", F.lit(-1).alias("ord"), "element", F.lit("").alias("attribute"), "item", F.lit(False).alias("ok"), "error_kind", "error", *rest)
    checked = cut(checked.unionByName(faults), "checked")
    return checked, document_metrics(checked, docs.select(F.col("url").alias("doc_url")).unionByName(inner.where("body IS NOT NULL").select(F.col("url").alias("doc_url"))))


def site_markup(docs: DataFrame, sites: DataFrame, html: dict[str, DataFrame], svg: dict[str, DataFrame] | None = None) -> DataFrame:
    """Markup errors of documents (url, doc_type, body) as report items, by the options of their sites: whether HTML and SVG are judged, and which elements and attributes aren't."""
    known = docs.where("doc_type IN ('html', 'svg')").select("url", "body", (F.col("doc_type") == "svg").alias("is_svg"))
    known = match_site(known, sites)
    parts = []
    for kind, rules in (("html", html), ("svg", svg)):
        if rules is not None:
            # documents that aren't judged aren't parsed; elements get no more of their site than what they need, by broadcast
            own = known.where((F.col("is_svg") == (kind == "svg")) & F.col(f"site.validate_{kind}")).drop("site")
            own = match_site(elements(own, "url", "body", "is_svg"), sites.select("host", "path", f"{kind}_ignored_elements", f"{kind}_ignored_attributes"), "doc_url")
            own = own.select(*[c for c in own.columns if c != "site"], F.col(f"site.{kind}_ignored_elements").alias("__elements"), F.col(f"site.{kind}_ignored_attributes").alias("__attributes"))
            parts.append(split_markup_errors(own, rules, F.col("__elements"), F.col("__attributes")))
    return reduce(DataFrame.unionByName, parts)


def reachable(docs: DataFrame, targets: DataFrame, roots: DataFrame, sites: DataFrame) -> DataFrame:
    """url of the documents that a run from roots visits; see operators.crawl."""
    return crawl(targets, cut(all_links(docs).select("doc_url", "target_nofrag"), "links"), roots, sites)


def markup_audit(rows: DataFrame, rules: dict[str, DataFrame], **ignored: list[str]) -> DataFrame:
    """Markup errors as report items."""
    return split_markup_errors(rows, rules, **ignored)
