"""Link checks: one left join on distinct targets, then one cascade of conditions; the first failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.text import document_type, error_message, full_match_column, matches_any, media_type, scheme_accepted, status_accepted
from siteaudit.functions.urls import link_class
from siteaudit.operators.bloom import may_meet
from siteaudit.operators.redirects import resolve_redirects
from siteaudit.operators.sites import match_site
from siteaudit.sources.scratch import cut

#: Link elements that need no class and scheme check: their targets must be absolute anyway.
LISTED = ["loc", "sitemap"]


def link_targets(links: DataFrame) -> DataFrame:
    """target_nofrag, n: each target once, with the number of its links. Partial counts come before the shuffle."""
    return links.where("target_nofrag IS NOT NULL").groupBy("target_nofrag").agg(F.count(F.lit(1)).alias("n"))


def link_ignored(target: Column, patterns: list[str]) -> Column:
    """Whether a pattern occurs anywhere in the target, its fragment included."""
    return F.coalesce(matches_any(target, patterns), F.lit(False))


def checked_targets(responses: DataFrame, max_redirects: int = 16, robots: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """url, final_url, status, media, request_error, redirect_error, allowed of every requested URL.

    robots: url and allowed, and perhaps robots_error, which fails the URL before its redirects. sites: options
    whose max_redirects of the requested URL's site holds within max_redirects.
    """
    chains = resolve_redirects(responses, max_redirects)
    if sites is not None:
        chains = match_site(chains, sites).withColumn("__over", F.coalesce(F.col("hops") > F.col("site.max_redirects"), F.lit(False)))
        chains = chains.withColumn("final_url", F.when(~F.col("__over"), F.col("final_url"))).withColumn("error", F.when(F.col("__over"), F.lit("too_many_redirects")).otherwise(F.col("error")))
    chains = chains.select(F.col("url").alias("__from"), F.col("final_url").alias("__to"), F.col("error").alias("redirect_error"))
    first = responses.select("url", "status", media_type(F.col("headers")).alias("media"), "request_error")
    ended = first.select(F.col("url").alias("__final"), F.col("status").alias("__status"), F.col("media").alias("__media"), F.col("request_error").alias("__failed"))
    # redirects are few: only they are joined a second time
    straight = first.where("NOT (coalesce(status, 0) BETWEEN 300 AND 399)").select("url", F.col("url").alias("final_url"), "status", "media", "request_error", F.lit(None).cast("string").alias("redirect_error"))
    moved = chains.join(ended, F.col("__to") == F.col("__final"), "left")
    moved = moved.select(F.col("__from").alias("url"), F.col("__to").alias("final_url"), F.col("__status").alias("status"), F.col("__media").alias("media"), F.coalesce("__failed", F.when(F.col("redirect_error").isNull() & F.col("__final").isNull(), F.lit("missing_response"))).alias("request_error"), "redirect_error")
    out = straight.unionByName(moved)
    if robots is None:
        return out.withColumn("allowed", F.lit(True))
    error = F.col("robots_error") if "robots_error" in robots.columns else F.lit(None).cast("string")
    marked = robots.select(F.col("url").alias("__robots"), F.col("allowed"), error.alias("__error")).where("NOT allowed OR __error IS NOT NULL")
    marked = marked.groupBy("__robots").agg(F.min("allowed").alias("allowed"), F.min("__error").alias("__error"))
    out = out.join(marked, F.col("url") == F.col("__robots"), "left")
    return out.select(*[c for c in out.columns if c not in ("redirect_error", "allowed", "__robots", "__error")], F.coalesce("__error", "redirect_error").alias("redirect_error"), (F.col("__error").isNotNull() | F.coalesce("allowed", F.lit(True))).alias("allowed"))


def check_links(links: DataFrame, targets: DataFrame, sites: DataFrame, ignored: list[str] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """links with ok, error_kind, error, final_url and status.

    Order: URL, class, ignore rules, scheme, robots (blocked is ok), redirects, status, type, fragment. links are
    resolved link rows; targets come from checked_targets, anchors (doc_url, anchor) from extract.anchors.
    A link without a response has the error missing_response. data: links are ok, unless targets hold what they
    hold (see audit.data_svgs): then their type and fragment are checked, by the options of the linking document's site.
    """
    on = targets.select(F.col("url").alias("__url"), "final_url", "status", "media", "request_error", "redirect_error", "allowed")
    rows = with_site(links, sites).join(on, F.col("target_nofrag") == F.col("__url"), "left")
    return judged(rows, links.columns, ignored, anchors)


def with_site(links: DataFrame, sites: DataFrame) -> DataFrame:
    """links with site: that of their target, or of their document for data: links."""
    of = F.when(link_class(F.col("target")) == "data", F.col("doc_url")).otherwise(F.col("target"))
    return match_site(links.withColumn("__of", of), sites, "__of")


def judged(rows: DataFrame, columns: list[str], ignored: list[str] | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """columns of rows with ok, error_kind, error, final_url and status. rows: links with their site and what is known of their target (__url is null for nothing)."""
    listed, kind = F.col("element").isin(*LISTED), link_class(F.col("target"))
    held = (kind == "data") & F.col("__url").isNotNull()
    doc = document_type(F.col("media"), F.col("hint"))
    ok, err = F.lit(""), lambda k: F.lit(k)
    verdict = (
        F.when(F.col("target").isNull(), err("url_parse"))
        .when(~listed & (kind != "document") & ~held, ok)
        .when(link_ignored(F.col("target"), ignored or []), ok)
        .when(~listed & ~held & ~scheme_accepted(F.col("target"), F.col("site.schemes")), err("invalid_scheme"))
        .when(F.coalesce(~F.col("allowed"), F.lit(False)), ok)
        .when(F.col("__url").isNull(), err("missing_response"))
        .when(F.col("redirect_error").isNotNull(), F.col("redirect_error"))
        .when(F.col("request_error").isNotNull(), F.col("request_error"))
        .when(~held & ~F.coalesce(status_accepted(F.col("status"), F.col("site.statuses")), F.lit(False)), err("http_status"))
        .when(~held & doc["error"].isNotNull(), doc["error"])
        .otherwise(ok)
    )
    rows = rows.withColumn("__verdict", verdict)
    if anchors is not None:
        rows = _with_fragments(rows, anchors, columns)
    scheme = F.lower(F.regexp_extract("target", "^([A-Za-z][A-Za-z0-9+.\\-]*):", 1))
    failed = F.col("__verdict") != ""
    message = error_message(F.col("__verdict"), F.col("status"), scheme, F.col("fragment"), F.col("hint"), F.col("media"))
    return rows.select(*columns, (~failed).alias("ok"), F.when(failed, F.col("__verdict")).alias("error_kind"), F.when(failed, message).alias("error"), "final_url", "status")


def _with_fragments(rows: DataFrame, anchors: DataFrame, columns: list[str]) -> DataFrame:
    """Verdicts with element_not_found. The rows are written once and split; only links that ask for a fragment are shuffled, and of the anchors those that may be asked for."""
    asks = (F.col("__verdict") == "") & F.col("fragment").isNotNull() & F.col("final_url").isNotNull() & F.lower(F.coalesce("media", F.lit("text/html"))).isin("text/html", "image/svg+xml")
    asks = asks & F.coalesce(F.col("allowed"), F.lit(True)) & ~full_match_column(F.col("fragment"), F.col("site.ignored_fragments"))
    rows = cut(rows.select(*columns, "final_url", "status", "media", "__verdict", F.coalesce(asks, F.lit(False)).alias("__asks")), "verdicts")
    asking = rows.where("__asks")
    there = anchors.select(F.col("doc_url").alias("__doc"), F.col("anchor").alias("__anchor"))
    there = may_meet(there, ["__doc", "__anchor"], asking.select("final_url", "fragment").distinct(), ["final_url", "fragment"]).distinct()
    asking = asking.join(there, (F.col("final_url") == F.col("__doc")) & (F.col("fragment") == F.col("__anchor")), "left")
    asking = asking.withColumn("__verdict", F.when(F.col("__doc").isNull(), F.lit("element_not_found")).otherwise(F.col("__verdict"))).drop("__doc", "__anchor")
    return rows.where("NOT __asks").unionByName(asking).drop("__asks")


def missing_fragments(links: DataFrame, anchors: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Links (final_url, fragment) whose fragment no element of the document carries. Fragments are compared as they are written; ignored patterns match the whole of one. Of the anchors only those that may be asked for are shuffled."""
    from siteaudit.functions.text import full_match

    asked = links.where(F.col("fragment").isNotNull() & ~full_match(F.col("fragment"), ignored or []))
    there = anchors.select(F.col("doc_url").alias("__doc"), F.col("anchor").alias("__anchor"))
    there = may_meet(there, ["__doc", "__anchor"], asked.select("final_url", "fragment").distinct(), ["final_url", "fragment"])
    return asked.join(there, (F.col("final_url") == F.col("__doc")) & (F.col("fragment") == F.col("__anchor")), "left_anti")


def broken_links(checked: DataFrame) -> DataFrame:
    """Only the failing rows."""
    return checked.where(~F.col("ok"))
