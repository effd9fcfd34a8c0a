"""Redirect chains over a table of responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.urls import resolve_url, strip_fragment, url_parts
from siteaudit.sources.scratch import cut

# Headers that stay behind when a redirect leaves its origin.
ORIGIN_HEADERS = ["authorization", "cookie", "proxy-authorization"]


def redirect_edges(responses: DataFrame) -> DataFrame:
    """url, next, error of every 3xx response: the location joined to the URL, or redirect_location or url_parse."""
    rows = responses.where(F.col("status").between(300, 399)).select("url", F.try_element_at("headers", F.lit("location")).alias("location"))
    rows = rows.withColumn("to", resolve_url(F.col("url"), F.col("location")))
    error = F.when(F.col("location").isNull(), F.lit("redirect_location")).when(F.col("to").isNull(), F.lit("url_parse"))
    return rows.select("url", strip_fragment(F.col("to")).alias("next"), error.alias("error"))


def resolve_redirects(responses: DataFrame, max_redirects: int = 16) -> DataFrame:
    """url, final_url, hops, error of every response that is a redirect; error may be too_many_redirects.

    Only redirects take part. A round joins all chains with themselves and so doubles what each knows of its way: 16 hops
    take 5 rounds, and a cycle has more hops than allowed after them. Each round is written; it ends early when no chain goes on.
    """
    state = cut(redirect_edges(responses).select("url", F.col("next").alias("at"), F.lit(1).alias("hops"), "error", F.lit(True).alias("open")), "redirects")
    known = 1
    while known <= max_redirects:
        on = state.select(F.col("url").alias("__url"), F.col("at").alias("__at"), F.col("hops").alias("__hops"), F.col("error").alias("__error"))
        ended = state.where("NOT open OR error IS NOT NULL").withColumn("open", F.lit(False))
        moved = state.where("open AND error IS NULL").join(on, F.col("at") == F.col("__url"), "left")
        further = F.col("__url").isNotNull()
        moved = moved.select("url", F.when(further, F.col("__at")).otherwise(F.col("at")).alias("at"), F.when(further, F.col("hops") + F.col("__hops")).otherwise(F.col("hops")).alias("hops"), F.col("__error").alias("error"), further.alias("open"))
        state, known = cut(ended.unionByName(moved), "redirects"), known * 2
        if not state.where("open AND error IS NULL").take(1):
            break
    within = F.col("hops") <= max_redirects
    return state.select("url", F.when(within & F.col("error").isNull(), F.col("at")).alias("final_url"), F.least("hops", F.lit(max_redirects)).alias("hops"), F.when(within, F.col("error")).otherwise(F.lit("too_many_redirects")).alias("error"))


def cross_origin_hops(edges: DataFrame) -> DataFrame:
    """Hops (url, next) that change scheme, host or port."""
    origin = lambda c: url_parts(F.col(c))["origin"]
    return edges.where(F.col("next").isNotNull() & ~origin("url").eqNullSafe(origin("next")))


def forwarded_headers(hops: DataFrame) -> DataFrame:
    """hops (url, next, headers) with the headers that may go along."""
    origin = lambda c: url_parts(F.col(c))["origin"]
    kept = F.map_filter("headers", lambda k, _: ~F.lower(k).isin(*ORIGIN_HEADERS))
    return hops.withColumn("headers", F.when(origin("url").eqNullSafe(origin("next")), F.col("headers")).otherwise(kept))
