"""Site options of URLs: a dimension of hosts and path prefixes, one row for each host."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.urls import url_parts
from siteaudit.sources.scratch import counted

#: Hosts whose options are broadcast at most; with more of them URLs and hosts meet in a shuffled join, whose hot keys adaptive execution splits.
BROADCAST_HOSTS = 50_000


def roots_by_host(sites: DataFrame) -> DataFrame:
    """host, roots: the root paths of each host, sorted."""
    return sites.where("host IS NOT NULL").groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("roots"))


def sites_by_host(sites: DataFrame) -> DataFrame:
    """host, options: an array of the host's site rows, the longest paths first. Counted, and broadcast if there are few."""
    options = F.struct("path", *[c for c in sites.columns if c not in ("path", "host")])
    hosts = sites.where("host IS NOT NULL").groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("n"), "path", options.alias("site"))), asc=False).alias("options"))
    return counted(hosts, BROADCAST_HOSTS)


def _matching(url_path: Column) -> Column:
    return F.filter("options", lambda o: F.startswith(url_path, o["path"]))


def match_site(urls: DataFrame, sites: DataFrame, url_col: str = "url") -> DataFrame:
    """urls with site: the options of the longest path prefix on the URL's host, else those of the default site.

    Prefixes are of strings: /foo matches /foobar. A join of one row for each host, by broadcast unless there are
    very many: a host with most of the URLs isn't moved to one task.
    """
    default = sites.where("host IS NULL").limit(1)
    options = F.struct("path", *[c for c in sites.columns if c not in ("path", "host")])
    fallback = default.select(F.lit(1).alias("__one"), options.alias("__default"))
    rows = urls.withColumn("__p", url_parts(F.col(url_col))).withColumn("__one", F.lit(1))
    rows = rows.join(sites_by_host(sites), F.col("__p.host") == F.col("host"), "left").join(F.broadcast(fallback), "__one", "left")
    site = F.coalesce(F.get(_matching(F.col("__p.path")), F.lit(0))["site"], F.col("__default"))
    return rows.select(*urls.columns, site.alias("site"))


def recursive_urls(urls: DataFrame, sites: DataFrame, url_col: str = "url") -> DataFrame:
    """Only the URLs with any matching path of their host, not just the longest, that is recursive."""
    rows = urls.withColumn("__p", url_parts(F.col(url_col))).join(sites_by_host(sites), F.col("__p.host") == F.col("host"))
    return rows.where(F.exists(_matching(F.col("__p.path")), lambda o: F.coalesce(o["site"]["recursive"], F.lit(False)))).select(*urls.columns)


def ignored_site_filter(links: DataFrame, ignored_roots: list[str], target_col: str = "target") -> DataFrame:
    """links without those whose target holds the root of an ignored site anywhere."""
    if not ignored_roots:
        return links
    return links.where(~F.coalesce(F.col(target_col).rlike("|".join(re.escape(r) for r in ignored_roots)), F.lit(False)))
