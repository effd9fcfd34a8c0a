"""Reachability over a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.operators.sites import recursive_urls
from siteaudit.sources.scratch import BROADCAST_ROWS, counted, cut, scratch, small


#: Hops of a round, and the URLs of a frontier and the folders of edges up to which a round has as many.
HOPS, HOPS_ROWS, HOPS_FOLDERS = 8, 20_000, 8
#: Folders of edges at most, and edges that each should hold.
BUCKETS, BUCKET_EDGES = 4096, 500_000


def _bucket(url: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _by_source(edges: DataFrame) -> tuple[DataFrame, int, int]:
    """Edges written into folders by a hash of their source, the number of folders and that of edges. A source with very many edges is in several files of its folder."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "edges")
    edges = cut(edges, "edges")
    n = edges.count()
    buckets = max(1, min(BUCKETS, n // BUCKET_EDGES))
    if buckets == 1:
        return edges.withColumn("bucket", F.lit(0)), 1, n
    dealt = edges.withColumn("bucket", _bucket("src", buckets)).repartition(F.col("bucket"), F.pmod(F.xxhash64("dst"), F.lit(4)))
    dealt.write.partitionBy("bucket").parquet(path)
    return spark.read.schema("src string, dst string, bucket int").parquet(path), buckets, n


def crawl_depth(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """url, depth: hops from the nearest root, for every URL that the roots reach. edges: src, dst; roots: url.

    Each round writes the URLs that it finds, with their depths, into a folder of its own, so that what has been visited is
    always one scan and the plan stays short; lost executors cost no earlier round. A round from a small frontier goes HOPS
    hops, as rounds cost more than hops there; one from a large frontier, or over very many edges, goes one. A frontier that is counted small goes to
    the edges and to the visited URLs by broadcast: in a round of one hop neither of the two big tables is shuffled, and of
    the edges only those folders are read that may hold the frontier's. Cycles end by themselves.
    """
    spark, folder = edges.sparkSession, scratch(edges.sparkSession, "visited")
    edges, buckets, n_edges = _by_source(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    found = "url string, depth int"
    at = lambda k: spark.read.schema(found).parquet(f"{folder}/round={k}")
    roots.select("url").where("url IS NOT NULL").distinct().select("url", F.lit(0).alias("depth")).write.parquet(f"{folder}/round=0")
    n, depth, k = at(0).count(), 0, 0
    while n and (max_depth is None or depth < max_depth):
        frontier = at(k).where(F.col("depth") == depth)
        hops = 1 if n > HOPS_ROWS or buckets > HOPS_FOLDERS else HOPS if max_depth is None else min(HOPS, max_depth - depth)
        reached = cut(_hop(edges, buckets, frontier) if hops == 1 else _hops(small(edges.select("src", "dst"), n_edges), frontier, hops), "reached")
        n, visited = reached.count(), spark.read.schema("url string").parquet(folder)
        if n <= BROADCAST_ROWS:
            visited = F.broadcast(visited.join(F.broadcast(reached.select("url")), "url", "left_semi"))
        depth, k = depth + hops, k + 1
        reached.join(visited, "url", "left_anti").write.parquet(f"{folder}/round={k}")
        # whoever has more hops before them is among those of the last hop
        n = at(k).where(F.col("depth") == depth).count()
    return spark.read.schema(found).parquet(folder).select("url", "depth")


def _hop(edges: DataFrame, buckets: int, frontier: DataFrame) -> DataFrame:
    """url, depth of what the frontier (url, depth, all of one depth) links to."""
    dealt = frontier.withColumn("bucket", _bucket("url", buckets))
    asked = [r["bucket"] for r in dealt.select("bucket").distinct().collect()] if buckets > 1 else [0]  # at most BUCKETS numbers
    rows = edges.where(F.col("bucket").isin(asked)).join(counted(frontier), F.col("src") == F.col("url"))
    return rows.groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))


def _hops(edges: DataFrame, frontier: DataFrame, hops: int) -> DataFrame:
    """url, depth (the smallest) of what the frontier reaches within so many hops, itself included. Each hop goes on from all rows of the last, so the plan is one chain of joins.

    Ways over URLs that were visited before the frontier lead to no new URL sooner: what such a URL links to is
    visited or in the frontier.
    """
    rows = frontier.select("url", "depth")
    for _ in range(hops):
        to = F.when(F.col("dst").isNull(), F.array(F.struct("url", "depth"))).otherwise(F.array(F.struct("url", "depth"), F.struct(F.col("dst").alias("url"), (F.col("depth") + 1).alias("depth"))))
        rows = rows.join(edges, F.col("url") == F.col("src"), "left").select(F.explode(to).alias("r")).groupBy(F.col("r.url").alias("url")).agg(F.min("r.depth").alias("depth"))
    return rows


def crawl(targets: DataFrame, links: DataFrame, roots: DataFrame, sites: DataFrame) -> DataFrame:
    """url of the documents that a run visits. targets: url, final_url, status, doc_type, ok (accepted); links: doc_url, target_nofrag.

    A URL is expanded if it is a root or its site is recursive, if its response is accepted and a document;
    documents are visited once by their final URL.
    """
    accepted = targets.where(F.col("ok") & F.col("doc_type").isNotNull()).select("url", "final_url")
    asked = links.select("doc_url", F.col("target_nofrag").alias("url")).where("url IS NOT NULL").distinct()
    # which requested URLs may be expanded at all, found once on distinct URLs
    open_urls = recursive_urls(asked.select("url").distinct(), sites)
    edges = asked.join(open_urls, "url", "left_semi").join(accepted, "url").select(F.col("doc_url").alias("src"), F.col("final_url").alias("dst"))
    starts = roots.select("url").join(accepted, "url").select(F.col("final_url").alias("url"))
    return crawl_depth(edges, starts)


def frontier_minus_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """URLs of the frontier that are new, each once."""
    return frontier.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def distinct_documents(documents: DataFrame) -> DataFrame:
    """One row for each final URL: that of the smallest requested URL."""
    return documents.groupBy("final_url").agg(F.min("url").alias("url"))
