"""Robots rules (RFC 9309) as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.functions.urls import let, url_parts
from siteaudit.operators.redirects import resolve_redirects
from siteaudit.sources.scratch import counted

AGENT = "siteaudit"
#: Origins whose rules are broadcast at most.
BROADCAST_ORIGINS = 50_000


def robots_rules(docs: DataFrame, agent: str = AGENT, url_col: str = "url", text_col: str = "robots") -> DataFrame:
    """origin, place, allow, pattern: the rules of the agent's groups of each robots.txt, or those of * where no group names it. Empty patterns say nothing."""
    lines = docs.select(F.col(url_col).alias("url"), F.posexplode(F.split(F.col(text_col), "\\r\\n|\\r|\\n")).alias("place", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.select("url", "place", F.lower(F.regexp_extract(line, "^([A-Za-z\\-]+)\\s*:", 1)).alias("key"), F.trim(F.regexp_replace(line, "^[A-Za-z\\-]+\\s*:", "")).alias("value"))
    rows = rows.where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("url").orderBy("place")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = F.collect_set(F.when(F.col("key") == "user-agent", F.lower("value"))).over(Window.partitionBy("url", "group"))
    rows = rows.withColumn("own", F.array_contains(agents, agent.lower())).withColumn("any", F.array_contains(agents, "*"))
    rows = rows.withColumn("named", F.max("own").over(Window.partitionBy("url")))
    rules = rows.where((F.col("group") > 0) & (F.col("key") != "user-agent") & (F.col("value") != "") & F.when(F.col("named"), F.col("own")).otherwise(F.col("any")))
    return rules.select(url_parts(F.col("url"))["origin"].alias("origin"), "place", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_bodies(responses: DataFrame, max_redirects: int = 16) -> DataFrame:
    """url, robots (text), error of each robots.txt among responses (with body), after its redirects.

    One that isn't found (404) has no text and no error. A failed request, a chain that leads nowhere and a body that
    isn't UTF-8 are the error robots_fetch, which fails all links of the origin.
    """
    ends = responses.select("url", F.col("url").alias("final"), F.lit(None).cast("string").alias("failed")).where("NOT (coalesce(status, 0) BETWEEN 300 AND 399)")
    moved = resolve_redirects(responses.drop("body"), max_redirects).select("url", F.col("final_url").alias("final"), F.col("error").alias("failed"))
    asked = ends.unionByName(moved).where(url_parts(F.col("url"))["path"] == "/robots.txt")
    there = responses.select(F.col("url").alias("__url"), "status", "request_error", "body").join(counted(asked.select(F.col("final").alias("__url")).distinct()), "__url", "left_semi")
    rows = asked.join(there, F.col("final") == F.col("__url"), "left")
    text = F.try_validate_utf8(F.col("body").cast("string"))
    found = F.coalesce(F.col("status"), F.lit(0)) != 404
    failed = F.col("failed").isNotNull() | F.col("request_error").isNotNull() | F.col("__url").isNull() | (found & F.col("body").isNotNull() & text.isNull())
    return rows.select("url", F.when(~failed & found, F.coalesce(text, F.lit(""))).alias("robots"), F.when(failed, F.lit("robots_fetch")).alias("error"))


def glob(pattern: Column) -> Column:
    """A rule's pattern as a struct: the texts between its stars, and whether it ends with the path (a closing $)."""
    body = F.regexp_replace(pattern, "\\$$", "")
    return F.struct(F.split(body, "\\*", -1).alias("parts"), pattern.endswith("$").alias("closed"))


def glob_matches(path: Column, rule: Column) -> Column:
    """Whether a path matches a glob from its beginning. Each part is looked for once, from where the one before it ends, so a pattern of many stars takes no longer than its parts; the last part of a closed pattern must lie at the end."""
    parts, closed = rule["parts"], rule["closed"]
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    # 0 stands for no match, else it is the place after what has matched
    start = F.when(F.startswith(path, first), F.length(first) + 1).otherwise(0)
    inner = F.filter(parts, lambda p, i: (i > 0) & (p != "") & ~(closed & (i == F.size(parts) - 1)))

    def step(at: Column, part: Column) -> Column:
        return F.when(at == 0, 0).otherwise(let(lambda s: F.when(s["found"] == 0, 0).otherwise(s["found"] + F.length(part)), found=F.call_function("locate", part, path, at)))

    def ends(at: Column) -> Column:
        alone = F.size(parts) == 1
        return (at > 0) & F.when(~closed, F.lit(True)).when(alone, path == first).otherwise(F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= at))

    return F.aggregate(inner, start, step, ends)


def robots_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url", bodies: DataFrame | None = None) -> DataFrame:
    """urls with allowed: the longest matching pattern decides, allow on ties; the query is not looked at; /robots.txt is always allowed.

    The rules of an origin are one row, so an origin with most of the URLs isn't moved to one task. With bodies (see
    robots_bodies) there is also robots_error, the error of the robots.txt of the URL's origin.
    """
    row = F.struct(F.length("pattern").alias("n"), F.col("allow"), glob(F.col("pattern")).alias("glob"))
    by_origin = rules.groupBy(F.col("origin").alias("__origin")).agg(F.sort_array(F.collect_list(row), asc=False).alias("__rules"))
    rows = urls.withColumn("__p", url_parts(F.col(url_col)))
    rows = rows.join(counted(by_origin, BROADCAST_ORIGINS), F.col("__p.origin") == F.col("__origin"), "left")
    path = F.col("__p.path")
    first = F.get(F.filter("__rules", lambda r: glob_matches(path, r["glob"])), F.lit(0))
    error = []
    if bodies is not None:
        failed = bodies.where("error IS NOT NULL").groupBy(url_parts(F.col("url"))["origin"].alias("__failed")).agg(F.min("error").alias("__error"))
        rows = rows.join(counted(failed, BROADCAST_ORIGINS), F.col("__p.origin") == F.col("__failed"), "left")
        error = [F.when(path != "/robots.txt", F.col("__error")).alias("robots_error")]
    return rows.select(*urls.columns, *error, (F.coalesce(first["allow"], F.lit(True)) | (path == "/robots.txt")).alias("allowed"))


def robots_documents(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """url of the robots.txt of each origin of http and https URLs, once."""
    root = F.regexp_extract(F.col(url_col), "^(https?://[^/?#]+)", 1)
    return urls.select(root.alias("root")).where("root <> ''").distinct().select(F.concat("root", F.lit("/robots.txt")).alias("url"))
