"""URL filter: a blocked Bloom filter of listed URLs, then an exact join of its possible hits (operator 10).

DataFrame functions only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import small

#: Bits of a block, as words of 32 bits with one bit set in each, and bits spent on a listed URL.
WORDS, BITS_PER_URL = 8, 12
#: Blocks of a filter that is broadcast: at 40 bytes each 20 MB, for 10 million listed URLs. Beyond it the blocks are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


def url_host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; ASCII letters in lower case; empty for none."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; empty for none."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without a leading www. or m., path without .html and closing slashes, query without tracking parameters; no scheme, no fragment."""
    host = F.regexp_replace(url_host(url), "^(www|m)\\.", "")
    path = F.regexp_replace(url_path(url), "(\\.html)?/*$", "")
    query = F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(query, "(^|&)(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(F.length(query) > 0, F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null for none. rules: (verdict, host, path prefix), a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the bit it sets in each of the block's words."""
    bits = F.xxhash64(key, F.lit("bit"))
    masks = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: block, w0 ... w7. Partial aggregation keeps a row for each block and task before the shuffle."""
    block, masks = _place(F.col(key), blocks)
    marked = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", listed_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Verdict for each row of pages: its longest fitting rule's, else block if its canonical URL is listed, else allow.

    listed holds URLs in any form and may repeat them. Result: keep, host, path, rule, verdict. A null URL,
    or one without ://, has an empty host and path, fits no rule, is never listed and so is allowed. Repeated
    rows give repeated rows. An empty list blocks nothing. Columns besides keep and url_col are left out.
    """
    keys = listed.select(canonical_url(F.col(listed_col)).alias("listed_key")).where(F.col("listed_key") != "").distinct()
    blocks = max(1, math.ceil(keys.count() * BITS_PER_URL / (32 * WORDS)))
    table = small(bloom_blocks(keys, "listed_key", blocks), blocks, BROADCAST_BLOCKS)

    url = F.col("__url")
    judged = pages.select(*[F.col(c) for c in keep], F.col(url_col).alias("__url"))
    judged = judged.select(*keep, "__url", url_host(url).alias("host"), url_path(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = judged.select(*keep, "__url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    out = [*keep, "host", "path", "rule", "verdict"]
    by_rule = judged.where("rule IS NOT NULL").select(*out)
    key = F.coalesce(canonical_url(url), F.lit(""))
    block, masks = _place(F.col("__key"), blocks)
    rest = judged.where("rule IS NULL").select(*keep, "host", "path", "rule", key.alias("__key"))
    probed = rest.withColumn("__block", block).join(table, F.col("__block") == F.col("block"), "left")
    passes = F.lit(True)
    for i, m in enumerate(masks):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    probed = probed.select(*keep, "host", "path", "rule", "__key", passes.alias("__maybe"))
    # the two branches read the narrow url column again instead of shuffling every page
    clear = probed.where(~F.col("__maybe")).select(*keep, "host", "path", "rule", F.lit("allow").alias("verdict"))
    hits = probed.where("__maybe").join(keys, F.col("__key") == F.col("listed_key"), "left")
    hits = hits.select(*keep, "host", "path", "rule", F.when(F.col("listed_key").isNull(), F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))
    return by_rule.unionByName(clear).unionByName(hits)
