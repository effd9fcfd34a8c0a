"""Stored responses: keep-latest and cache lookups."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.timing import freshness
from siteaudit.sources.scratch import counted, cut


#: Columns that are fetched last, for the rows that stay only.
WIDE = ["body"]


def _order() -> list:
    return [F.coalesce("fetched_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("status", F.lit(-1))]


def _by_row(store: DataFrame) -> list | None:
    """Columns __file and __row that tell the rows of store apart, if it comes straight from Parquet files and has each row of them once."""
    try:
        files = store.metadataColumn("_metadata")
        found = [files["file_path"].alias("__file"), files["row_index"].alias("__row")]
        twice = store.select(*found).groupBy("__file", "__row").count().where("count > 1").take(1)
    except AnalysisException:
        return None
    return None if twice else found


def latest_response(store: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last row of each URL, or of each value of keys (with the URL among them), by fetched_at, then status, so equal times give the same row again.

    Bodies don't take part in that: the last rows are found by time, status and place in their file, and bodies are read for
    those alone. A store that isn't read from files is written first. Without a body, rows are compared whole, and a task
    sends at most one of each URL. Rows that are already dealt by some of the keys aren't moved again.
    """
    keys = keys or ["url"]
    if not store.isStreaming and any(c in store.columns for c in WIDE):
        places = _by_row(store)
        if places is None:
            store = cut(store, "responses")
            places = _by_row(store)
        narrow = store.select(*keys, F.struct(*_order()).alias("o"), *places)
        last = narrow.groupBy(*keys).agg(F.max_by(F.struct("__file", "__row"), F.struct("o", "__file", "__row")).alias("at"))
        last = cut(last.select("at.__file", "at.__row"), "latest")
        return store.select(F.struct("*").alias("r"), *places).join(counted(last), ["__file", "__row"], "left_semi").select("r.*")
    rest = [c for c in store.columns if c not in keys]
    return store.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*_order())).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def cache_lookup(requests: DataFrame, store: DataFrame, now_col: str = "now") -> DataFrame:
    """requests with lookup: hit, stale_hit, expired, evicted or miss. requests: url, now, max_age_ms, swr_ms, retry_statuses. store: latest rows.

    Stored errors, and statuses that are retried, are evicted on read. A store that is a table by buckets of url
    (sources.tables.write_store_table) isn't shuffled.
    """
    kept = store.select(F.col("url").alias("__url"), F.col("status").alias("__status"), F.col("request_error").alias("__failed"), "fetched_at")
    rows = requests.join(kept, F.col("url") == F.col("__url"), "left")
    age = freshness(F.col("fetched_at"), F.col(now_col), F.col("max_age_ms"), F.col("swr_ms"))
    gone = F.col("__failed").isNotNull() | F.coalesce(F.array_contains("retry_statuses", F.col("__status")), F.lit(False))
    found = F.when(F.col("__url").isNull(), "miss").when(gone, "evicted").when(age == "fresh", "hit").when(age == "stale", "stale_hit").otherwise("expired")
    return rows.select(*requests.columns, found.alias("lookup"), F.col("__status").alias("stored_status"))


def revalidated(lookups: DataFrame) -> DataFrame:
    """lookups (lookup, stored_status, new_status, new_error) with outcome: a failed revalidation keeps a stale hit and fails an expired one."""
    failed = F.col("new_error").isNotNull()
    outcome = F.when(F.col("lookup") == "hit", F.lit("stored")).when(~failed, F.lit("fetched")).when(F.col("lookup") == "stale_hit", F.lit("stored")).otherwise("failed")
    return lookups.withColumn("outcome", outcome)
