"""Schemas (as DDL), readers and writers of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSES = ("url string, status int, headers map<string,string>, body binary, duration_ms long, fetched_at timestamp, request_error string")
SITES = (
    "site string, host string, path string, recursive boolean, schemes array<string>, statuses array<int>, max_redirects int, max_age_ms long, swr_ms long, ignored_fragments array<string>, "
    "retry_count int, retry_factor double, retry_initial_ms long, retry_cap_ms long, retry_statuses array<int>, rate_supply long, rate_window_ms long, "
    "validate_html boolean, html_ignored_elements array<string>, html_ignored_attributes array<string>, validate_svg boolean, svg_ignored_elements array<string>, svg_ignored_attributes array<string>"
)
RESULTS = ("doc_url string, ord int, item int, ok boolean, error_kind string, error string, response struct<url:string,status:int,latency:long>")
REQUEST_LOG = ("site string, url string, ts timestamp")
#: Options of a site that says nothing else.
SITE_DEFAULTS = {"site": "default", "host": None, "path": "/", "recursive": False, "schemes": ["http", "https"], "statuses": [200], "max_redirects": 16, "max_age_ms": 0, "swr_ms": 0, "ignored_fragments": [], "retry_count": 0, "retry_factor": 0.0, "retry_initial_ms": 0, "retry_statuses": [], "validate_html": False, "validate_svg": False}


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Fetched responses, one row for each URL; header names are in lower case from here on."""
    rows = spark.read.schema(RESPONSES).parquet(path)
    return rows.withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))


def read_sites(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Resolved site options as a dimension. What a row leaves out has its default; a row without a host is the default site."""
    names = [field.split()[0] for field in SITES.split(", ")]
    filled = [SITE_DEFAULTS | r for r in rows]
    if not any(r["host"] is None for r in filled):
        filled.append(SITE_DEFAULTS)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], SITES)


#: Responses of a bucket of the store, on average.
BUCKET_ROWS = 50_000


def write_store(responses: DataFrame, path: str, buckets: int | None = None, keys: list[str] | None = None) -> None:
    """Persist the latest response of each URL (or of each value of keys, see latest_response), in folders by a hash of the URL; without a number of buckets there is one for every BUCKET_ROWS rows.

    Rows with bodies are dealt by bucket when only the latest are left, others once before: the latest are found in the same partitions. Each folder gets one file.
    """
    from siteaudit.operators.store import latest_response

    buckets = buckets or -(-responses.count() // BUCKET_ROWS) or 1
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    if "body" in responses.columns:
        last = latest_response(responses, keys).withColumn("bucket", bucket).repartition(buckets, "bucket")
    else:
        last = latest_response(responses.withColumn("bucket", bucket).repartition(buckets, "bucket"), ["bucket", *(keys or ["url"])])
    last.write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_store_table(responses: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """The latest response of each URL as a table of the catalog, dealt and sorted by url into buckets (one for every BUCKET_ROWS rows): joins on url read it as it lies."""
    from siteaudit.operators.store import latest_response

    last = latest_response(responses)
    buckets = buckets or -(-responses.count() // BUCKET_ROWS) or 1
    last.repartition(buckets, "url").write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, "url").sortBy("url").saveAsTable(name)
    return responses.sparkSession.table(name)


def write_report_json(report: DataFrame, path: str) -> None:
    """One JSON line for each document of a nested report."""
    from siteaudit.operators.report import report_json

    report_json(report).select("json").write.mode("overwrite").text(path)


def write_report_text(lines: DataFrame, path: str) -> None:
    """The text lines of operators.report.report_lines, sorted by document within each file."""
    lines.repartitionByRange("doc_url").sortWithinPartitions("doc_url", "place").select("line").write.mode("overwrite").text(path)
