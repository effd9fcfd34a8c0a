"""Structured Streaming jobs over folders of Parquet files. Each returns a streaming DataFrame; run() writes one until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteaudit.functions.text import media_type
from siteaudit.operators.check import check_links, judged, with_site
from siteaudit.operators.extract import page_links
from siteaudit.operators.store import latest_response


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """New files of a folder, at most files of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def stream_results(pages: DataFrame, targets: DataFrame, sites: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Checked links of arriving pages (url, html): stateless extraction, then joins with tables of targets and sites."""
    return check_links(page_links(pages), targets, sites, ignored)


def stream_awaited(pages: DataFrame, responses: DataFrame, sites: DataFrame, wait: str, delay: str = "10 minutes", ignored: list[str] | None = None) -> DataFrame:
    """Checked links of arriving pages (url, html, fetched_at) whose targets' responses (url, status, headers, request_error, fetched_at) arrive too, before or after them.

    A link meets the responses of its target within wait of its page. One that has none is judged when the watermarks of both
    streams (delay behind their latest times) have passed that, as missing_response; until then both sides are state, after it
    they are dropped. A URL with several responses in that time gives its links a row for each. Links have linked_at.
    """
    # pages without links move time on too
    links = page_links(pages.withWatermark("fetched_at", delay), keep=["fetched_at"]).withColumnRenamed("fetched_at", "linked_at")
    rows = with_site(links, sites)
    media, none = media_type(F.col("headers")), F.lit(None).cast("string")
    answers = responses.select(F.col("url").alias("__url"), F.col("url").alias("final_url"), "status", media.alias("media"), "request_error", none.alias("redirect_error"), F.lit(True).alias("allowed"), F.col("fetched_at").alias("answered_at"))
    near = (F.col("answered_at") >= F.col("linked_at") - F.expr(f"INTERVAL {wait}")) & (F.col("answered_at") <= F.col("linked_at") + F.expr(f"INTERVAL {wait}"))
    met = rows.join(answers.withWatermark("answered_at", delay), (F.col("target_nofrag") == F.col("__url")) & near, "leftOuter")
    return judged(met, links.columns, ignored)


def stream_dedup(documents: DataFrame, delay: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Each final_url, or each value of keys, once; with a delay (of the column fetched_at) the state forgets them after it.

    A URL that comes again after the delay may be kept again or not, by the batches it comes in; with fetched_at among the
    keys only what is the same response, time included, is dropped, however it is batched.
    """
    keys = keys or ["final_url"]
    if delay is None:
        return documents.dropDuplicates(keys)
    return documents.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(keys)


def stream_metrics(results: DataFrame) -> DataFrame:
    """Running totals of ok and failed items."""
    return results.groupBy().agg(F.count_if(F.col("ok")).alias("success"), F.count_if(~F.col("ok")).alias("error"))


def stream_rate(log: DataFrame, supply: int, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Windows of a site (site, window_start, n) with more than supply requests; rows later than the delay are dropped, which bounds the state."""
    counts = log.withWatermark("ts", delay).groupBy("site", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > supply).select("site", F.col("w.start").alias("window_start"), "n")


def _with_bucket(responses: DataFrame, buckets: int) -> DataFrame:
    return responses.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int"))


def stream_store(responses: DataFrame, path: str, checkpoint: str, buckets: int = 16, keys: list[str] | None = None):
    """Start adding the latest response of each URL (or of each value of keys, see latest_response) of each batch to path, in a folder for each batch with one for each bucket of URLs; a batch that runs again replaces its own.

    read_store gives the latest of all, compact_store merges batches. All runs on one path have the same number of buckets and the same keys.
    """

    def put(batch: DataFrame, n: int) -> None:
        _with_bucket(latest_response(batch, keys), buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={n}")

    return responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> tuple[dict[int, list[str]], list[int], int]:
    """(bucket to the folders that hold its responses: its newest merged one and those of later batches; the later batches; the last batch that is merged) of a store. Folders without a mark of success don't count."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda p: [x.getPath().getName() for x in fs.listStatus(of(p))] if fs.exists(of(p)) else []
    found = [(kind, int(n)) for kind, _, n in (x.partition("=") for x in names(path)) if n.isdigit() and fs.exists(of(f"{path}/{kind}={n}/_SUCCESS"))]
    bases = sorted(n for kind, n in found if kind == "base")
    done = bases[-1] if bases else -1
    later = sorted(n for kind, n in found if kind == "batch" and n > done)
    inside = lambda folder: {int(b): f"{path}/{folder}/bucket={b}" for _, eq, b in (x.partition("=") for x in names(f"{path}/{folder}")) if eq}
    newest: dict[int, list[str]] = {}
    for n in bases:
        newest |= {b: [f] for b, f in inside(f"base={n}").items()}
    for n in later:
        for b, f in inside(f"batch={n}").items():
            newest.setdefault(b, []).append(f)
    return newest, later, done


def read_store(spark: SparkSession, path: str, schema: T.StructType, keys: list[str] | None = None) -> DataFrame:
    """The latest response of each URL that stream_store has added so far. Read are the merged folders and the batches after the last merge, however many there were before."""
    folders = [f for fs in _folders(spark, path)[0].values() for f in fs]
    return latest_response(spark.read.schema(schema).parquet(*folders), keys) if folders else spark.createDataFrame([], schema)


def compact_store(spark: SparkSession, path: str, schema: T.StructType, buckets: int = 16, keys: list[str] | None = None) -> int | None:
    """Merge the batches since the last merge; the number of the last one, or None if there are none. Only buckets with new rows are written again, into a folder of their own that counts once it is whole.

    Earlier folders stay for those who still read them; batches up to that number are not read any more.
    """
    newest, later, _ = _folders(spark, path)
    if not later:
        return None
    touched = [f for fs in newest.values() if any("/batch=" in f for f in fs) for f in fs]
    if touched:
        rows = _with_bucket(latest_response(spark.read.schema(schema).parquet(*touched), keys), buckets)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base={later[-1]}")
    return later[-1]


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream until its input is used up; complete and update results go to a folder for each batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", path).start().awaitTermination()
    else:
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
