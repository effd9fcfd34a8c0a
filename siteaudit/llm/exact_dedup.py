"""Exact dedup as a stream with keyed state on disk, and a comparison of full texts on each hit (operator 6)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siteaudit.llm.common import SPACES, cut, scratch, small, text_of

# Many small stores: no space is allocated ahead, and commits write changes only.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Texts are equal if this is: each run of white space is one space; null is empty."""
    return F.regexp_replace(text_of(text), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _locators(docs: DataFrame) -> tuple[Column, Column] | None:
    """Hash of the file's path and the row's number in that file, whatever the columns of docs are named; None if docs doesn't come straight from Parquet files."""
    try:
        files = docs.metadataColumn("_metadata")
        found = F.xxhash64(files["file_path"]).alias("file"), files["row_index"].alias("row")
        docs.select(*found).schema  # noqa: B018  fails here if there are none
        return found
    except AnalysisException:
        return None


def _located_once(docs: DataFrame) -> bool:
    """Whether docs comes straight from Parquet files and has each row of them once at most: a join, an explode or a union may repeat rows. Reads no column of the files."""
    found = _locators(docs)
    return found is not None and not docs.select(*found).groupBy("file", "row").count().where("count > 1").take(1)


def _located(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """id, text, digest and the content locator (see _locators)."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), *_locators(docs)).withColumn("digest", digest(F.col("text")))


def keyed_state(rows: DataFrame) -> DataFrame:
    """rows: a stream of id, file, row, digest. State for each digest, without expiry: the smallest (id, file, row) and the number of rows.

    The partial aggregate runs before the shuffle, so a digest that a third of all rows share moves as one row from each task.
    """
    return rows.groupBy("digest").agg(F.min(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))


def start_stream(rows: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Run keyed_state over what has arrived and end. Changed groups of each batch go to out/batch=N; a batch that runs again replaces its folder.

    A later call with the same checkpoint goes on where this one ended.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return keyed_state(rows).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest_groups(spark, out: str, id_type: str) -> DataFrame:
    """The last state of each digest that start_stream wrote."""
    groups = spark.read.schema(f"digest binary, keep struct<id:{id_type},file:bigint,row:bigint>, n bigint, batch int").parquet(out)
    return groups.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("last")).select("digest", "last.keep", "last.n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, from_files: bool = False) -> DataFrame:
    """One row for each row of docs: id, file, row, keep_id, group_size, kept, text_sha256.

    Texts are equal as normalised() says. Of equal texts the smallest id stays, of the same id the first
    locator; a null id is the smallest. Null and empty texts are one group. An empty table gives no rows. Other
    columns of docs play no part, whatever their names. from_files: docs is one Parquet read (perhaps filtered),
    whose files and row numbers are the locators; else, or if it isn't, or if it has a row of a file more than once, docs
    is written once and read from there.

    A digest only proposes: each hit's full text is compared with the text of the row that stays, and where a
    digest stands for different texts its rows are grouped anew by the full texts.
    """
    if not from_files or not _located_once(docs):
        docs = cut(docs.select(id_col, text_col), "texts")
    return _groups(docs, id_col, text_col, digest)


def _groups(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """exact_groups of a table whose rows have locators of their own."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    located = _located(docs, id_col, text_col, digest)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    rows_path, groups_path = scratch(spark, "digests"), scratch(spark, "groups")
    located.select("id", "file", "row", "digest", sha.alias("text_sha256")).write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)

    session = spark.newSession()  # the state store is its own setting, not the caller's
    for k, v in STATE_SETTINGS.items():
        session.conf.set(k, v)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = session.readStream.schema(rows.schema).parquet(rows_path).select("id", "file", "row", "digest")
    start_stream(stream, scratch(spark, "state"), groups_path).awaitTermination()
    if not rows.take(1):
        return rows.select("id", "file", "row", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    groups = cut(latest_groups(spark, groups_path, id_type), "latest")
    # both sides come straight from tables, so that adaptive execution can split a hot digest
    all_rows = rows.join(groups, "digest").withColumn("kept", (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))
    out = all_rows.select("id", "file", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", "text_sha256", "digest")

    hits = cut(all_rows.where(~F.col("kept")).select("file", "row", "digest", F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row")), "hits")
    n_hits = hits.count()
    if n_hits == 0:
        return out.drop("digest")
    texts = located.select("file", "row", "text")
    keepers = hits.select(F.col("keep_file").alias("file"), F.col("keep_row").alias("row")).distinct()
    hit_texts = texts.join(small(hits, n_hits), ["file", "row"])
    keep_texts = texts.join(small(keepers, n_hits), ["file", "row"]).select(F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("text").alias("keep_text"))
    differ = cut(hit_texts.join(keep_texts, ["keep_file", "keep_row"]).where(F.col("text") != F.col("keep_text")).select("digest").distinct(), "differ")
    if not differ.take(1):
        return out.drop("digest")
    again = located.join(small(differ, differ.count()), "digest").withColumn("text_sha256", sha)
    each = again.groupBy("digest", "text").agg(F.min(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    each = again.join(each, ["digest", "text"]).select("id", "file", "row", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"), "text_sha256")
    return out.join(differ, "digest", "left_anti").drop("digest").unionByName(each)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier row has. All columns stay as they are, whatever their names.

    Null and empty texts are one group, of which one row stays; of equal texts the smallest id stays, a null id
    being the smallest, and of rows with the same id and text the first one. An empty table stays empty. A table
    that doesn't come straight from Parquet files, or repeats rows of them, is written first.
    """
    if not _located_once(docs):
        docs = cut(docs, "docs")
    gone = cut(_groups(docs, id_col, text_col).where(~F.col("kept")).select("file", "row"), "gone")
    n = gone.count()
    if n == 0:
        return docs
    # a row travels as one value, so that no name of its own can clash
    marked = docs.select(F.struct("*").alias("doc"), *_locators(docs))
    return marked.join(small(gone, n), ["file", "row"], "left_anti").select("doc.*")
