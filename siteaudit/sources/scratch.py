"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest table, in rows and in bytes as its schema suggests, that is broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000
#: Bytes that a value of a type is taken for; other types count as much as text.
WIDTHS, WIDE = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}, 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a temporary one; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("siteaudit.scratch.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("siteaudit.scratch.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    base = spark.conf.get("siteaudit.scratch.run", None) or shared_dir(spark)
    return f"{base}/siteaudit-{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What is written to scratch inside goes at the end: results that are still needed must be written elsewhere by then."""
    own = f"{shared_dir(spark)}/siteaudit-run-{uuid.uuid4().hex[:12]}"
    spark.conf.set("siteaudit.scratch.run", own)
    try:
        yield
    finally:
        spark.conf.unset("siteaudit.scratch.run")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there, and lost executors don't bring the work before it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit and, by the width of its schema, within BROADCAST_BYTES, else df as it is."""
    width = sum(WIDTHS.get(f.dataType.typeName(), WIDE) for f in df.schema.fields)
    return F.broadcast(df) if rows <= limit and rows * width <= BROADCAST_BYTES else df


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has limit rows or fewer and its values, written as JSON, take BROADCAST_BYTES or fewer, else df as it is. One aggregate says both, so texts and arrays count by their real length."""
    told = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return F.broadcast(df) if told["rows"] <= limit and (told["bytes"] or 0) <= BROADCAST_BYTES else df
