"""Streams in the order of time against their SQL: whatever the page_ids are, and however many files a part comes in."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import SQL, rows_of


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """Forty pages and 300 events of the smallest tables, each event twice."""
    path = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("page_id < 40").coalesce(1).write.parquet(f"{path}/pages.parquet")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 300")
    e.unionByName(e).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def check(spark, path, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    if name == "stream_rate":
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, path), db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("step, first", [(997, 0), (10**13, -(10**14))])
def test_pages_of_any_ids_await_their_responses(spark, few, tmp_path, step, first):
    p = spark.read.parquet(f"{few}/pages.parquet").withColumn("page_id", F.col("page_id").cast("long") * step + first)
    long = F.when(F.col("page_id") == first, F.concat("html", F.lit(f'<a href="/{"p" * 40000}">x</a><a href="/{"q" * 40001}">x</a>'))).otherwise(F.col("html"))
    p.withColumn("html", long).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check(spark, str(tmp_path), "stream_awaited")


def test_no_page_awaits_a_response(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check(spark, str(tmp_path), "stream_awaited")


@pytest.mark.parametrize("name", ["stream_awaited", "stream_dedup", "stream_rate"])
def test_no_row_is_late_in_a_part_of_many_files(spark, few, name):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 4)
    try:
        check(spark, few, name)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
