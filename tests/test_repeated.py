"""Queries against their SQL where several pages have one URL, at times also the same elements."""

import json

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteaudit.operators import crawl, elements
from siteaudit.plans import audit, queries
from tests.test_queries import SQL, rows_of


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest pages, of which each third has the URL of the page 24 before it, and each ninth its text too."""
    path = str(tmp_path_factory.mktemp("repeated"))
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    before = p.select((F.col("page_id") + 24).alias("page_id"), F.col("url").alias("first_url"), F.col("html").alias("first_html"))
    p = p.join(before, "page_id", "left").select("page_id", F.when(F.col("page_id") % 3 == 0, F.coalesce("first_url", "url")).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 9 == 0, F.coalesce("first_html", "html")).otherwise(F.col("html")).alias("html"))
    p.orderBy("page_id").coalesce(1).write.parquet(f"{path}/pages.parquet")
    assert p.select("url").distinct().count() < p.count()
    return path


def check(spark, path, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, path), db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


def test_anchors(spark, repeated):
    check(spark, repeated, "anchors")


def test_audit(spark, repeated):
    check(spark, repeated, "audit")


def test_latest_response(spark, repeated):
    check(spark, repeated, "latest_response")


def test_write_store(spark, repeated):
    check(spark, repeated, "write_store")


def test_stream_store(spark, repeated):
    check(spark, repeated, "stream_store")


def test_cache_lookup(spark, repeated):
    check(spark, repeated, "cache_lookup")


def test_document_metrics(spark, repeated):
    check(spark, repeated, "document_metrics")


def test_stream_metrics(spark, repeated):
    check(spark, repeated, "stream_metrics")


def test_html_links(spark, repeated):
    check(spark, repeated, "html_links")


def test_latest_bodies(spark, repeated):
    check(spark, repeated, "latest_bodies")


def test_report_json(spark, repeated):
    """Every element is there; where two have one place the SQL leaves their order open, so it isn't compared."""
    parts = lambda rows: sorted((r[0], sorted(json.loads(r[1])["elements"], key=json.dumps)) for r in rows)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{repeated}/pages.parquet/*.parquet'")
    got = entry.queries()["report_json"](spark, repeated).select("url", "json").collect()
    assert parts(got) == parts(db.execute(SQL["report_json"]).fetchall())


def test_report_json_sink(spark, repeated):
    check(spark, repeated, "report_json_sink")


def test_report_lines(spark, repeated):
    """Every line is there, in places without gaps; where two elements have one place the SQL leaves their order open, so it isn't compared."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{repeated}/pages.parquet/*.parquet'")
    got = [tuple(r) for r in entry.queries()["report_lines"](spark, repeated).select("doc_url", "place", "line").collect()]
    want = db.execute(f"SELECT doc_url, place, line FROM ({SQL['report_lines']})").fetchall()
    assert sorted((u, x) for u, _, x in got) == sorted((u, x) for u, _, x in want)
    assert sorted((u, k) for u, k, _ in got) == sorted((u, k) for u, k, _ in want)


def test_report_text_sink(spark, repeated):
    check(spark, repeated, "report_text_sink")


def test_run_metrics(spark, repeated):
    check(spark, repeated, "run_metrics")


def test_summary_table(spark, repeated):
    check(spark, repeated, "summary_table")


@pytest.mark.parametrize("name", ["run_metrics", "summary_table", "stream_metrics"])
@pytest.mark.parametrize("rows", [[], [(0, None, None), (1, "https://a.example.com/", None)], [(k, "https://a.example.com/", f'<a href="/{"p" * k}">x</a>') for k in range(9)]], ids=["no_page", "no_link", "one_url"])
def test_totals_of_odd_pages(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check(spark, str(tmp_path), name)


def test_split_markup_errors(spark, repeated):
    check(spark, repeated, "split_markup_errors")


def test_stream_dedup(spark, repeated):
    check(spark, repeated, "stream_dedup")


def test_element_rows_are_sent_on_by_the_thousand():
    docs = pa.RecordBatch.from_pydict({"url": ["a", "b", "c"], "html": ["<i>" * 2500, None, "<b>" * 700], "svg": [False] * 3})
    sent = list(elements._element_rows([docs]))
    assert max(b.num_rows for b in sent) == elements.ROWS
    assert [(r["doc_url"], r["ord"]) for b in sent for r in b.to_pylist()] == [("a", i) for i in range(2500)] + [("c", i) for i in range(700)]


def test_crawl_goes_several_hops_a_round(spark, monkeypatch):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("n29", "n3"), ("n5", "n17"), ("n17", "a"), ("a", "n20"), ("x", "n1")]
    roots, depths = ["n0", "a"], {"n0": 0, "a": 0}
    for url in roots:  # grows while it is read
        for dst in sorted(d for s, d in pairs if s == url and d not in depths):
            depths[dst] = depths[url] + 1
            roots.append(dst)
    rounds, cut = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda x, name: (rounds.append(name), cut(x, name))[1])
    edges, start = spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n0",), ("a",)], "url string")
    assert {r.url: r.depth for r in crawl.crawl_depth(edges, start).collect()} == depths
    assert rounds.count("reached") <= 1 + max(depths.values()) // crawl.HOPS
    assert {r.url: r.depth for r in crawl.crawl_depth(edges, start, 10).collect()} == {u: k for u, k in depths.items() if k <= 10}
    monkeypatch.setattr(crawl, "HOPS_ROWS", 0)
    assert {r.url: r.depth for r in crawl.crawl_depth(edges, start).collect()} == depths


def test_a_batch_of_a_stream_has_a_file_for_each_core(spark):
    df, path, files = queries._folder(spark.range(1000).repartition(1), "arrivals", 3)
    assert files == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(path).count() == 1000 and len(spark.read.parquet(path).inputFiles()) == 3 * files


@pytest.mark.parametrize("name", ["site_audit", "site_metrics"])
def test_responses_of_a_site_audit_do_not_read_the_documents(spark, sf_dir, monkeypatch, name):
    plans, site_audit = [], audit.site_audit
    monkeypatch.setattr(audit, "site_audit", lambda docs, responses, *rest: (plans.append(responses.inputFiles()), site_audit(docs, responses, *rest))[1])
    entry.queries()[name](spark, sf_dir)
    assert plans and not any("pages.parquet" in f for f in plans[0])
