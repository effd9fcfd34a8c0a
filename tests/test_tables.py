"""Redirect chains, schedules, stores and crawls against plain loops, and what their plans move."""

import random
import re

from pyspark.sql import functions as F

from siteaudit.operators import bloom, crawl, redirects, requestlog, store
from siteaudit.sources import tables
from siteaudit.sources.scratch import scratch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def follow(to, url, most):
    """final_url, hops, error of one chain, hop by hop. to: url to (next, error)."""
    at, hops = url, 0
    while at in to:
        hops += 1
        if hops > most:
            return None, most, "too_many_redirects"
        at, error = to[at]
        if error:
            return None, hops, error
    return at, hops, None


def test_redirect_chains(spark, monkeypatch):
    rng = random.Random(1)
    host = "http://h/"
    to = {f"{host}c{i}": (f"{host}c{i + 1}", None) for i in range(18)} | {f"{host}l{i}": (f"{host}l{(i + 1) % 3}", None) for i in range(3)} | {f"{host}self": (f"{host}self", None), f"{host}in": (f"{host}l0", None)}
    to |= {f"{host}e0": (f"{host}e1", None), f"{host}e1": (None, "redirect_location"), f"{host}c18": (None, "redirect_location")}
    to |= {f"{host}r{i}": (f"{host}r{rng.randrange(60)}", None) for i in range(40)}
    rows = [(u, 301, {"location": v} if v else {}) for u, (v, _) in to.items()] + [(f"{host}r{i}", 200, {"location": "/no"}) for i in range(40, 60)]
    df = spark.createDataFrame(rows, "url string, status int, headers map<string,string>")
    rounds = []
    cut = redirects.cut
    monkeypatch.setattr(redirects, "cut", lambda x, name: (rounds.append(name), cut(x, name))[1])
    for most in (0, 1, 2, 3, 5, 16, 17, 18, 100):
        rounds.clear()
        got = {r.url: (r.final_url, r.hops, r.error) for r in redirects.resolve_redirects(df, most).collect()}
        assert got == {u: follow(to, u, most) for u in to}, most
        assert len(rounds) <= 1 + max(1, most.bit_length())  # the edges, then 5 rounds for 16 hops


def plain_schedule(rows, supply, window, overall, window_all):
    """rows: (id, site, microseconds). One request after the other; a limiter is the window it is in and the tokens left."""

    def limiter(n, w):
        at, left = 0, n

        def slot(time):
            nonlocal at, left
            if time // w > at:
                at, left = time // w, n
            if left == 0:
                at, left = at + 1, n
            left -= 1
            return at

        return slot

    sites, sent, slots = {}, [], {}
    for i, site, time in sorted(rows, key=lambda r: (r[2], r[0])):
        s = slots[i] = sites.setdefault(site, limiter(supply, window))(time)
        sent.append((max(time, s * window), time, i))
    of_all = limiter(overall, window_all)
    return {i: (slots[i], of_all(at)) for at, _, i in sorted(sent)}


def test_schedule_by_arrival(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(("a", "a", "a", "b", "c", None)), rng.randrange(40_000_000) if rng.random() < 0.7 else 9_000_000) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, site string, us long").withColumn("ts", F.timestamp_micros("us"))
    for supply, overall in ((1, 3), (4, 2), (100, 1)):
        got = {r.id: (r.slot, r.overall_slot) for r in requestlog.rate_limited_schedule(df, supply, ["id"], "ts", 3, (overall, 2)).collect()}
        assert got == plain_schedule(rows, supply, 3_000_000, overall, 2_000_000)
    assert requestlog.rate_limited_schedule(df.limit(0), 1, ["id"], "ts", 3, (1, 2)).count() == 0


def test_bodies_come_last(spark, monkeypatch):
    rows = [("u", 1, 200, b"old"), ("u", 3, 200, b"new"), ("u", 3, 199, b"no"), ("v", None, None, None), ("w", 2, 200, b""), ("w", 1, 500, b"x")]
    df = spark.createDataFrame(rows, "url string, h int, status int, body binary").select("url", F.timestamp_seconds("h").alias("fetched_at"), "status", "body")
    path, plans = scratch(spark, "store"), []
    df.write.parquet(path)
    cut = store.cut
    monkeypatch.setattr(store, "cut", lambda x, name: (plans.append((name, plan_of(x))), cut(x, name))[1])
    want = [("u", b"new"), ("v", None), ("w", b"")]
    for source in (df, spark.read.parquet(path), spark.read.parquet(path).unionByName(spark.read.parquet(path))):
        last = store.latest_response(source)
        assert last.columns == df.columns
        assert sorted((r.url, bytes(r.body) if r.body is not None else None) for r in last.collect()) == want
    found = [p for name, p in plans if name == "latest"]
    assert len(found) == 3 and all("Aggregate" in p and "body" not in p for p in found)
    assert "Aggregate" not in plan_of(last)


def test_lookups_leave_the_store_where_it_lies(spark):
    rows = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("request_error"), F.timestamp_seconds("id").alias("fetched_at"))
    kept = tables.write_store_table(rows.unionByName(rows), "store_of_test", scratch(spark, "table"), 4)
    asked = spark.range(400).select(F.concat(F.lit("u"), "id").alias("url"), F.timestamp_seconds("id").alias("now"), F.lit(0).cast("long").alias("max_age_ms"), F.lit(0).cast("long").alias("swr_ms"), F.array(F.lit(503)).alias("retry_statuses"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.cache_lookup(asked, kept)
        assert found.groupBy("lookup").count().collect() == [("hit", 300), ("miss", 100)] or {r.lookup: r["count"] for r in found.groupBy("lookup").count().collect()} == {"hit": 300, "miss": 100}
        plan = plan_of(found)
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE store_of_test")


def test_crawl_reads_the_frontiers_folders(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [(f"x{i}", f"y{i}") for i in range(200)] + [("n2", f"m{i}") for i in range(50)] + [("n3", "n0"), (None, "n1"), ("n1", None), ("n1", "n1")]
    df, roots = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",), ("x7",), (None,)], "url string")
    want = sorted([(f"n{i}", i) for i in range(7)] + [(f"m{i}", 3) for i in range(50)] + [("x7", 0), ("y7", 1)])
    assert sorted(tuple(r) for r in crawl.crawl_depth(df, roots).collect()) == want
    monkeypatch.setattr(crawl, "BUCKET_EDGES", 20)
    plans, cut = [], crawl.cut
    monkeypatch.setattr(crawl, "cut", lambda x, name: (plans.append(plan_of(x)) if name == "reached" else None, cut(x, name))[1])
    assert sorted(tuple(r) for r in crawl.crawl_depth(df, roots).collect()) == want
    filters = [len(re.search(r"bucket#\d+ (?:IN|=|INSET) ?\(?([^\])]*)", p[p.index("PartitionFilters") :])[1].split(",")) for p in plans]
    assert filters[0] <= 2 and filters[-1] == 1  # of thirteen folders


def test_bloom_loses_none(spark):
    keys = spark.range(0, 4000, 2).select(F.concat(F.lit("k"), "id").alias("a"), "id")
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("b"), F.col("id").alias("n")).unionByName(spark.createDataFrame([(None, 1)], "b string, n long"))
    got = bloom.may_meet(rows, ["b", "n"], keys, ["a", "id"])
    assert got.join(keys, (F.col("a") == F.col("b")) & (F.col("id") == F.col("n"))).count() == 2000 and got.count() < 2000 + 600
    assert bloom.may_meet(rows, ["b", "n"], keys.limit(0), ["a", "id"]).count() == 0


def test_streamed_store_is_merged_by_bucket(spark):
    from siteaudit.streaming import jobs

    def rows(batch):
        return spark.createDataFrame(batch, "url string, h int, status int").select("url", F.timestamp_seconds("h").alias("fetched_at"), "status", F.col("url").cast("binary").alias("body"))

    arrivals, path, state = scratch(spark, "arrivals"), scratch(spark, "store"), scratch(spark, "state")
    batches = [[(f"u{i}", 1, 200) for i in range(40)], [("u1", 3, 500), ("u2", 0, 404)], [("u1", 2, 301)]]
    schema, latest = rows(batches[0]).schema, {}
    assert jobs.read_store(spark, path, schema).count() == 0 and jobs.compact_store(spark, path, schema, 8) is None
    for n, batch in enumerate([*batches, [("u3", 9, 999)]]):
        rows(batch).coalesce(1).write.mode("append").parquet(arrivals)
        jobs.stream_store(jobs.read_stream(spark, arrivals, schema, 1), path, state, 8).awaitTermination()
        for url, h, status in batch:
            latest[url] = max(latest.get(url, (-1, 0)), (h, status))
        if n in (1, 3):
            assert jobs.compact_store(spark, path, schema, 8) == n and jobs.compact_store(spark, path, schema, 8) is None
        got = jobs.read_store(spark, path, schema)
        assert {r.url: r.status for r in got.collect()} == {u: s for u, (_, s) in latest.items()}
    newest, later, done = jobs._folders(spark, path)
    folders = [f for fs in newest.values() for f in fs]
    assert later == [] and done == 3 and not any("/batch=" in f for f in folders)
    assert sum("/base=3/" in f for f in folders) <= 2 and sum("/base=1/" in f for f in folders) >= 5  # only what is new was written again
