"""Fitted operators by held-out accuracy and brute force; the pipeline stage by stage."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteaudit.llm import ann, quality, queries, toxicity
from siteaudit.sources.scratch import cut, scratch
from tests.llm.test_simhash import plain_similar
from tests.llm.test_text_ops import plain_groups, tokens_of

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (5, "a " * 30_000), (6, "Ünï 漢字"), (6, "Ünï 漢字"), (None, "idiot")]


@pytest.fixture(scope="module")
def halves(spark):
    """Labelled documents of which the model sees one half."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")


@pytest.fixture(scope="module")
def model(halves):
    return toxicity.train(halves[0], halves[1])


def test_toxicity_on_held_out_documents(halves, model):
    docs, _, unseen = halves
    rated = toxicity.rate(docs, model).join(unseen.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    bad, clean = [r for r in rated if r.y], [r for r in rated if not r.y]
    assert sum(r.toxic for r in bad) >= 0.85 * len(bad) and sum(r.toxic for r in clean) <= 0.005 * len(clean)
    assert np.mean([r.expected_severity for r in bad]) > 1.3 > 0.1 > np.mean([r.expected_severity for r in clean])


def test_toxicity_query_is_the_model(spark, sf_dir):
    """Every row by the model's definition, without Spark."""
    from xxhash import xxh64_intdigest

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fitted, got = toxicity.train(docs, labels), {r.doc_id: r for r in queries.op1_toxicity(spark, sf_dir).collect()}
    assert len(got) == docs.count() and fitted.weights
    for r in docs.collect():
        counts = {}
        for w in re.findall(r"[^\W_]+", r.text.lower()):
            b = xxh64_intdigest(w) % toxicity.BUCKETS
            counts[b] = counts.get(b, 0) + 1
        score = sum(fitted.weights.get(b, 0.0) * math.log(1 + n) for b, n in counts.items())
        above = [1 / (1 + math.exp(t - score)) for t in fitted.thresholds]
        own = got[r.doc_id]
        assert abs(own.expected_severity - sum(above)) < 1e-9 and abs(own.p_toxic - above[0]) < 1e-9
        assert own.grade == sum(score >= t for t in fitted.thresholds) and own.toxic == (own.grade > 0)


def test_a_repeated_identifier_is_one_row_of_the_fit(spark):
    words = ["idiot", "fool", "fine", "good"]
    rows = [(i, f"{words[i % 4]} {words[i % 2]} {i % 3}") for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = once.unionByName(once.where("doc_id = 4").crossJoin(spark.range(5000)).drop("id"))
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(many, labels, "toxic", 10).select("id").distinct().count() == 10
    assert toxicity.train(many, labels) == toxicity.train(once, labels)


def test_severity_is_ordinal(model):
    assert len(model.thresholds) == toxicity.GRADES and model.thresholds == sorted(model.thresholds)
    above = [model.above(s) for s in (-5.0, 0.0, 2.0, 8.0)]
    assert all(a == sorted(a, reverse=True) for a in above) and [sum(a) for a in above] == sorted(sum(a) for a in above)


def test_fit_finds_shared_weights():
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (1500, 12)).astype(float)
    score = np.log1p(x) @ np.array([3, -2, 1.5] + [0] * 9)
    grades = np.digitize(score + rng.logistic(size=1500), [1, 3, 5])
    rows, cols = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(grades, (rows, cols, x[rows, cols], 12), penalty=1e-3, rounds=600)
    assert np.allclose(weights[:3], [3, -2, 1.5], atol=0.6) and np.abs(weights[3:]).max() < 0.4 and np.allclose(np.diff(thresholds), 2, atol=0.5)


def test_toxicity_of_odd_texts_and_labels(spark, model):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("grade", F.lit(5)).withColumn("rated", F.lit(5)).withColumn("doc", F.lit(1))
    rated = toxicity.rate(df, model).collect()
    assert len(rated) == len(ODD) and all(0 <= r.expected_severity <= toxicity.GRADES for r in rated)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() >= 7
    for labels in ([], [(1, 0), (2, None)], [(4, 1)]):
        nothing = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert toxicity.rate(df, nothing).where("toxic").count() == 0
    assert toxicity.rate(df.where("false"), model).count() == 0


def test_quality_on_held_out_documents(halves):
    docs, seen, unseen = halves
    ratio = quality.train(docs, seen)
    share = quality.good_share(seen)
    got = quality.resample(docs, ratio, share).cache()
    n = docs.count()
    assert got.count() == n and got.where("kept").count() == math.ceil(round(share * 1_000_000) * n / 1_000_000)
    known = got.join(unseen.select("doc_id", "quality"), "doc_id").collect()
    good, junk = [r for r in known if r.quality], [r for r in known if not r.quality]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(r.kept for r in junk) <= 0.1 * len(junk)
    ranks = sorted((r.rank, -r.gumbel_key, r.doc_id) for r in got.collect())
    assert [r[0] for r in ranks] == list(range(1, n + 1)) and ranks == sorted(ranks, key=lambda r: r[1:])


def test_quality_counts_everything(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in docs.collect():
        counts = np.bincount(quality.ngram_buckets(r.text, quality.Hashes()), minlength=quality.BUCKETS)
        raw += counts
        target += counts * (r.doc_id in good)
    p = [np.log((x + 1) / (x.sum() + quality.BUCKETS)) for x in (target, raw)]
    assert np.allclose(quality.train(docs, labels).log_ratio, p[0] - p[1])


def test_quality_query_is_brute_force(spark, sf_dir):
    """Log weights, keys, ranks and kept rows of all documents, without Spark but for the model."""
    from xxhash import xxh64_intdigest

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ratio, known = quality.train(docs, labels).log_ratio, [r.quality for r in labels.collect() if r.quality is not None]
    want = []
    for r in docs.collect():
        tokens = re.findall(r"\w+|[^\w\s]+", r.text or "")
        h, two = [xxh64_intdigest(t) >> 1 for t in tokens], (1 << 64) - 1
        buckets = [x % quality.BUCKETS for x in h] + [(((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F & two) >> 40) % quality.BUCKETS for a, b in zip(h, h[1:])]
        weight = sum(ratio[b] for b in buckets) if buckets else quality.NOTHING
        seed = xxh64_intdigest((11).to_bytes(4, "little"), 42)
        u = ((xxh64_intdigest(r.doc_id.to_bytes(8, "little"), seed) >> 11) + 0.5) / (1 << 53)
        want.append((-(weight - math.log(-math.log(u))), r.doc_id, weight))
    want.sort()
    k = math.ceil(round(sum(x > 0 for x in known) / len(known) * 1_000_000) * len(want) / 1_000_000)
    got = sorted(queries.op2_quality(spark, sf_dir).collect(), key=lambda r: r.rank)
    assert [r.doc_id for r in got] == [i for _, i, _ in want] and [r.kept for r in got] == [n < k for n in range(len(want))]
    assert np.allclose([r.log_weight for r in got], [w for *_, w in want]) and np.allclose([r.gumbel_key for r in got], [-x for x, *_ in want])


def test_quality_of_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("rank", F.lit(5)).withColumn("good", F.lit(5))
    ratio = quality.train(df, spark.createDataFrame([(4, 1), (4, 1), (None, 1)], "doc_id long, quality int"))
    got = quality.resample(df, ratio, 0.5).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 4 and {r.log_weight for r in got if r.doc_id in (1, 2, 3)} == {quality.NOTHING}
    assert quality.resample(df.where("false"), ratio, 0.5).count() == 0


def near_by_force(rows, every=20, k=20):
    width = max(len(v) for _, v in rows)
    ids, x = np.array([r[0] for r in rows]), np.array([list(v) + [0.0] * (width - len(v)) for _, v in rows], np.float64)
    for i in np.flatnonzero(ids % every == 0):
        score = np.einsum("ij,j->i", x, x[i])
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -score[others]))][:k]
        yield ids[i], [(int(ids[j]), float(score[j])) for j in best]


def test_recall(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in queries.op7_ann(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    found = total = 0
    for q, best in near_by_force(rows):
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0])) and len(got[q]) == 20
        found += len({i for i, _ in got[q]} & {i for i, _ in best})
        total += 20
    assert found >= 0.9 * total


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [float(rng.integers(-2, 3)), float(rng.integers(-2, 3)) or 1.0]) for i in range(60)]
    rows += [(320, [1.0, 2.0, 3.0]), (321, [-1.0]), (340, [0.0, 0.0, 2.0])]  # other lengths
    odd = [(200, None), (220, [0.0, 0.0]), (240, [float("nan"), 1.0]), (260, [float("inf"), 1.0]), (280, [None, 1.0]), (300, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == dict(near_by_force(rows))
    few = ann.search(df.where("vec_id IN (0, 1, 2)"), F.col("id") == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in few) == [(1, 1), (2, 2)]
    assert ann.search(df.where("false"), F.col("id") == 0).count() == 0


def recall(spark, rows, every, **how):
    df, got, found, total = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {}, 0, 0
    for r in ann.search(df, F.col("id") % every == 0, **how).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, best in near_by_force(rows, every):
        found, total = found + len(got[q] & {i for i, _ in best}), total + len(best)
    return found / total


def clustered(n, dim, clusters, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.6 * rng.standard_normal((n, dim))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_parts_follow_the_vectors():
    assert [ann.parts_for(n) for n in (0, 40, 100, 500, 3_000, 3_100, 500_000, 600_000, 2_000_000, 10**12)] == [1, 1, 2, 8, 32, 64, 64, 128, 256, 1024]


@pytest.mark.parametrize("parts", [128, 256])
def test_recall_of_many_parts(spark, parts):
    assert recall(spark, clustered(9_000, 16, 300), 200, parts=parts) >= 0.9


def test_small_tables_have_parts_too(spark):
    rows = clustered(500, 32, 12)
    assert recall(spark, rows, 5) >= 0.9
    router, count, probes = ann.learn(np.array([v for _, v in rows], np.float32), ann.parts_for(500))
    assert count == 8 and probes < 8
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert ann.parts_for(len(docs)) >= 8 and recall(spark, docs, 5) >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(4).standard_normal((1200, 8)).astype(np.float32)
    part, count = ann.balanced_parts(ann.neighbour_graph(x), 8)
    sizes = np.bincount(part, minlength=count)
    assert count == 8 and sizes.max() <= 1.1 * 150 + 1
    graph = ann.neighbour_graph(x)
    assert (part[graph] == part[:, None]).mean() > 2 / 8


# --- the pipeline ---


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    grades = {r.doc_id: r.grade for r in toxicity.rate(docs, model).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir), name)
        got = sorted(r.doc_id for r in out.collect())
        texts = [(i, r.text) for i, r in rows.items()]
        if name == "toxicity":
            want = sorted(i for i in rows if grades[i] == 0)
        elif name == "exact_dedup":
            want = sorted(i for i, keep, _ in plain_groups(texts) if i == keep)
        elif name == "simhash_near_dedup":
            near = plain_similar(texts)
            want = sorted(i for i in rows if near[i] == i)
            assert len(set(got) - set(want)) <= 1 and set(want) <= set(got)  # nothing clean goes; a link may be missed
            want = got
        elif name == "mixing":
            want = got
            assert set(got) <= set(rows) and max(got.count(i) for i in got) <= queries.MIX_EPOCHS
            tokens = {i: len(r.text.split()) for i, r in rows.items()}
            budget = sum(tokens.values()) * 6 // 10
            leaves = len({(r.lang, r.source) for r in rows.values()})
            assert abs(sum(tokens[i] for i in got) - budget) <= leaves * max(tokens.values()) / 2
        else:
            want = sorted(rows_of_docs)
            for r in out.collect():
                ids = np.array(tokens_of(rows[r.doc_id].text), "<u4").tobytes()
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest())
        assert got == want
        if name != "bpe":
            assert out.columns == columns and all(tuple(r) == tuple(rows[r.doc_id]) for r in out.collect())
            docs, rows_of_docs = out, got
            rows = {i: rows[i] for i in set(got)}
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in out.collect())


def test_pipeline_of_odd_documents(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, t, "en", "src1", 5) for i, t in ODD if i is not None] + [(20, text, None, None, None), (21, text + " more", "en", None, 1), (22, text, "en", "src0", 1)]
    folder = scratch(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, folder), name)
        kept.append(docs.count())
    assert kept[:3] == [10, 7, 5]
    empty = scratch(spark, "tables")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
