"""Toxicity by cumulative-link ordinal regression on sparse word features (operator 1)."""

from __future__ import annotations

import dataclasses
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import slices, text_of, words_pattern

#: Hashed words; labelled rows that the fit takes at most, those with the smallest hash of their identifier.
BUCKETS, SAMPLE = 1 << 18, 8192
#: A word counts in the fit from so many sampled documents on.
MIN_DOCS = 5
#: Severity grades above 0, and the lift (in nats) from which a word speaks for toxicity when grades are made from labels.
GRADES, LIFT = 3, 2.0
#: Penalties on the weights: the first fit chooses words, the second one, over these words only, hardly shrinks them.
CHOICE, SHRINK = 2e-3, 1e-4
#: Words whose bucket a worker keeps.
MEMO = 300_000


class Buckets(dict):
    """Bucket of each word; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        b = self[word] = xxh64_intdigest(word) % BUCKETS
        return b


def words_of(text: str) -> list[str]:
    return words_pattern().findall(text.lower())


@dataclasses.dataclass
class OrdinalModel:
    """P(grade >= k) is the logistic function of the shared score, less the k-th threshold. weights: bucket to weight, zeros left out."""

    weights: dict[int, float]
    thresholds: list[float]

    def above(self, score: float) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]

    def score(self, counts: dict[int, int]) -> float:
        return sum(self.weights[b] * math.log1p(n) for b, n in counts.items() if b in self.weights)


def grades_from(toxic, counts) -> tuple:
    """Grades 0 to GRADES from 0/1 labels: toxic documents by thirds of how many words they have that speak for toxicity.

    counts: a matrix as (rows, columns, values, width). Such words are at least exp(LIFT) times as frequent among toxic documents.
    """
    import numpy as np

    rows, cols, values, width = counts
    pos = np.bincount(cols, weights=toxic[rows], minlength=width)
    neg = np.bincount(cols, minlength=width) - pos
    lift = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((neg + 0.5) / ((1 - toxic).sum() + 1))
    speaks = (lift >= LIFT) & (pos >= MIN_DOCS)
    hits = np.bincount(rows, weights=values * speaks[cols], minlength=len(toxic))
    edges = np.quantile(hits[toxic == 1], np.arange(1, GRADES) / GRADES) if toxic.any() else []
    return np.where(toxic == 1, 1 + np.searchsorted(edges, hits, side="right"), 0)


def fit_ordinal(grades, counts, penalty: float = CHOICE, rounds: int = 300) -> tuple:
    """Weights and thresholds by accelerated proximal gradient steps on the mean log-likelihood with an absolute-value penalty on the weights."""
    import numpy as np

    rows, cols, values, width = counts
    n, k = len(grades), int(grades.max())
    docs = np.bincount(cols, minlength=width)
    scale = np.log(n / np.maximum(docs, 1)) + 0.1  # rare words get room, common ones little
    x = np.log1p(values) * scale[cols]
    mul = lambda w: np.bincount(rows, weights=x * w[cols], minlength=n)
    back = lambda r: np.bincount(cols, weights=x * r[rows], minlength=width)
    v = np.ones(width)
    for _ in range(12):
        v = back(mul(v))
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    step = 1 / (0.25 * size / n + 0.3)
    share = np.array([np.mean(grades >= j) for j in range(1, k + 1)]).clip(1e-6, 1 - 1e-6)
    theta, w = -np.log(share / (1 - share)), np.zeros(width)
    gaps = np.log(np.maximum(np.diff(theta), 1e-3))
    z, first, old, t = w.copy(), theta[0], w.copy(), 1.0
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for _ in range(rounds):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        eta = mul(z)
        low, high = np.concatenate([[-np.inf], theta])[grades], np.concatenate([theta, [np.inf]])[grades]
        a, b = np.where(np.isinf(low), 1.0, sig(eta - low)), np.where(np.isinf(high), 0.0, sig(eta - high))
        p = np.maximum(a - b, 1e-12)
        slope = 1 - a - b  # of each log-likelihood in its score
        new = z + step * back(slope) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        z, old = new + (was - 1) / t * (new - old), new
        d = np.array([np.sum((grades == j) * b * (1 - b) / p) - np.sum((grades == j + 1) * a * (1 - a) / p) for j in range(k)]) / n
        first += 2 * d.sum()
        gaps = gaps + 2 * np.exp(gaps) * np.cumsum(d[::-1])[::-1][1:] if k > 1 else gaps
    theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return old * scale, theta


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label and text of at most bound labelled identifiers; of several labels of one the greatest. A repeated identifier has a row for each of its documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(bound)
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select(F.col("__id").alias("id"), "label", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE, **cols: str) -> OrdinalModel:
    """Fit on a bounded sample of labelled documents: features are counted on the executors, the fit gets at most bound sparse rows.

    Of the documents of one identifier the executors keep one, that of the smallest hash of its features. Null
    identifiers and labels play no part, null texts are empty and don't count. Without labelled documents of both
    kinds, as in an empty table, the model calls nothing toxic.
    """
    import numpy as np

    def work(batches):
        from xxhash import xxh3_128_digest

        bucket = Buckets()
        for b in slices(batches):
            labels = [int(bool(y)) for y in b.column(1).to_pylist()]
            found = [sorted(Counter(map(bucket.__getitem__, words_of(x))).items()) for x in b.column(2).to_pylist()]
            keys = [xxh3_128_digest(repr((y, f))) for y, f in zip(labels, found)]
            lists = [pa.array([[p[k] for p in f] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.int32()), pa.array(keys, pa.binary()), *lists], ["id", "label", "content", "buckets", "counts"])

    sample = labelled_sample(docs, labels, label, bound, **cols)
    counted = sample.mapInArrow(work, f"id {sample.schema['id'].dataType.simpleString()}, label int, content binary, buckets array<int>, counts array<int>")
    single = counted.groupBy("id").agg(F.min("content").alias("content"), F.min_by(F.struct("label", "buckets", "counts"), "content").alias("own"))
    got = single.select("own.label", "content", "own.buckets", "own.counts").toArrow().combine_chunks()
    sizes = got.column("buckets").combine_chunks().value_lengths().to_numpy()
    # of repeated documents one speaks; in the order of their contents, so that the fit doesn't depend on the rows' order
    content = np.array(got.column("content").to_pylist() or [b""], dtype="S16")[: len(sizes)]
    kept = np.unique(content, return_index=True)[1]
    kept = kept[sizes[kept] > 0]
    toxic = got.column("label").to_numpy()[kept]
    if not len(kept) or toxic.all() or not toxic.any():
        return OrdinalModel({}, [700.0])
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(kept)), sizes[kept])
    places = np.repeat(starts[kept] - (np.cumsum(sizes[kept]) - sizes[kept]), sizes[kept]) + np.arange(len(rows))
    cols_, values = (got.column(c).combine_chunks().flatten().to_numpy()[places] for c in ("buckets", "counts"))
    values = values.astype(np.float64)
    frequent = np.bincount(cols_, minlength=BUCKETS) >= MIN_DOCS
    rows, cols_, values = rows[frequent[cols_]], cols_[frequent[cols_]], values[frequent[cols_]]
    names, cols_ = np.unique(cols_, return_inverse=True)
    counts = (rows, cols_, values, len(names))
    grades = grades_from(toxic, counts)
    chosen = np.flatnonzero(fit_ordinal(grades, counts)[0])
    own = np.isin(cols_, chosen)
    names = names[chosen]
    weights, thresholds = fit_ordinal(grades, (rows[own], np.searchsorted(chosen, cols_[own]), values[own], len(names)), SHRINK)
    return OrdinalModel({int(b): float(w) for b, w in zip(names, weights) if w}, [float(t) for t in thresholds])


def severity(text: str | Column, model: OrdinalModel) -> Column:
    """Struct of expected_severity (the sum of P(grade >= k)), grade (the number of P(grade >= k) of a half or more) and p_toxic, of whole texts; null is empty."""

    @F.arrow_udf("struct<expected_severity:double,grade:int,p_toxic:double>")
    def score(texts: pa.Array) -> pa.Array:
        bucket, weights, out = Buckets(), model.weights, []
        for x in (x for i in range(0, len(texts), 256) for x in texts.slice(i, 256).to_pylist()):  # a batch may be large
            counts = Counter(b for b in map(bucket.__getitem__, words_of(x)) if b in weights)
            above = model.above(model.score(counts))
            out.append({"expected_severity": sum(above), "grade": sum(p >= 0.5 for p in above), "p_toxic": above[0]})
        return pa.array(out, pa.struct([("expected_severity", pa.float64()), ("grade", pa.int32()), ("p_toxic", pa.float64())]))

    return score(text_of(text))


def rate(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, expected_severity, grade, p_toxic and toxic (a grade above 0) of each row.

    A text without known words, empty or null, gets the severity of a zero score. Repeated rows give
    repeated rows, an empty table none; other columns of docs play no part. Narrow.
    """
    rated = docs.select(F.col(id_col), severity(text_col, model).alias("rated"))
    return rated.select(id_col, "rated.expected_severity", "rated.grade", "rated.p_toxic", (F.col("rated.grade") > 0).alias("toxic"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs without its toxic rows. All columns stay as they are; repeated rows stay or go together, null and empty texts stay, an empty table stays empty."""
    # a row travels as one value, so that no name of its own can clash
    return docs.select(F.struct("*").alias("doc"), severity(text_col, model).alias("rated")).where("rated.grade = 0").select("doc.*")
