"""Quality by importance resampling: hashed n-gram models of good and of all text, and Gumbel top-k (operator 2)."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, slices, text_of

#: Hashed unigrams and bigrams; labelled rows of the target at most.
BUCKETS, SAMPLE = 1 << 14, 8192
#: Log weight of a document without n-grams: it comes last.
NOTHING = float("-inf")
MEMO = 300_000
# words, and runs of signs: both tell prose from junk; capitals stay
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """A 64-bit hash of each token; forgets all when it is full."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        h = self[token] = xxh64_intdigest(token) >> 1
        return h


def ngram_buckets(text: str, hashes: Hashes):
    """Buckets of all unigrams and bigrams of a whole text."""
    import numpy as np

    tokens = _TOKEN.findall(text)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h % np.uint64(BUCKETS), (two >> np.uint64(40)) % np.uint64(BUCKETS)]).astype(np.int64)


@dataclasses.dataclass
class RatioModel:
    """log p(bucket | target) - log p(bucket | all), one number for each bucket."""

    log_ratio: list[float]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", smooth: float = 1.0) -> RatioModel:
    """The raw model counts all documents, the target at most bound labelled good ones, in one pass over the texts.

    Each task sums its documents and gives a row for each bucket; the driver gets BUCKETS sums. Null and empty texts count
    nothing, null labels and identifiers label nothing; a repeated label counts once, repeated documents each. Without any
    document or good label all ratios are those of the smoothing alone. Other columns play no part.
    """
    import numpy as np

    good = labels.where(F.col(label) > 0).select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    good = good.orderBy(F.xxhash64("__id"), "__id").limit(bound).withColumn("__good", F.lit(True))
    texts = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
    marked = texts.join(F.broadcast(good), "__id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = Hashes(), np.zeros((2, BUCKETS), np.int64)
        for b in slices(batches):
            texts, good = b.column(0).to_pylist(), b.column(1).to_pylist()
            for which in (False, True):
                own = [ngram_buckets(x, hashes) for x, g in zip(texts, good) if g == which]
                if own:
                    sums[int(which)] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        sums[0] += sums[1]
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "raw": pa.array(sums[0][some]), "target": pa.array(sums[1][some])})

    counted = marked.mapInArrow(work, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    logs = [np.log((x + smooth) / (x.sum() + smooth * BUCKETS)) for x in (target, raw)]
    return RatioModel((logs[0] - logs[1]).tolist())


def log_weights(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and log_weight of each row: the log likelihood ratio of its whole text, the sum over all its n-grams.

    A text without n-grams, empty or null, has NOTHING. Repeated rows give repeated rows, an empty table none; a
    null identifier stays null; other columns play no part. Narrow.
    """
    kind, ratios = docs.schema[id_col].dataType.simpleString(), model.log_ratio

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashes, ratio = Hashes(), np.array(ratios)
        for b in slices(batches):
            found = [ngram_buckets(x, hashes) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(ratio[f].sum()) if len(f) else NOTHING for f in found], pa.float64())], [id_col, "log_weight"])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, log_weight double")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with rank from 1 over all rows: a sort by ranges, then each range's rows before it. No task gets more than its range."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__range", F.shiftright("__at", 33)), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(counts), "__range").withColumn("rank", rank).drop("__at", "__range", "__before")


def good_share(labels: DataFrame, label: str = "quality") -> float:
    """Share of good ones among labelled documents; one half without labels."""
    share = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    return 0.5 if share is None else share


def resample(docs: DataFrame, model: RatioModel, keep: float, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, log_weight, gumbel_key, rank and kept of each row: kept are the share keep of all rows (rounded up) with the greatest keys.

    The key is the log weight plus Gumbel noise, made from seed and identifier, so that the kept rows are a
    sample without replacement in proportion to the weights, and the same after a retry. Ties go to the
    smaller identifier. Null and empty texts come last. Repeated rows are ranked one by one. An empty table gives no rows.
    """
    scored = log_weights(docs, model, id_col, text_col)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = cut(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "scores")
    k = -(-keyed.count() * round(keep * 1_000_000) // 1_000_000)
    return ranked(keyed, [F.desc("gumbel_key"), F.asc(id_col)]).withColumn("kept", F.col("rank") <= k)
