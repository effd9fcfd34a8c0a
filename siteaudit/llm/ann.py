"""Approximate nearest neighbours by learned partitions (operator 7).

A bounded sample's neighbour graph is cut into balanced parts; a small network learns the parts; every vector is
indexed by the network, and queries go to their most probable parts, where all vectors are compared in double precision.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, small

#: Distinct vectors that the partition is learned on, those with the smallest hash: at least and at most; and for each part.
SAMPLE, MOST_SAMPLE, SAMPLE_OF_PART = 8192, 32_768, 32
#: Neighbours in the sample's graph; parts of a usual table and at most, and vectors that a part should hold: at least, and where there are more parts than usual.
NEIGHBOURS, PARTS, MOST_PARTS, LEAST_SIZE, PART_SIZE = 12, 64, 1024, 48, 8192
#: Share of the true neighbours that held-out sampled queries must find: it sets to how many parts a query goes.
TARGET = 0.96
HIDDEN, EPOCHS = 128, 40
#: Vectors in a block of the index and queries in a block of the search: the sizes of one comparison.
BLOCK, QUERIES = 2048, 512


def parts_for(n: int) -> int:
    """Parts for n distinct vectors, a power of two: of LEAST_SIZE vectors or more in small tables, PARTS in others until these hold PART_SIZE, then more of that size. Beyond MOST_PARTS of them parts grow."""
    few = 1 << max(0, (n // LEAST_SIZE).bit_length() - 1)
    return min(few, PARTS) if few <= PARTS else min(MOST_PARTS, max(PARTS, 1 << max(0, n // PART_SIZE - 1).bit_length()))


def neighbour_graph(x, k: int = NEIGHBOURS):
    """Row numbers of the k rows of greatest inner product with each row, itself left out."""
    import numpy as np

    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for s in range(0, len(x), 512):
        near = x[s : s + 512] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -np.inf
        out[s : s + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(graph, parts: int, seed: int = 3, slack: float = 1.1):
    """A part for each node: halves at the median of a slow mode of the walk on the graph, again and again; then moves to the part of most neighbours while that has room."""
    import numpy as np

    rng, n = np.random.default_rng(seed), len(graph)
    src = np.repeat(np.arange(n), graph.shape[1])
    u, v = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    part, count = np.zeros(n, np.int64), 1
    while count < parts:
        inside = part[u] == part[v]
        a, b = u[inside], v[inside]
        degree = np.bincount(a, minlength=n) + 1.0
        mode = rng.standard_normal(n)
        for _ in range(60):
            mode = (mode + np.bincount(a, weights=mode[b], minlength=n)) / degree
            mode -= (np.bincount(part, weights=mode, minlength=count) / np.bincount(part, minlength=count).clip(1))[part]
            mode /= np.sqrt(np.bincount(part, weights=mode**2, minlength=count).clip(1e-30))[part]
        order = np.lexsort((mode, part))
        sizes = np.bincount(part, minlength=count)
        within = np.empty(n, np.int64)
        within[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = 2 * part + (within >= (sizes[part] + 1) // 2)
        count *= 2
    room = int(slack * n / count) + 1
    for _ in range(6):
        votes = np.zeros((n, count), np.float32)
        np.add.at(votes, (u, part[v]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes = np.bincount(part, minlength=count)
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
    return part, count


@dataclasses.dataclass
class Router:
    """A network with one hidden layer: the log-probability of each part, up to a constant."""

    scale: float
    w1: object
    b1: object
    w2: object
    b2: object

    def logits(self, x):
        import numpy as np

        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x, n: int):
        """The n most probable parts of each row, the most probable first."""
        import numpy as np

        return np.argsort(-self.logits(np.asarray(x, np.float32)), axis=1, kind="stable")[:, :n]


def train_router(x, part, graph, count: int, seed: int = 4) -> Router:
    """Fit to the parts of each node and its neighbours, by Adam on small batches."""
    import numpy as np

    rng, n, dim = np.random.default_rng(seed), len(x), x.shape[1]
    target = np.zeros((n, count), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
    target[np.arange(n), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    scale = float(1 / (x.std() + 1e-12))
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, count)) * np.sqrt(1 / HIDDEN), np.zeros(count)]
    p = [a.astype(np.float32) for a in p]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            rows = order[s : s + 256]
            a = x[rows] * np.float32(scale)
            h = np.maximum(a @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((a.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= np.float32(3e-3 * (1 - epoch / EPOCHS)) * (m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Router(scale, *p)


def learn(sample, parts: int = PARTS, k: int = 20, target: float = TARGET) -> tuple[Router, int, int]:
    """(router, parts, probes) of a bounded sample, a matrix in random order. Fewer than two vectors for each of twice as many parts are one part.

    The last eighth of the sample (a quarter of one below 4096) takes no part in the training: its neighbours in the
    whole sample say how many parts a query must go to.
    """
    import numpy as np

    x = np.asarray(sample, np.float32)
    if parts < 2 or len(x) < 4 * parts:
        dim = x.shape[1] if x.ndim == 2 else 1
        return Router(1.0, np.zeros((dim, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)), 1, 1
    seen = x[: -(len(x) // (8 if len(x) >= 4096 else 4))]
    graph = neighbour_graph(seen)
    part, count = balanced_parts(graph, parts)
    router = train_router(seen, part, graph, count)
    true = neighbour_graph(x, k)[len(seen) :]
    home, order = router.parts(x, 1)[:, 0], router.parts(x[len(seen) :], count)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(count)[None, :].repeat(len(order), 0), 1)
    asked = np.take_along_axis(place, home[true], 1).ravel()  # in which probe each true neighbour is found
    return router, count, int(np.searchsorted(np.cumsum(np.bincount(asked, minlength=count)) / len(asked), target)) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the rows that take part: an identifier, and a vector of finite components that aren't all zero. Shorter vectors get zeros up to the greatest length, which changes no inner product."""
    inf = float("inf")
    good = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    good = good & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(good)
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if sizes.least == sizes.most:
        return rows
    zero = F.lit(0).cast(vectors.schema[vec_col].dataType.elementType)
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(zero, F.lit(sizes.most) - F.size("vec"))))


def _packed(df: DataFrame, group: list[str], side: str) -> DataFrame:
    """A row for each group: <side>_ids and <side>_first as arrays, <side>_vecs as one array."""
    kept = F.collect_list(F.struct("vid", "vid0", "vec"))
    packed = df.groupBy(*group).agg(kept.alias("all"))
    return packed.select(*group, F.col("all.vid").alias(f"{side}_ids"), F.col("all.vid0").alias(f"{side}_first"), F.flatten("all.vec").alias(f"{side}_vecs"))


def best_of(near, first, k: int, exact):
    """For each row of near (approximate scores): the places of its k best by exact score, ties to the smaller first. exact(i, places) gives exact scores."""
    import numpy as np

    top = min(k + 4, near.shape[1])  # a few more than k: the last bits of near may differ
    if top == near.shape[1]:
        return [np.arange(top)] * len(near)
    places = np.argpartition(-near, top - 1, axis=1)[:, :top]
    least = np.take_along_axis(near, places, 1).min(axis=1)
    out = list(places)
    for i in np.flatnonzero((near >= least[:, None] - 1e-9).sum(axis=1) > top):  # ties at the edge
        tied = np.flatnonzero(near[i] >= least[i] - 1e-9)
        out[i] = tied[np.lexsort((first[tied], -exact(i, tied)))[:top]]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, parts: int | None = None, sample: int | None = None, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by inner product in double precision, ties to the smaller vec_id.

    is_query is a condition on the column id. Candidates are all usable rows but those with the query's own
    identifier; of vectors of different lengths the shorter one counts as having zeros at its end. Equal vectors are one node of the index with their k + 1 smallest identifiers (no more can be
    in a result), so copies don't fill a part. Fewer candidates than k give fewer rows; an empty table gives none.
    Rows that repeat an identifier and vector count once. Other columns of vectors play no part. Without a number
    of parts it follows the number of distinct vectors (parts_for), and the sample follows the parts.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    first = F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))
    distinct = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    distinct = cut(distinct.select(F.col("ids")[0].alias("vid0"), "ids", "vec", F.xxhash64("vec").alias("h")), "vectors")
    # an identifier that comes with several vectors has a node for each
    distinct = cut(distinct.withColumn("vid", F.xxhash64("vid0", "h")).drop("h"), "nodes")
    asked = cut(rows.where(is_query).distinct().join(distinct.select("vec", "vid"), "vec").select(F.col("id").alias("query_id"), "vid"), "asked")
    parts = parts or parts_for(distinct.count())
    sample = sample or min(MOST_SAMPLE, max(SAMPLE, SAMPLE_OF_PART * parts))
    chosen = distinct.select("vec", "vid").orderBy("vid").limit(sample).toPandas()
    if chosen.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, count, probes = learn(np.stack(chosen["vec"].to_numpy()), parts, k, target)

    def route(n: int):
        """Rows with the n most probable parts of their vector."""

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                to = pa.array(router.parts(x, n).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, to], ["vid", "vid0", "vec", "parts"])

        return work

    kind = distinct.schema["vec"].dataType.simpleString()
    shape = f"vid long, vid0 long, vec {kind}, parts array<int>"
    index = cut(distinct.select("vid", "vid0", "vec").mapInArrow(route(1), shape).select("vid", "vid0", "vec", F.col("parts")[0].alias("part")), "index")
    blocks = cut(index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")  # a row for each part
    block = F.pmod(F.xxhash64(F.lit(1), "vid"), F.col("blocks")).cast("int")
    indexed = _packed(index.join(F.broadcast(blocks), "part").withColumn("block", block), ["part", "block"], "c")
    queries = distinct.select("vid", "vid0", "vec").join(asked.select("vid").distinct(), "vid", "left_semi")
    n_asked = asked.count()
    routed = queries.mapInArrow(route(probes), shape).select("vid", "vid0", "vec", F.explode("parts").alias("part"))
    groups = max(1, -(-n_asked * probes // (count * QUERIES)))
    routed = _packed(routed.withColumn("group", F.pmod(F.xxhash64(F.lit(2), "vid"), F.lit(groups))), ["part", "group"], "q")
    routed = routed.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = routed.join(indexed, ["part", "block"]).select("q_ids", "q_vecs", "c_ids", "c_first", "c_vecs")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, c_ids, first = (b.column(j)[i].values.to_numpy() for j in (0, 2, 3))
                q, c = (b.column(j)[i].values.to_numpy().astype(np.float64).reshape(len(n), -1) for j, n in ((1, q_ids), (4, c_ids)))
                places = best_of(q @ c.T, first, k + 1, lambda r, at: np.einsum("j,ij->i", q[r], c[at]))  # noqa: B023
                qi, ci = np.repeat(np.arange(len(q)), [len(x) for x in places]), np.concatenate(places)
                score = np.einsum("ij,ij->i", q[qi], c[ci])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(c_ids[ci]), pa.array(first[ci]), pa.array(score)], ["q", "c", "first", "score"])

    found = met.mapInArrow(compare, "q long, c long, first long, score double")
    # first the best k + 1 nodes, then the best k + 1 identifiers of each node that is asked for, then each query's k
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "c"))).where(F.col("n") <= k + 1).drop("n")
    found = found.join(distinct.select(F.col("vid").alias("c"), "ids"), "c")
    each = found.select("q", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    each = cut(each, "found")
    own = asked.join(each, asked["vid"] == each["q"]).where("vec_id <> query_id")
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return own.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
