"""Audit of how sources of a language differ in their terms, by a frequent-pattern tree of term rows (operator 12).

A term's row is the sources that have it with their counts, in one order of sources for all rows of a language. Terms that
most sources lack cost nothing for those pairs: the sum over all terms is taken as if each count were zero, and then
corrected. What a count corrects alone is summed by (source, count); what two counts of one row correct together is found
in a prefix tree of the rows, once for each node and ancestor, times the number of terms whose rows run through the node.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, slices, small
from siteaudit.llm.words import LETTERS, words

#: A term is kept if so many documents of its language have it.
LEAST_DOCS = 10
#: What a probability of one is, and what is added to each count.
SCALE, PRIOR = 1_000_000_000, 2
#: Distinct rows in one tree.
TREE_ROWS = 20_000


def _name(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), and a row with a null term for each occurring (lang, source).

    Terms are runs of letters (all characters beyond ASCII count as such), of which only A-Z become small. A slice of
    documents is summed before it leaves Python, a task before the shuffle.
    """
    rows = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4096, chars=4_000_000):
            pairs = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
            names = list(dict.fromkeys((x["lang"], x["source"]) for x in pairs.to_pylist()))
            place = {x: i for i, x in enumerate(names)}
            group = np.array([place[x["lang"], x["source"]] for x in pairs.to_pylist()], np.int64)
            found = words(batch["text"], LETTERS, lower=True)
            coded = found.values.dictionary_encode()
            width = len(coded.dictionary) + 1
            doc = np.repeat(np.arange(batch.num_rows), found.counts)
            cells, n = np.unique(doc * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            keys, at = np.unique(group[cells // width] * width + cells % width, return_inverse=True)
            sums, had = np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
            g = np.concatenate([keys // width, np.arange(len(names))])  # and each group by itself
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.nulls(len(names), pa.string())])
            own = np.zeros(len(names), np.int64)
            langs, sources = (pa.array([x[k] for x in names], pa.string()).take(pa.array(g)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(np.concatenate([sums, own])), pa.array(np.concatenate([had, own]))], ["lang", "source", "term", "n", "docs"])

    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR terms)), exactly."""
    over = (total + PRIOR * terms).cast("decimal(19,0)")
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)"), over) + 1).cast("long")


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so whole numbers hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class TermTree:
    """A prefix tree of term rows. An item is (source, share, share of a count of zero); a node knows its parent and how many terms run through it."""

    def __init__(self) -> None:
        self.children: dict[tuple, int] = {}
        self.items: list[tuple] = [(-1, 0, 0)]
        self.parent, self.terms = [0], [0]

    def insert(self, row: list[tuple], terms: int) -> None:
        at = 0
        for item in row:
            key = (at, item)
            node = self.children.get(key)
            if node is None:
                node = self.children[key] = len(self.items)
                self.items.append(item)
                self.parent.append(at)
                self.terms.append(0)
            self.terms[node] += terms
            at = node

    def corrections(self) -> dict[tuple[int, int], int]:
        """(source, source of an ancestor) to the sum of what their two counts correct together: each node with each ancestor once, a generation of ancestors at a time."""
        source, p, p0 = (np.array(x, np.int64) for x in zip(*self.items))
        parent, terms = np.array(self.parent), np.array(self.terms, np.int64)
        f = lambda a, b: (a - b) ** 2 // np.maximum(a + b, 1)
        out: dict[tuple[int, int], int] = defaultdict(int)
        node = np.arange(1, len(parent))
        above = parent[node]
        while len(node := node[above > 0]):
            above = above[above > 0]
            more = (f(p[node], p[above]) - f(p[node], p0[above]) - f(p0[node], p[above]) + f(p0[node], p0[above])) * terms[node]
            pairs, at = np.unique(np.stack([source[node], source[above]]), axis=1, return_inverse=True)
            sums = np.zeros(pairs.shape[1], np.int64)
            np.add.at(sums, at.ravel(), more)
            for a, b, x in zip(*pairs.tolist(), sums.tolist()):
                out[a, b] += x
            above = parent[above]
        return out


def _tree_sums(rows: DataFrame) -> DataFrame:
    """rows: lang, path (an array of source, p, p0 in their order), terms. lang, a, b, value: joint corrections of each pair of sources by number, partly summed."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(lang: str, tree: TermTree) -> pa.RecordBatch:
            found = tree.corrections()
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(found.values(), pa.int64())], ["lang", "a", "b", "value"])

        lang, tree, held = None, TermTree(), 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["lang"] != lang or held >= TREE_ROWS:
                    yield told(lang, tree)
                    lang, tree, held = row["lang"], TermTree(), 0
                tree.insert([(x["s"], x["p"], x["p0"]) for x in row["path"]], row["terms"])
                held += 1
        yield told(lang, tree)

    return rows.mapInArrow(sums, "lang string, a int, b int, value long")


def audit_sources(docs: DataFrame, top: int = 10, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of each (lang, source) that occurs.

    Terms are those that at least least_docs documents of the language have. With V of them and N occurrences of them, a
    term's share is 1 + floor(10^9 (n + 2) / (N + 2 V)), in a source as in the whole language, and the distance of two
    shares floor((p - q)^2 / (p + q)). Part pair: the sum of distances over all terms to each other source of the
    language, every rank; part term: the top terms that the source has more often than its language, by their distance.
    Rank 1 has the greatest value, ties go to the smaller item by its UTF-8 bytes.

    Null texts, languages and sources are empty ones. A group without terms has pairs but no terms, a language without
    kept terms values of 0, a lone source no pairs, an empty table no rows. Repeated rows count each. Other columns of
    docs play no part, whatever their names.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col), "terms")
    named = counts.where("term IS NOT NULL")
    kept = cut(named.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs).select("lang", "term", "total"), "kept")
    cells = cut(named.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "cells")

    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["source_n", "lang_n", "v"])
    # small sources first: their few counts make beginnings that many rows share
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source_n", "source")))
    groups = cut(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("source_n"), F.col("v")))), "groups")
    few = small(groups, groups.count())

    shared = cells.join(few, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("source_n"), F.col("v")))
    q = _share(F.col("total"), F.col("lang_n"), F.col("v"))
    terms = shared.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    paths = shared.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("s", "p", "p0"))).alias("path"))
    paths = paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
    # dealt by the beginnings of rows, which are short, as bounds of ranges are sampled on the driver; the hash splits a beginning that very many share
    ordered = paths.repartitionByRange("lang", F.slice("path", 1, 2), F.xxhash64("path")).sortWithinPartitions("lang", "path")
    both = _tree_sums(ordered)
    both = both.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("k"), "value").select("lang", "k.a", "k.b", "value")

    ours = groups.select("lang", F.col("s").alias("a"), F.col("p0").alias("a0"), "v")
    theirs = groups.select("lang", F.col("s").alias("b"), F.col("p0").alias("b0"))
    theirs = small(theirs, theirs.count())
    # the distance at two counts of zero for every term, then what one source's counts change of it
    base = ours.join(theirs, "lang").where("a <> b").select("lang", "a", "b", (F.col("v") * F.coalesce(_distance(F.col("a0"), F.col("b0")), F.lit(0))).alias("value"))
    alone = shared.groupBy("lang", F.col("s").alias("a"), F.col("p"), F.col("p0").alias("a0")).agg(F.count(F.lit(1)).alias("terms"))
    alone = alone.join(theirs, "lang").where("a <> b").select("lang", "a", "b", ((_distance(F.col("p"), F.col("b0")) - _distance(F.col("a0"), F.col("b0"))) * F.col("terms")).alias("value"))
    alone = alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    alone = alone.unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = base.unionByName(alone).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    name = lambda k, c: groups.select("lang", F.col("s").alias(k), F.col("source").alias(c))
    pairs = pairs.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return cut(both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")), "divergence")
