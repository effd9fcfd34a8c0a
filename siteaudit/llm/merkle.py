"""A Merkle manifest of a table: trees of 16 by source, over them one of the sources' roots, and proofs of rows (operator 13).

Trees are cut into blocks: aligned subtrees of at most BLOCK levels above their leaves. A block is one row that stores its
digests in van Emde Boas order: a tree of several levels is its upper half followed by its lower halves, each laid out in
the same way, so that a node lies near its parents and siblings whatever a page's size. Roots of blocks are the leaves of
the next round's blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, small
from siteaudit.operators.requestlog import numbered

#: Children of a node, and levels above the leaves of a block: up to 4096 leaves.
FAN, BLOCK = 16, 3
DIGEST = 32


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields, each as its length in UTF-8 bytes, a colon and its value; a null is a hyphen."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


# --- van Emde Boas order ---


def size_of(levels: int) -> int:
    """Nodes of a full tree."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes index of a depth (0 is the root) in a full tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index)
    lower, below = levels - upper, depth - upper
    return size_of(upper) + index // FAN**below * size_of(lower) + address(lower, below, index % FAN**below)


def widths(leaves: int, levels: int) -> list[int]:
    """Nodes at each depth of a tree over so many leaves."""
    out = [leaves]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // FAN))
    return out[::-1]


class Block:
    """A subtree of some levels (its leaves are one) whose digests lie in van Emde Boas order without gaps for nodes that it lacks."""

    _places: dict[tuple[int, int], list[np.ndarray]] = {}

    def __init__(self, leaves: int, levels: int, nodes: bytes | memoryview) -> None:
        self.levels, self.nodes, self.widths = levels, nodes, widths(leaves, levels)
        self.place = self.places(leaves, levels)

    @classmethod
    def places(cls, leaves: int, levels: int) -> list[np.ndarray]:
        """Places of the nodes at each depth; those of full blocks are kept."""
        found = cls._places.get((leaves, levels))
        if found is None:
            full = [address(levels, d, np.arange(n)) for d, n in enumerate(widths(leaves, levels))]
            there = np.zeros(size_of(levels), np.int64)
            for x in full:
                there[x] = 1
            rank = np.cumsum(there) - 1
            found = [rank[x] for x in full]
            if leaves == FAN ** (levels - 1):
                cls._places[leaves, levels] = found
        return found

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Block:
        place = cls.places(len(leaves), levels)
        nodes = bytearray(DIGEST * sum(len(x) for x in place))
        below = leaves
        for depth in range(levels - 1, -1, -1):
            for at, digest in zip(place[depth].tolist(), below):
                nodes[at * DIGEST : (at + 1) * DIGEST] = digest
            below = [parent(below[i : i + FAN]) for i in range(0, len(below), FAN)]
        return cls(len(leaves), levels, bytes(nodes))

    def digest(self, depth: int, index: int) -> bytes:
        at = int(self.place[depth][index]) * DIGEST
        return bytes(self.nodes[at : at + DIGEST])

    def run(self, depth: int, index: int) -> tuple[int, list[bytes]]:
        """Place of a node in its run of siblings, and the digests of that run."""
        first = index - index % FAN
        return index % FAN, [self.digest(depth, i) for i in range(first, min(first + FAN, self.widths[depth]))]


def parent(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hex text."""
    return hashlib.sha256("".join(x.hex() for x in children).encode()).digest()


# A path is what leads from a node to the top: for each level the node's place among its siblings and how many they are, and the siblings' digests.


def path_of(block: Block, index: int, above: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
    """(places, digests) of a leaf of a block, whose root has the path above."""
    places, digests = bytearray(), []
    for depth in range(block.levels - 1, 0, -1):
        at, run = block.run(depth, index)
        places += bytes((at, len(run)))
        digests += run[:at] + run[at + 1 :]
        index //= FAN
    return bytes(places) + above[0], b"".join(digests) + above[1]


def fold(leaf: bytes, places: bytes, digests: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    start = 0
    for at, n in zip(places[::2], places[1::2]):
        own = [digests[start + k * DIGEST : start + (k + 1) * DIGEST] for k in range(n - 1)]
        leaf, start = parent(own[:at] + [leaf] + own[at:]), start + (n - 1) * DIGEST
    return leaf


def height(leaves: int) -> int:
    """Levels above so many leaves."""
    out = 0
    while leaves > FAN**out:
        out += 1
    return out


# --- building, round by round ---


def _blocks(nodes: DataFrame, done: int, carried: str | None = None) -> DataFrame:
    """Blocks of a round: tree, block, leaves, levels, left (levels above its root), nodes. nodes: tree, i (place in its level), digest, total (leaves of the whole tree), and perhaps a column that goes along as a list."""
    kind = nodes.schema[carried].dataType.simpleString() if carried else ""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        left = height(table["total"][0].as_py()) - done
        block = Block.build(table["digest"].to_pylist(), min(left, BLOCK) + 1)
        out = {"tree": key[0], "block": key[1], "leaves": len(table), "levels": block.levels, "left": left - block.levels + 1, "total": table["total"][0].as_py(), "nodes": block.nodes}
        columns = {k: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v]) for k, v in out.items()}
        columns["leaves"], columns["levels"], columns["left"] = (columns[k].cast(pa.int32()) for k in ("leaves", "levels", "left"))
        if carried:
            items = table[carried].combine_chunks()
            columns[carried] = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        return pa.table(columns)

    schema = "tree string, block long, leaves int, levels int, left int, total long, nodes binary" + (f", {carried} array<{kind}>" if carried else "")
    placed = nodes.withColumn("block", F.call_function("div", F.col("i"), F.lit(FAN**BLOCK)))
    return placed.groupBy("tree", "block").applyInArrow(build, schema)


def _roots(blocks: DataFrame) -> DataFrame:
    """tree, i, digest, total and left of the blocks' roots: the root comes first in van Emde Boas order."""
    return blocks.select("tree", F.col("block").alias("i"), F.substring("nodes", 1, DIGEST).alias("digest"), "total", "left")


def build_tree(nodes: DataFrame, name: str, carried: str | None = None) -> list[DataFrame]:
    """Written tables of the blocks of each round. A tree takes part until one root is left of it; rounds grow with the logarithm of the largest tree to base 4096."""
    rounds = [cut(_blocks(nodes, 0, carried), name)]
    while (rest := _roots(rounds[-1]).where("left > 0")).take(1):
        rounds.append(cut(_blocks(rest.drop("left"), BLOCK * len(rounds)), name))
    return rounds


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """tree, i, places and digests of the leaves of blocks. above: tree, i, places, digests of the blocks' roots."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block, up = Block(r["leaves"], r["levels"], r["nodes"]), (r["places"], r["digests"])
                found = [path_of(block, i, up) for i in range(r["leaves"])]
                first = r["block"] * FAN**BLOCK
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int64()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["tree", "i", "places", "digests"])

    return _with_paths(blocks, above).select("tree", "block", "leaves", "levels", "nodes", "places", "digests").mapInArrow(walk, "tree string, i long, places binary, digests binary")


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """blocks with their roots' paths. above: a path of the top of each tree has i 0."""
    return blocks.join(above.select("tree", F.col("i").alias("block"), "places", "digests"), ["tree", "block"])


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: Column | None = None, changes: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs.

    A leaf is leaf_digest of the columns. The leaves of a source lie by id (a null first, equal ids by their digests) and
    are hashed in runs of 16, the last of which may be shorter, level by level until one is left, the subroot; a lone leaf
    is its own. Subroots, by source (a null first, else by UTF-8 bytes), give the root alike. proof_sha256 is the SHA-256
    of all siblings' digests from the leaf to the root. folded_root is what the siblings and the row's leaf give; where
    changed holds, the leaf is taken from the row with changes (column to its new value) in it.

    Nulls, also of sources and ids, are values of their own, an empty source is another one. Repeated rows are leaves
    each. An empty table gives no rows. Other columns play no part, whatever their names. Texts are hashed where they
    are read and never move; a hot source is many blocks, cut by ranges of ids.
    """
    spark = docs.sparkSession
    leaf = leaf_digest(*[F.col(c) for c in columns])
    other = leaf_digest(*[(changes or {}).get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))  # a null sorts first
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), F.unhex(leaf).alias("digest"), F.when(F.coalesce(changed if changed is not None else F.lit(False), F.lit(False)), F.unhex(other)).alias("other"))
    leaves = numbered(rows, "tree", [F.col("id").asc_nulls_first(), F.col("digest")], "i")
    totals = cut(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("total")), "totals")
    leaves = leaves.join(small(totals, totals.count()), "tree").select("tree", "i", "digest", "total", F.struct("id", "other").alias("row"))
    rounds = build_tree(leaves, "blocks", "row")

    tops = _all(rounds).where("left = 0")
    tops = cut(_roots(tops).select("tree", "digest"), "subroots")
    upper = numbered(tops.withColumn("all", F.lit("all")), "all", [F.col("tree")], "i").select(F.col("all").alias("tree"), F.col("tree").alias("source"), "i", "digest", F.lit(tops.count()).cast("long").alias("total"))
    upper = cut(upper, "sources")
    above = spark.range(1).select(F.lit("all").alias("tree"), F.lit(0).cast("long").alias("i"), F.lit(b"").alias("places"), F.lit(b"").alias("digests"))
    root = None
    for blocks in reversed(build_tree(upper.drop("source"), "roots")):
        root = root or bytes((blocks.where("left = 0").select(F.substring("nodes", 1, DIGEST)).first() or [b""])[0])
        above = cut(_paths(blocks, above), "paths")
    # a tree's top block has the path of its subroot; others have that of their root in the next round
    above = upper.join(above.select("i", "places", "digests"), "i").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("i"), "places", "digests")
    for k in range(len(rounds) - 1, 0, -1):
        lower = cut(_paths(rounds[k], above), "paths")
        above = lower.unionByName(above.join(_roots(rounds[k]).select("tree").distinct(), "tree", "left_anti"))
    blocks = _with_paths(rounds[0], above).join(tops.withColumnRenamed("digest", "subroot"), "tree")
    return cut(_proofs(blocks, root or b"", docs.schema[id_col].dataType.simpleString()), "proofs")


def _all(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0].drop("row")
    for blocks in rounds[1:]:
        out = out.unionByName(blocks)
    return out


def _proofs(blocks: DataFrame, root: bytes, id_type: str) -> DataFrame:
    """A row for each leaf of blocks (which hold their rows' ids and changed digests) with its root's path and subroot."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch[c][k].as_py() for c in ("leaves", "levels", "nodes", "places", "digests", "subroot")}
                block, up = Block(r["leaves"], r["levels"], r["nodes"]), (r["places"], r["digests"])
                own = batch["row"][k].values
                out = []
                for i, other in enumerate(own.field("other").to_pylist()):
                    leaf, (places, digests) = block.digest(block.levels - 1, i), path_of(block, i, up)
                    folded = fold(other or leaf, places, digests)
                    out.append((leaf.hex(), hashlib.sha256(digests.hex().encode()).hexdigest(), folded.hex(), folded == root))
                leaf, proof, folded, ok = zip(*out)
                same = lambda x: pa.array([x.hex()] * len(out))
                yield pa.RecordBatch.from_arrays([own.field("id"), pa.array(leaf), same(r["subroot"]), same(root), pa.array(proof), pa.array(folded), pa.array(ok)], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.mapInArrow(prove, f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
