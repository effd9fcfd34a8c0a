"""SimHash near-duplicates by tiled comparison of all fingerprints (operator 4).

Fingerprints lie in tiles of bounded size, cells of equal population counts. Tile pairs whose population counts
differ by more than the radius are skipped; in the others numpy compares all pairs by exclusive-or and bit counts.
A tile pair gives a spanning forest of its links, not all of them: as many rows as it has fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, slices, small, text_of
from siteaudit.llm.components import components

#: Fingerprints of a tile.
TILE = 2048
#: A fingerprint's population counts are taken in so many segments of equal width; their differences add up to at most the distance.
SEGMENTS = 4
#: Shingles that are turned into bits at once: long texts need no more memory.
CHUNK = 32_640


def shingles(data: bytes, k: int) -> list[bytes]:
    """k-word shingles in order, of ASCII-lower-cased UTF-8; with fewer words the whole sequence, with none nothing."""
    w = data.lower().split()  # on bytes: A-Z, and the space and controls 9 to 13
    if len(w) <= k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*[w[i:] for i in range(k)])))


def majority(grams: list[bytes], digest, width: int) -> bytes:
    """Bit i is 1 if it is set in over half of the shingles' digests of width bytes; zero for no shingles."""
    import numpy as np

    ones = np.zeros(8 * width, np.int64)
    for i in range(0, len(grams), CHUNK):
        raw = np.frombuffer(b"".join(map(digest, grams[i : i + CHUNK], repeat(42))), np.uint8).reshape(-1, width)
        bits = np.unpackbits(raw, axis=1)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 8 * width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 ones fit a byte
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams)).tobytes()


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (of the shingles' XXH64 with seed 42) of each row, in whole texts; null is empty. Narrow."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_digest

        for b in slices(batches):
            fps = b"".join(majority(shingles(x, words), xxh64_digest, 8) for x in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(work, f"id {kind}, fp long")


def content_of(data: bytes) -> bytes:
    """Hash of the word sequence."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(data.lower().split()))


def wide_fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and fp2 (128 bits), n (distinct shingles) and content (a hash of the word sequence) of each row, in whole texts; null is empty. A shingle counts once, as in the sets that decide. Narrow."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh3_128_digest

        for b in slices(batches):
            fps, n, content = [], [], []
            for data in b.column(1).to_pylist():
                grams = list(set(shingles(data, words)))
                fps.append(majority(grams, xxh3_128_digest, 16))
                n.append(len(grams))
                content.append(content_of(data))
            pair = np.frombuffer(b"".join(fps), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n, pa.int32()), pa.array(content, pa.binary())], ["id", "fp", "fp2", "n", "content"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(work, f"id {kind}, fp long, fp2 long, n int, content binary")


def _forest(a, b, linked_rows) -> list[tuple[int, int]]:
    """Spanning forest of links between places of a and b; linked_rows yields (i, places in b linked to a's i)."""
    import numpy as np

    label, out = np.arange(len(b)), []
    for i, js in linked_rows:
        found = np.unique(label[js])
        out += [(i, int(x)) for x in found]
        if len(found) > 1:
            label[np.isin(label, found[1:])] = found[0]
    return out


def tile_links(a, b, same: bool, radius: int) -> list[tuple[int, int]]:
    """Places (in a, in b) of a spanning forest of the links at most radius apart; a tile with itself counts each pair once."""
    import numpy as np

    def rows():
        step = max(1, (1 << 16) // len(b))
        for s in range(0, len(a), step):
            near = np.bitwise_count(a[s : s + step, None] ^ b[None, :]) <= radius
            if same:
                near &= np.arange(len(b))[None, :] > np.arange(s, s + len(near))[:, None]
            for i in np.flatnonzero(near.any(axis=1)):
                yield s + int(i), np.flatnonzero(near[i])

    return _forest(a, b, rows())


def _encode(parts: list[Column], base: int) -> Column:
    out = F.lit(0).cast("long")
    for p in parts:
        out = out * base + p
    return out


def _half(offsets: Iterable[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Zero, and of each offset and its opposite the greater one: each pair of cells is met once."""
    return [o for o in offsets if o >= (0,) * len(o)]


def segment_counts(fp: Column, segments: int = SEGMENTS) -> list[Column]:
    """Ones in each segment of a fingerprint."""
    width = 64 // segments
    mask = (1 << width) - 1 if width < 64 else -1
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit(mask).cast("long"))) for i in range(segments)]


def tile_pairs(items: DataFrame, parts: list[Column], offsets: list[tuple[int, ...]], base: int, payload: list[str], weight: Column) -> DataFrame:
    """Pairs of tiles to compare: a_<payload>, b_<payload> as arrays, a_tile, b_tile, same.

    items with equal parts (small whole numbers under base) share a cell; cells are dealt into tiles whose
    weights add up to about 1 by a hash of the first payload column. A cell meets those at the offsets (half of them: see
    _half). There are as many join keys as tiles, so no task gets more than one tile's pairs per key.
    """
    kept = [F.col(c) for c in payload]
    celled = items.select(*kept, *[p.cast("long").alias(f"p{i}") for i, p in enumerate(parts)], weight.alias("weight"))
    names = [f"p{i}" for i in range(len(parts))]
    celled = cut(celled.withColumn("cell", _encode([F.col(n) for n in names], base)), "cells")
    counts = celled.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum("weight"))).cast("int").alias("parts"))
    counts = cut(counts, "counts")
    n_cells = counts.count()
    placed = celled.join(small(counts, n_cells), "cell").withColumn("part", F.pmod(F.xxhash64(payload[0]), F.col("parts")).cast("int"))
    tiles = placed.groupBy("cell", "part", *names).agg(*[F.collect_list(c).alias(c) for c in payload]).withColumn("tile", F.struct("cell", "part"))
    tiles = cut(tiles, "tiles")

    steps = F.array(*[F.struct(*[F.lit(int(x)).alias(f"d{i}") for i, x in enumerate(o)]) for o in offsets])
    left = tiles.withColumn("d", F.explode(steps))
    moved = [F.col(n) + F.col("d")[f"d{i}"] for i, n in enumerate(names)]
    fits = F.lit(True)
    for m in moved:
        fits = fits & (m >= 0) & (m < base)
    at_home = F.lit(True)
    for i in range(len(names)):
        at_home = at_home & (F.col("d")[f"d{i}"] == 0)
    left = left.where(fits).select(F.col("tile").alias("a_tile"), *[F.col(c).alias(f"a_{c}") for c in payload], at_home.alias("home"), _encode(moved, base).alias("to_cell"))
    left = left.join(small(counts.select(F.col("cell").alias("to_cell"), "parts"), n_cells), "to_cell")
    left = left.withColumn("to_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.where(~F.col("home") | (F.col("a_tile.part") <= F.col("to_part")))
    right = tiles.select(F.col("cell").alias("to_cell"), F.col("part").alias("to_part"), F.col("tile").alias("b_tile"), *[F.col(c).alias(f"b_{c}") for c in payload])
    return left.join(right, ["to_cell", "to_part"]).select("a_tile", "b_tile", *[f"{s}_{c}" for s in "ab" for c in payload], (F.col("a_tile") == F.col("b_tile")).alias("same"))


def _array(column: pa.Array, i: int):
    return column[i].values.to_numpy(zero_copy_only=False)


def print_links(prints: DataFrame, radius: int, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at most radius apart, enough of them to connect what is connected."""
    offsets = _half(o for o in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, o)) <= radius)
    pairs = tile_pairs(prints, segment_counts(F.col("fp"), segments), offsets, 64 // segments + 1, ["fp"], F.lit(1 / tile))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x, y = [], []
            for k in range(batch.num_rows):
                a, b = _array(batch.column(0), k).view(np.uint64), _array(batch.column(1), k).view(np.uint64)
                for i, j in tile_links(a, b, batch.column(2)[k].as_py(), radius):
                    x.append(a[i].view(np.int64))
                    y.append(b[j].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return pairs.select("a_fp", "b_fp", "same").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component of each row: the smallest id reachable over fingerprints at most radius bits apart, its own included.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give repeated rows.
    A null id takes its component's smallest id, null if there is no other. An empty table gives no rows. Other
    columns of docs play no part. Rows of equal fingerprint are one node, so their number doesn't matter.
    """
    prints = cut(fingerprints(docs, words, id_col, text_col).select("id", "fp"), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = components(cut(print_links(distinct, radius), "near"), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = cut(rooted.join(least, "root").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def hex_print(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- similar texts: fingerprints propose, shingle sets decide ---

#: Rows of a tile here, and shingles of all its rows: a pair of tiles is compared, and its sets are verified, in bounded memory.
SIMILAR_TILE, TILE_HASHES = 8192, 2_000_000
#: Distances up to which documents are proposed, in the first 64 bits and in all 128. At a similarity of 0.8 they are 10 and 19 on average,
#: with deviations of 3 and 4, and 12 and 24 for the shortest texts (4 of 5 shingles); of unrelated documents 32 and 64.
FIRST_RADIUS, SIMILAR_RADIUS = 24, 36
#: Width of the population classes.
CLASS = 4


def size_band(n: Column, similarity: float) -> Column:
    """Sets whose bands differ by more than one can't reach the similarity."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / -F.log(F.lit(similarity)) + 1e-9)


def _candidates(items: DataFrame, similarity: float, first: int, radius: int, tile: int) -> DataFrame:
    """a_tile, b_tile, id: documents that have a fingerprint within the radius in a tile pair. As many rows as there are documents in it at most."""
    reach = -(-first // CLASS)
    offsets = _half(product((-1, 0, 1), range(-reach, reach + 1)))
    parts = [size_band(F.col("n"), similarity), F.floor(F.bit_count("fp") / CLASS)]
    pairs = tile_pairs(items, parts, offsets, 256, ["id", "fp", "fp2", "n"], F.greatest(F.lit(1 / tile), F.col("n") / TILE_HASHES))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k in range(batch.num_rows):
                ids_a, ids_b = _array(batch.column(1), k), _array(batch.column(2), k)
                a, b, a2, b2 = (_array(batch.column(c), k).view(np.uint64) for c in (3, 4, 5, 6))
                na, nb = _array(batch.column(7), k).astype(np.float64), _array(batch.column(8), k).astype(np.float64)
                same, hit_a, hit_b = batch.column(9)[k].as_py(), np.zeros(len(a), bool), np.zeros(len(b), bool)
                ones_a, ones_b = np.bitwise_count(a), np.bitwise_count(b)
                if int(ones_a.max()) + first < int(ones_b.min()) or int(ones_b.max()) + first < int(ones_a.min()):
                    continue
                step = max(1, (1 << 16) // len(b))
                for s in range(0, len(a), step):
                    near = np.bitwise_count(a[s : s + step, None] ^ b[None, :]) <= first
                    if same:
                        near &= np.arange(len(b))[None, :] > np.arange(s, s + len(near))[:, None]
                    i, j = np.nonzero(near)
                    if len(i):
                        i += s
                        x, y = na[i], nb[j]
                        apart = np.bitwise_count(a[i] ^ b[j]).astype(np.int64) + np.bitwise_count(a2[i] ^ b2[j])
                        ok = (apart <= radius) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9)
                        hit_a[i[ok]] = True
                        hit_b[j[ok]] = True
                ids = np.concatenate([ids_a[hit_a], ids_b[hit_b]])
                if same:
                    ids = np.unique(ids)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(ids), pa.string()), pa.array(ids, pa.int64())], ["pair", "id"])

    pair = F.concat_ws(":", "a_tile.cell", "a_tile.part", "b_tile.cell", "b_tile.part").alias("pair")
    return pairs.select(pair, "a_id", "b_id", "a_fp", "b_fp", "a_fp2", "b_fp2", "a_n", "b_n", "same").mapInArrow(work, "pair string, id long")


def similar_links(ids, sets: list, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of documents whose shingle sets (arrays of distinct hashes) have a Jaccard similarity of similarity or more; empty sets are equal.

    Each group is followed from document to document, and a document is compared with those that are in no group yet:
    a large group costs one look at its texts, not one for each pair of them.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    free, held, out = np.ones(len(sets), bool), 0, []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], group = False, [first]
        for i in group:  # grows as links are found
            n_free = np.count_nonzero(free)
            if n_free == 0:
                break
            if 2 * n_free <= held or not held:  # forget the shingles of documents that have a group
                hashes, owner, held = hashes[free[owner]], owner[free[owner]], n_free
            s = sets[i]
            begin, end = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
            n = end - begin
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            js = np.flatnonzero(free & (shared >= similarity * (len(s) + sizes - shared) - 1e-9)).tolist()
            free[js] = False
            out += [(i, j) for j in js]
            group += js
    return out


def _similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, first: int = FIRST_RADIUS, radius: int = SIMILAR_RADIUS, tile: int = SIMILAR_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similar_documents with the content (see wide_fingerprints) of each row."""
    prints = cut(wide_fingerprints(docs, words, id_col, text_col), "prints")
    classes = prints.where("id IS NOT NULL").groupBy("content").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in ("fp", "fp2", "n")])
    # an id may have several texts: classes have numbers of their own, which hold once they are written
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    items = classes.select(F.col("node").alias("id"), "fp", "fp2", "n")
    found = cut(_candidates(items, similarity, first, radius, tile), "candidates")
    wanted = classes.join(found.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    wanted = cut(wanted.select("node", "id", "content"), "wanted")
    n_wanted = wanted.count()

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            hashes = [np.unique(np.fromiter(map(xxh64_intdigest, set(shingles(x, words))), np.uint64)).tobytes() for x in b.column(0).to_pylist()]
            content = list(map(content_of, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(hashes, pa.binary())], ["content", "hashes"])

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    texts = texts.join(small(wanted.select("id"), n_wanted), "id", "left_semi").select("text")
    sets = texts.mapInArrow(to_sets, "content binary, hashes binary")
    sets = sets.join(small(wanted.select("content", F.col("node").alias("id")), n_wanted), "content")
    sets = sets.groupBy("id").agg(F.min("hashes").alias("hashes"))

    def verify(key, group):
        import numpy as np
        import pandas as pd

        ids = group["id"].to_numpy()
        links = similar_links(ids, [np.frombuffer(x, np.uint64) for x in group["hashes"]], similarity)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    links = found.join(sets, "id").groupBy("pair").applyInPandas(verify, "a long, b long")
    rooted = cut(classes.join(components(cut(links, "similar"), "a", "b"), "node", "left").select("content", "id", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("keep_id"))
    kept = cut(rooted.join(least, "root").select("content", "keep_id"), "kept")
    named = prints.where("id IS NOT NULL").join(kept, "content").select("id", "keep_id", "content")
    alone = prints.where("id IS NULL").select("id", F.col("id").alias("keep_id"), "content")
    return named.unionByName(alone)


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, first: int = FIRST_RADIUS, radius: int = SIMILAR_RADIUS, tile: int = SIMILAR_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id of each row: the smallest id of its group of similar documents.

    Similar are documents whose sets of words-word shingles have a Jaccard similarity of similarity or more, as far as
    their fingerprints differ in at most radius of 128 bits, and first of the first 64; groups are connected components. Documents of the same
    word sequence are one from the start. Comparing all tiles is quadratic within a band of set sizes; that is
    the method. Rows with the same id and different texts are documents of their own; null ids stay alone, with a null keep_id. Null and
    empty texts are one group. Other columns play no part. An empty table gives no rows.
    """
    return _similar_rows(docs, words, similarity, first, radius, tile, id_col, text_col).select("id", "keep_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose similar_documents group has a smaller id. All columns stay as they are; identifiers may be numbers or text.

    Rows with a null id stay. Of null and empty texts the row with the smallest id stays. Rows that repeat an id and
    its words stay or go together. An empty table stays empty.
    """
    rows = cut(_similar_rows(docs, id_col=id_col, text_col=text_col, **how).where("id IS NOT NULL"), "similar_rows")
    gone = cut(rows.where("id <> keep_id").select("id", "content").distinct(), "gone")
    n_gone = gone.count()
    # a row travels as one value, so that no name of its own can clash
    told = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    out = told.join(small(gone.select("id"), n_gone), "id", "left_anti").select("doc")
    # ids with texts of both kinds: only their rows are told apart by their texts
    mixed = cut(rows.where("id = keep_id").select("id").distinct().join(gone.select("id").distinct(), "id", "left_semi"), "mixed")
    n_mixed = mixed.count()
    if n_mixed:

        @F.arrow_udf("binary")
        def content(texts: pa.Array) -> pa.Array:
            return pa.array([content_of(x) for x in texts.to_pylist()], pa.binary())

        both = told.join(small(mixed, n_mixed), "id", "left_semi").withColumn("content", content("text"))
        out = out.unionByName(both.join(small(gone, n_gone), ["id", "content"], "left_anti").select("doc"))
    return out.select("doc.*")
