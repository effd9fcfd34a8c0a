"""Substring dedup by a count-min prefilter and an exact grouping of what it lets through (operator 11).

Documents lie in chunks of bounded size, in a table with a bucket for each chunk's number, so that the three passes over the
texts move no text. A window travels as two offsets of some eleven bits each in the first pass, as two bits in its answer, and as its
128-bit hash only if both rows of the sketch say that another chunk may hold it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import cut, scratch, slices
from siteaudit.llm.words import VISIBLE, Words, words

#: Bytes of text in a chunk, but for one text that is longer.
CHUNK_BYTES = 8_000_000
#: Spark's bound on the buckets of a table; several chunks share a bucket beyond it.
MOST_BUCKETS = 100_000
#: Counters of a sketch row for each byte of text: about four for each window of European text.
COUNTERS = 0.6
#: Counters of a part of a row that is merged in one group: 2^16 to 2^24, 2^9 parts where that leaves the choice.
LEAST_PART, MOST_PART, PARTS = 16, 24, 9


def row_bits(n_bytes: int) -> int:
    """Binary logarithm of the counters of a row."""
    return max(LEAST_PART, math.ceil(math.log2(max(1, n_bytes * COUNTERS))))


def part_bits(bits: int) -> int:
    return min(bits, max(LEAST_PART, min(MOST_PART, bits - PARTS)))


#: Windows that are hashed at once.
BLOCK = 16_384


# --- offsets in ascending order: their differences, low bits as they are, the others as so many zeros before a one ---


def pack_offsets(offsets: np.ndarray, low: type = np.uint8) -> bytes:
    bits = np.dtype(low).itemsize * 8
    steps = np.diff(offsets, prepend=0)
    ones = np.cumsum((steps >> bits) + 1) - 1
    high = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    high[ones] = 1
    return steps.astype(low).tobytes() + np.packbits(high).tobytes()


def unpack_offsets(data: bytes | memoryview, n: int, low: type = np.uint8) -> np.ndarray:
    split = n * np.dtype(low).itemsize
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=split)))[:n]
    high = np.diff(ones, prepend=-1) - 1
    return np.cumsum((high << (8 * np.dtype(low).itemsize)) + np.frombuffer(data, low, n))


def low_for(bits: int, windows: float) -> type:
    """The low bits that suit the mean difference of a chunk's offsets."""
    mean = 2.0**bits / max(1, windows)
    return np.uint8 if mean < 2_000 else np.uint16 if mean < 500_000 else np.uint32


# --- the windows of a chunk ---


@dataclass
class Windows:
    """Windows of a chunk's documents in the order of their identifiers, and the distinct ones among them.

    order sorts windows by hash; each distinct one is a run there, which begins at runs and whose first window is that
    of the smallest identifier.
    """

    ids: pa.Array
    rank: np.ndarray
    words: Words
    at: np.ndarray
    doc: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    order: np.ndarray
    runs: np.ndarray


def _hashes(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the size words from each place; those beyond a document's end are without meaning."""
    coded = pc.dictionary_encode(found.values)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    pairs = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w or "") for w in coded.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    n = max(0, len(codes) - size + 1)
    factors = np.random.default_rng(13).integers(0, 2**63, (2, size), np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((2, n), np.uint64)
    for k in (0, 1):
        own = np.ascontiguousarray(pairs[:, k])[codes]
        for i in range(0, n, BLOCK):  # a block stays in the processor's cache
            total = out[k, i : i + BLOCK]
            for j in range(size):
                total += own[i + j : i + j + len(total)] * factors[k, j]
    return out[0], out[1]


def windows_of(table: pa.Table, size: int) -> Windows:
    """table: id, text. Equal identifiers have one rank; a null one is the smallest."""
    table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_start"))
    ids = table["id"].combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0) if ids.num_chunks else pa.array([], ids.type)
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    rank = np.cumsum(np.diff(codes, prepend=codes[:1]) != 0)
    found = words(table["text"], VISIBLE)
    h1, h2 = _hashes(found, size)
    doc = np.repeat(np.arange(len(ids)), found.counts)[: len(h1)]
    at = np.flatnonzero(np.arange(len(h1)) + size <= found.starts[doc + 1])
    h1, h2, doc = h1[at], h2[at], doc[at]
    order = np.argsort(h1, kind="stable")
    same = h1[order][1:] == h1[order][:-1]
    if (same & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h1))
        same = h1[order][1:] == h1[order][:-1]
    runs = np.flatnonzero(np.append(True, ~(same & (h2[order][1:] == h2[order][:-1])))[: len(order)])
    return Windows(ids, rank, found, at, doc, h1, h2, order, runs)


def _cells(w: Windows, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """row, counters of the distinct windows in ascending order, and how the distinct windows lie in it."""
    first = w.order[w.runs]
    shift = np.uint64(64 - bits)
    yield 0, (w.h1[first] >> shift).astype(np.int64), None
    second = (w.h2[first] >> shift).astype(np.int64)
    place = np.argsort(second)
    yield 1, second[place], place


# --- the three passes ---


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, int]:
    """chunk, id, text as a table with a bucket for each chunk, its name and the bytes of all texts. Texts are written where they are read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema = "chunk long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            if held and held + batch.nbytes > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += batch.nbytes
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, chunk)), *batch.columns], ["chunk", "id", "text"])

    buckets = max(1, min(MOST_BUCKETS, max(math.ceil(n_bytes / CHUNK_BYTES), rows.rdd.getNumPartitions())))
    name = f"siteaudit_chunks_{uuid.uuid4().hex[:12]}"
    written = rows.mapInArrow(number, schema).write.format("parquet").bucketBy(buckets, "chunk")
    written.option("compression", "zstd").option("path", scratch(spark, "chunks")).saveAsTable(name)
    return spark.table(name), name, n_bytes


def _sketches(chunks: DataFrame, size: int, bits: int) -> DataFrame:
    """Each chunk's own sketch: a row for each part of it that isn't empty, with the counters that its distinct windows raise by one."""
    part, low = part_bits(bits), low_for(bits, CHUNK_BYTES * COUNTERS / 4)

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        out = {"row": [], "part": [], "n": [], "offsets": []}
        for row, cells, _ in _cells(windows_of(table, size), bits):
            parts, starts = np.unique(cells >> part, return_index=True)
            for p, own in zip(parts.tolist(), np.split(cells, starts[1:]) if len(starts) else []):
                for k, v in zip(out, (row, p, len(own), pack_offsets(own - (p << part), low))):
                    out[k].append(v)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(out["row"]), pa.int64())} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return chunks.groupBy("chunk").applyInArrow(sketch, "chunk long, row int, part long, n int, offsets binary")


def _estimates(sketches: DataFrame, bits: int) -> DataFrame:
    """The merged sketch's answer to each chunk: a bit for each of its offsets, whether the counter is above one. A group is one part of a row, with a set number of counters."""
    part, low = part_bits(bits), low_for(bits, CHUNK_BYTES * COUNTERS / 4)

    def merge(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        cells = np.concatenate([unpack_offsets(x.as_buffer(), n, low) for x, n in zip(table["offsets"], sizes)])
        often = np.split(np.bincount(cells, minlength=1 << part)[cells] > 1, np.cumsum(sizes)[:-1])
        flags = pa.array([np.packbits(x).tobytes() for x in often], pa.binary())
        return table.select(["chunk", "row", "part", "n"]).append_column("flags", flags)

    return sketches.groupBy("row", "part").applyInArrow(merge, "chunk long, row int, part long, n int, flags binary")


def _candidates(chunks: DataFrame, answers: DataFrame, size: int, bits: int) -> DataFrame:
    """chunk, number, h1, h2 and id (the smallest in the chunk) of the distinct windows of a chunk whose least count is above one."""
    id_type = chunks.schema["id"].dataType.simpleString()

    def choose(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "number": pa.array([], pa.int32()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "id": docs["id"].slice(0, 0)})
        w = windows_of(docs, size)
        told = told.sort_by([("row", "ascending"), ("part", "ascending")])
        rows, flags = told["row"].to_pylist(), [np.unpackbits(np.frombuffer(f.as_buffer(), np.uint8), count=n.as_py()) for f, n in zip(told["flags"], told["n"])]
        often = np.ones(len(w.runs), bool)
        for row, cells, place in _cells(w, bits):
            own = np.concatenate([f for r, f in zip(rows, flags) if r == row] or [np.zeros(0, np.uint8)]).astype(bool)
            if place is None:
                often &= own
            else:
                often[place] &= own
        number = np.flatnonzero(often)
        first = w.order[w.runs[number]]
        return pa.table({"chunk": pa.array(np.full(len(number), key[0].as_py()), pa.int64()), "number": pa.array(number, pa.int32()), "h1": pa.array(w.h1[first].view(np.int64)), "h2": pa.array(w.h2[first].view(np.int64)), "id": w.ids.take(pa.array(w.doc[first]))})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(choose, f"chunk long, number int, h1 long, h2 long, id {id_type}")


def _repeated(candidates: DataFrame) -> DataFrame:
    """chunk, numbers of its windows that a document of another chunk with a smaller identifier holds. Exact: grouped by the 128-bit hash; a group has a row for each chunk at most, however often a chunk repeats it."""
    own = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"))
    least = F.min(own).over(Window.partitionBy("h1", "h2"))
    return candidates.withColumn("least", least).where(F.col("least") < own).groupBy("chunk").agg(F.collect_list("number").alias("numbers"))


def _kept(chunks: DataFrame, repeated: DataFrame, size: int) -> DataFrame:
    """id, n_words, n_removed, kept of all rows: windows that a chunk repeats itself are found anew, those of other chunks come as numbers."""
    id_type = chunks.schema["id"].dataType.simpleString()

    def keep(docs: pa.Table, told: pa.Table) -> pa.Table:
        w = windows_of(docs, size)
        n = len(w.words.values)
        run = np.zeros(len(w.order), np.int64)
        run[w.runs] = 1
        run = np.cumsum(run) - 1
        first = w.rank[w.doc[w.order[w.runs]]]
        elsewhere = np.zeros(len(w.runs), bool)
        if told.num_rows:
            elsewhere[told["numbers"].combine_chunks().flatten().to_numpy(zero_copy_only=False)] = True
        gone = w.at[w.order[elsewhere[run] | (w.rank[w.doc[w.order]] > first[run])]]
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + size, -1)
        kept = np.cumsum(steps[:-1]) == 0
        upto = np.append(0, np.cumsum(kept))[w.words.starts]
        texts = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), w.words.values.filter(pa.array(kept)))
        return pa.table({"id": w.ids, "n_words": pa.array(w.words.counts, pa.int64()), "n_removed": pa.array(w.words.counts - np.diff(upto), pa.int64()), "kept": pc.binary_join(texts, pa.scalar(" ", pa.large_string())).cast(pa.string())})

    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(keep, f"id {id_type}, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, n_words, n_removed and kept (the other words, joined by one space) of each row of docs. shown: what is written of kept, else all of it.

    Words are what lies between white space (space and the controls 9 to 13), unchanged. A word goes if it is in a
    window of size consecutive words that also begins in a row with a smaller id; windows are those of the input.
    Repeats within one document, or among rows with the same id, take nothing from each other. A null id is smaller
    than all others; null and empty texts have no words; documents of fewer words than a window keep them. Repeated rows
    give a row each, an empty table none; other columns of docs play no part, whatever their names.

    Windows of one sequence are never told apart. Different ones are taken for one only if 128 bits of their hashes are
    equal (for 10^13 windows that happens with a probability below 10^-12).
    """
    spark = docs.sparkSession
    chunks, name, n_bytes = _chunked(docs, id_col, text_col)
    try:
        bits = row_bits(n_bytes)
        answers = cut(_estimates(_sketches(chunks, size, bits), bits), "estimates")
        repeated = cut(_repeated(_candidates(chunks, answers, size, bits)), "repeated")
        kept = _kept(chunks, repeated, size)
        return cut(kept.withColumn("kept", shown(F.col("kept"))) if shown else kept, "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
