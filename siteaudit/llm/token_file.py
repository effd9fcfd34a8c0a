"""Token ids as Arrow files of equal-length sequences (operator 3).

A folder holds shards: shard-N.arrow in the Arrow file format, whose batches have two fixed-size-list columns,
ids (unsigned 16 or 32 bits) and mask (bits; false where the last sequence is padded), and shard-N.index.arrow
with doc_id, start and n_tokens of each document in it. Documents follow each other in ascending doc_id order,
through the shards in ascending order. All batches of a shard but the last have the same number of sequences,
so token k of a shard lies at a computed place: a memory map gives it without reading or copying anything else.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.bpe import WHITE
from siteaudit.llm.common import cut, slices, text_of

#: Tokens of a sequence, sequences of a batch.
LENGTH, BATCH = 2048, 512
#: Words and chunks of text whose ids a worker keeps: at some 250 bytes each up to 250 MB.
MEMO = 1_000_000
#: Rows of a slice that is encoded at once.
SLICE = 2048
#: Longer ones aren't kept.
KEPT_CHARS = 64
# A chunk ends before white space that follows a visible character, or after Latin letters before ASCII punctuation.
# The tokenizer's own split has an edge at each such place, so chunks can be encoded one by one.
_LATIN, _MARKS = "a-zA-Z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "!-/:-@\\[-`{-~"
_CHUNK = re.compile(f"[{WHITE}]*[{_LATIN}]+(?=[{WHITE}{_MARKS}]|\\Z)|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORD = re.compile(f"([{_LATIN}]+)([{WHITE}{_MARKS}]|\\Z)")


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which gets each distinct word once as long as the memo has room.

    Arrow splits a batch of texts at their spaces and numbers its distinct parts; a space that follows a visible
    character starts a piece of the tokenizer's own split. Texts with other spaces are split by the chunk expression.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        #: Ids of parts that follow a space, the space included; and of what follows another edge.
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        # A Latin word is one piece of the usual byte-level split: the library's BPE model takes it without looking for edges.
        usual = str(pre_tokenizers.ByteLevel(add_prefix_space=False))
        self.model = self.tokenizer.model if self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == usual else None
        self.signs = byte_signs()

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, words: list[str]) -> list[bytes]:
        """Ids of Latin words, each with or without a space before it."""
        import numpy as np

        if self.model is None or not words:
            return self._library(words)
        ids, ends = [], [0]
        for w in "\n".join(words).encode().decode("latin-1").translate(self.signs).split(self.signs[10]):
            ids += [t.id for t in self.model.tokenize(w)]
            ends.append(len(ids))
        raw, size = np.array(ids, self.dtype).tobytes(), int(self.dtype[-1])
        return [raw[size * x : size * y] for x, y in zip(ends, ends[1:])]

    def _learn(self, keys: Iterable[str], space: str) -> dict[str, bytes]:
        """Ids of keys, each behind space, from the library."""
        words, rest = [], []
        for k in keys:
            w = _WORD.match(k)
            (words if w and w.end(1) == len(k) else rest).append(k)
        own = dict(zip(words, self._latin([space + k for k in words])))
        own |= zip(rest, self._library([space + k for k in rest]))
        return own

    def parts(self, keys: list[str]) -> list[bytes | None]:
        """Ids of each distinct key behind a space; None where the next space, which follows white space, may be no edge."""
        got = list(map(self.spaced.get, keys))
        alone, cut_at, heads, tails = [], {}, set(), set()
        for i in [i for i, ids in enumerate(got) if ids is None]:
            part = keys[i]
            if not part or part[-1].isspace():
                continue
            w = _WORD.match(part)
            if w and w.end(1) < len(part):
                cut_at[i] = w.end(1)
                heads.add(w[1])
                tails.add(part[w.end(1) :])
            else:
                alone.append(i)
        known = {h: self.spaced[h] for h in heads if h in self.spaced}
        ends = self.by_chunk(tails)
        own = self._learn({keys[i] for i in alone} | (heads - known.keys()), " ")
        known |= own
        for i in alone:
            got[i] = own[keys[i]]
        for i, at in cut_at.items():
            got[i] = own[keys[i]] = known[keys[i][:at]] + ends[keys[i][at:]]
        keep(self.spaced, own, zip(keys, got))
        return got

    def by_chunk(self, texts: Iterable[str]) -> dict[str, bytes]:
        """Ids of texts that begin at an edge, chunk by chunk."""
        chunks = {x: _CHUNK.findall(x) for x in texts}
        every = set().union(*chunks.values())
        known = {c: self.bare[c] for c in every if c in self.bare}
        own = self._learn(every - known.keys(), "")
        keep(self.bare, own, known.items())
        known |= own
        return {x: b"".join(map(known.__getitem__, c)) for x, c in chunks.items()}

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as bytes."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten().dictionary_encode()
        keys, at = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy().copy()
        firsts = [keys[i] for i in at[starts[:-1]].tolist()]  # no space comes before these
        ids = self.parts(keys)
        odd = np.array([x is None for x in ids])
        whole = np.logical_or.reduceat(odd[at], starts[:-1]) if len(at) else np.zeros(len(texts), bool)
        begin = self.by_chunk({f for f, w in zip(firsts, whole) if not w})
        at[starts[:-1]] = len(keys) + np.arange(len(firsts))
        ids = [x or b"" for x in ids] + [begin.get(f, b"") for f in firsts]
        size = int(self.dtype[-1])
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // size)])
        kind = pa.uint16() if size == 2 else pa.uint32()
        taken = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), self.dtype), kind)).take(pa.array(at))
        bounds, values = taken.offsets.to_numpy()[starts], memoryview(taken.values.to_numpy().view(np.uint8))
        out = [values[size * x : size * y].tobytes() for x, y in zip(bounds, bounds[1:])]
        if whole.any():
            rest = np.flatnonzero(whole).tolist()
            own = [texts[i].as_py() for i in rest]
            coded = self.by_chunk(set(own))
            for i, x in zip(rest, own):
                out[i] = coded[x]
        return out


def keep(memo: dict[str, bytes], own: dict[str, bytes], used: Iterable[tuple[str, bytes | None]]) -> None:
    """Put own into memo. When it is full it forgets all but what is used now. Long keys aren't kept."""
    if len(memo) + len(own) > MEMO:
        memo.clear()
        memo.update((k, v) for k, v in used if v is not None and len(k) <= KEPT_CHARS)
    memo.update((k, v) for k, v in own.items() if len(k) <= KEPT_CHARS)


def byte_signs() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes in turn for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return WordEncoder(path)


def file_system(folder: str):
    """pyarrow's file system and path of a folder that is named as Spark names it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


class ShardWriter:
    """Writes one shard under a name of its own and moves it into place when it is whole: a task that runs again replaces it."""

    def __init__(self, folder: str, shard: int, dtype: str, length: int = LENGTH, batch: int = BATCH):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.own = f"{root}/shard-{shard:06d}", f"{root}/.own-{uuid.uuid4().hex}"
        self.length, self.batch, self.dtype = length, batch, dtype
        self.kind = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.sink = self.fs.open_output_stream(self.own)
        self.out = pa.ipc.new_file(self.sink, pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))]))
        self.held, self.held_bytes, self.tokens = [], 0, 0
        self.starts: list[int] = []
        self.counts: list[int] = []

    def add(self, ids: bytes) -> None:
        n = len(ids) // int(self.dtype[-1])
        self.starts.append(self.tokens)
        self.counts.append(n)
        self.tokens += n
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.batch * self.length * int(self.dtype[-1]):
            self._write(last=False)

    def _write(self, last: bool) -> None:
        import numpy as np

        ids, whole = np.frombuffer(b"".join(self.held), self.dtype), self.batch * self.length
        at = 0
        while len(ids) - at >= whole or (last and at < len(ids)):
            part = ids[at : at + whole]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            if pad:
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(pad, self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((part, self.kind), (mask, pa.bool_()))]
            self.out.write_batch(pa.record_batch(lists, ["ids", "mask"]))
            at += whole
        rest = ids[at:].tobytes()
        self.held, self.held_bytes = [rest], len(rest)

    def close(self, doc_ids: pa.Array) -> None:
        self._write(last=True)
        self.out.close()
        self.sink.close()
        index = pa.table({"doc_id": doc_ids, "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with self.fs.open_output_stream(f"{self.own}.index") as sink, pa.ipc.new_file(sink, index.schema) as out:
            out.write_table(index)
        self._place(f"{self.own}.index", f"{self.path}.index.arrow")
        self._place(self.own, f"{self.path}.arrow")

    def _place(self, own: str, path: str) -> None:
        """Move a file; what an earlier run of the task left there goes, as some file systems move onto nothing."""
        from pyarrow import fs

        if self.fs.get_file_info(path).type != fs.FileType.NotFound:
            self.fs.delete_file(path)
        self.fs.move(own, path)


class ShardReader:
    """Random access to a shard. On a local path everything is a view of a memory map."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        system, root = file_system(folder)
        path = f"{root}/shard-{shard:06d}"
        opened = (lambda p: pa.memory_map(p)) if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.file = pa.ipc.open_file(opened(f"{path}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{path}.index.arrow")).read_all()
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows * self.length if self.file.num_record_batches else 1

    @functools.lru_cache(maxsize=2)  # noqa: B019  a reader lives as long as its task
    def _batch(self, k: int):
        return self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of the k-th sequence."""
        rows = self.per_batch // self.length
        b, at = self.file.get_batch(k // rows), k % rows
        return b.column(0)[at].values, b.column(1)[at].values

    def tokens(self, start: int, n: int):
        """n ids from start on, in the shard's counting; a view where they lie in one batch."""
        import numpy as np

        parts, end = [], start + n
        while start < end:
            k, at = divmod(start, self.per_batch)
            take = min(end - start, self.per_batch - at)
            parts.append(self._batch(k)[at : at + take])
            start += take
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, length: int = LENGTH, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, append end_id to each, and write the folder. Returns its manifest: shard, n_docs, n_tokens, start.

    start counts the ids of all shards before. A null or empty text is end_id alone. Rows with the same
    identifier follow each other by text; null identifiers come first. An empty table gives an empty folder and
    manifest. Other columns of docs are left out. One shuffle, of the texts by ranges of id_col: encoded ids would
    be as many bytes, and would have to be written once more, as ranges are sampled in a run of their own.
    """
    kind = docs.schema[id_col].dataType

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        code, writer, doc_ids, end = encoder(tokenizer), None, [], b""
        shard = TaskContext.get().partitionId()
        for b in slices(batches, SLICE):
            if b.num_rows == 0:
                continue
            if writer is None:
                writer, end = ShardWriter(folder, shard, code.dtype, length, batch), np.array([end_id], code.dtype).tobytes()
            doc_ids.append(b.column(0))
            for ids in code(b.column(1)):
                writer.add(ids + end)
        if writer is not None:
            writer.close(pa.chunked_array(doc_ids).combine_chunks())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(writer.counts)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ranged = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    shards = cut(ranged.mapInArrow(work, "shard int, n_docs long, n_tokens long"), "shards")
    # one row for each shard: a window over all of them is small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("id_type", F.lit(kind.simpleString()))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (over the whole folder), n_tokens and ids_crc32 of each document, read from the files; crc32 of the ids as little-endian unsigned 32-bit integers.

    One row for each row that was written, repeated and null identifiers included; identifiers are whole numbers. A
    document of a null or empty text has its end id alone. The manifest of an empty table gives no rows.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = ShardReader(folder, shard)
                for part in reader.index.to_batches(max_chunksize=4096):
                    starts, counts = part.column(1).to_pylist(), part.column(2).to_pylist()
                    crc = [zlib.crc32(reader.tokens(s, n).astype("<u4")) for s, n in zip(starts, counts)]
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([first + s for s in starts], pa.int64()), part.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = manifest.select("shard", "start")
    n = max(1, shards.count())  # a number of its own: tiny rows stand for much work and must not be put together
    return shards.repartition(n, "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
