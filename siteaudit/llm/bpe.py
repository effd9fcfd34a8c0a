"""Byte-level BPE with the tiktoken library and a local rank file (operator 9)."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import slices, text_of

#: Texts over so many characters are split before they are encoded.
SPLIT_CHARS = 50_000
#: Unicode's White_Space property, which the \s of the split pattern stands for.
WHITE = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_EDGE = re.compile(f"[^{WHITE}](?=[{WHITE}])")
#: White space of so many characters is taken out of a text before the library's expression sees it, whose stack such a run can overflow.
LONG_RUN = 500
_RUN = re.compile(f"[{WHITE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file; once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """text in pieces of about size characters, cut only between a visible character and white space.

    No alternative of the split pattern matches white space after a visible character, and its only
    look-ahead looks to the right: the pieces' matches are those of the whole text.
    A text without such a place stays in one piece.
    """
    at = 0
    while len(text) - at > size:
        edge = _EDGE.search(text, at + size - 1)
        if edge is None:
            break
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


def encode(text: str, enc) -> list[int]:
    """Ids of a whole text."""
    if len(text) <= SPLIT_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in _encode_piece(piece, enc)]


def _encode_piece(piece: str, enc) -> list[int]:
    """Ids of a piece of safe_pieces, which ends with a visible character or with its text.

    A run of white space is one match at the end of a text; before a visible character it is one match but for
    its last character, which goes with what follows.
    """
    ids, at = [], 0
    for run in _RUN.finditer(piece):
        end = run.end() if run.end() == len(piece) else run.end() - 1
        ids += enc.encode_ordinary(piece[at : run.start()])
        ids += enc._encode_single_piece(piece[run.start() : end])
        at = end
    return ids + enc.encode_ordinary(piece[at:])


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode its ids: id_col, ids (binary: little-endian unsigned 32-bit), decoded (binary).

    One row for each row of docs, repeated rows included; a null text is empty and has no ids, a null
    identifier stays null. Texts may be of any length, with runs of any length. An empty table gives no rows. Other
    columns of docs are left out, so their names can't clash. Narrow: no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoding(path, pattern)
        for b in slices(batches):
            ids = [encode(x, enc) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())],
                [id_col, "ids", "decoded"],
            )

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, ids binary, decoded binary")
