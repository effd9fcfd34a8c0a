"""Secret scan: Aho-Corasick keywords first, anchored expressions near their hits, then checksums (operator 5)."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.common import slices, text_of

# The kinds in the order that breaks ties, their keywords and expressions.
KINDS = ["assign", "access", "hex", "github", "npm"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS_WORD = "AKIA"
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPAN = "array<struct<kind:string,start:long,end:long>>"

_IS_HEX = bytes(int(chr(i) in "0123456789abcdef") for i in range(256))


@functools.lru_cache(maxsize=1)
def automaton():
    """All keywords in lower case; once in each Python worker."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ASSIGN_WORDS:
        a.add_word(w, ("assign", len(w)))
    a.add_word(ACCESS_WORD.lower(), ("access", len(ACCESS_WORD)))
    for w in CHECKED_PREFIXES:
        a.add_word(w, ("checked", len(w)))
    a.make_automaton()
    return a


def checksum_holds(body: bytes, check: bytes) -> bool:
    """Whether check is the CRC-32 of body in six base-62 digits."""
    n, out = zlib.crc32(body), []
    for _ in range(6):
        n, d = divmod(n, 62)
        out.append(BASE62[d])
    return bytes(reversed(out)) == check


def hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    """Runs of HEX_MIN or more hexadecimal digits. Each holds a byte whose index is HEX_MIN - 1 modulo HEX_MIN: only those are probed."""
    probes, end, k = data[HEX_MIN - 1 :: HEX_MIN].translate(_IS_HEX), 0, -1
    while (k := probes.find(1, k + 1)) >= 0:
        at = k * HEX_MIN + HEX_MIN - 1
        if at < end:
            continue
        start = at
        while start > 0 and _IS_HEX[data[start - 1]]:
            start -= 1
        end = HEX.match(data, start).end()
        if end - start >= HEX_MIN:
            yield start, end


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed in KINDS.

    The spans of each kind don't overlap: what an expression has matched is used up, even where the match
    then fails its length or checksum.
    """
    data = text.encode()
    found: list[tuple[int, int, int, str]] = []
    used = dict.fromkeys(("assign", "access", "checked"), 0)
    # bytes as Latin-1 characters: the automaton's places are byte places
    hits = sorted((at - n + 1, kind) for at, (kind, n) in automaton().iter(data.lower().decode("latin-1")))
    for at, kind in hits:
        if at < used[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(data, at):
                used[kind] = m.end()
                if len(m[2]) >= ASSIGN_MIN:
                    found.append((at, 0, m.end(), "assign"))
        elif kind == "access":
            if m := ACCESS.match(data, at):
                used[kind] = m.end()
                if m.end() - at >= ACCESS_MIN:
                    found.append((at, 1, m.end(), "access"))
        elif m := CHECKED.match(data, at):
            used[kind] = m.end()
            if checksum_holds(m[1], m[2]):
                name = CHECKED_PREFIXES[data[at : at + 4].decode()]
                found.append((at, KINDS.index(name), m.end(), name))
    found += [(a, 2, b, "hex") for a, b in hex_runs(data)]
    found.sort()
    if len(data) == len(text):
        return [(k, a, b) for a, _, b, k in found]
    out, byte, point = [], 0, 0  # code points before a start; matches themselves are ASCII
    for a, _, b, k in found:
        point, byte = point + len(data[byte:a].decode()), a
        out.append((k, point, point + b - a))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans (kind, start, end) of each row of docs, found in its whole text.

    A null or empty text has an empty list; repeated rows give repeated rows; a null identifier stays
    null; other columns of docs are left out. Narrow: no shuffle, nothing depends on other rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x)] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, span)], [id_col, "spans"])

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, spans {SPAN}")
