"""Substring dedup, divergence audit and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteaudit.llm import divergence, merkle, queries, substring, words

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def key_of(i):
    return (i is not None, i if i is not None else 0)


# --- substring dedup ---


def plain_repeats(rows, size):
    """id, n_words, n_removed, kept of each row, from all pairs of windows and ids."""
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first, out = {}, []
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            w = tuple(ws[k : k + size])
            first[w] = min(first.get(w, key_of(i)), key_of(i))
    for i, ws in split:
        gone = {p for k in range(len(ws) - size + 1) if first[tuple(ws[k : k + size])] < key_of(i) for p in range(k, k + size)}
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def repeats_of(spark, rows, size=3, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).withColumn("chunk", F.lit("clash")).withColumn("id", F.lit(7)).repartition(3)
    return sorted((tuple(r) for r in substring.drop_repeats(df, size).collect()), key=repr)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d"), (5, "x a b c d y"), (5, "a  b\tc again"), (None, "q a b c"), (7, "ü 漢字 🎉 a b"), (8, "ü 漢字 🎉"), (9, "b c d b c d b c d"), (9, "b c d b c d b c d"), (10, "a\x1cb c \x85 d"), (0, "z z z z z z"), (11, "z z z"), (12, "A b c")]


def test_repeats_of_odd_rows(spark, monkeypatch):
    assert repeats_of(spark, ODD) == plain_repeats(ODD, 3)
    monkeypatch.setattr(substring, "CHUNK_BYTES", 40)
    assert repeats_of(spark, ODD) == plain_repeats(ODD, 3)
    assert repeats_of(spark, ODD[:0]) == []
    text = [(None if i is None else f"k{i}", t) for i, t in ODD]
    assert [r[1:] for r in repeats_of(spark, text, schema="doc_id string, text string") if r[0] == "k4"] == [(4, 3, "d")]


def test_repeats_of_random_rows(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(substring, "COUNTERS", 1e-9)  # the smallest sketch: most estimates are too high, none may be too low
    rng = random.Random(2)
    rows = [(rng.randrange(300), " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for _ in range(300)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, f"u{i} {passage} v{i}") for i in range(100)] + [(2000, "long " * 50_000 + passage)]
    assert repeats_of(spark, rows) == plain_repeats(rows, 3)
    monkeypatch.setattr(substring, "LEAST_PART", 4)
    assert repeats_of(spark, rows) == plain_repeats(rows, 3)


def test_repeats_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain_repeats(rows, 13)]
    assert sorted(tuple(r) for r in queries.op11_substring_dedup(spark, sf_dir).collect()) == sorted(want)


def test_texts_do_not_move(spark, sf_dir, monkeypatch):
    """The passes read the texts' buckets as they lie: no exchange below the Python steps but that of answers."""
    plans = []
    cut = substring.cut
    monkeypatch.setattr(substring, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    substring.drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for plan in plans:
        for block in re.split(r"\n(?=\S)|(?=Exchange)", plan):
            if block.startswith("Exchange"):
                assert "text" not in block.split("FileScan")[0].split("\n")[0]
    assert len(plans) == 3


def test_offsets_come_back():
    rng = np.random.default_rng(1)
    for low in (np.uint8, np.uint16, np.uint32):
        for top in (1, 300, 100_000, 1 << 25):
            x = np.sort(rng.integers(0, top, 500))
            assert substring.unpack_offsets(substring.pack_offsets(x, low), 500, low).tolist() == x.tolist()
    assert substring.unpack_offsets(substring.pack_offsets(np.array([], np.int64)), 0).tolist() == []


def test_words_by_bytes():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB \t\n\x0b\x1c\x85é漢🎉_1\x7f@[`{") for _ in range(rng.randrange(30))) if rng.random() < 0.9 else None for _ in range(500)]
    for table, pattern, low in ((words.VISIBLE, "[^\x20\x09-\x0d]+", False), (words.LETTERS, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+", True)):
        got = words.words(pa.array(texts).slice(3), table, low)
        want = [re.findall(pattern, (t or "").translate(LOWER) if low else t or "") for t in texts[3:]]
        assert got.values.to_pylist() == [w for ws in want for w in ws] and got.counts.tolist() == [len(ws) for ws in want]


# --- divergence ---


def plain_audit(rows, top=10, least=10):
    counts, docs, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for t, lang, source in rows:
        t, lang, source = (x or "" for x in (t, lang, source))
        groups.add((lang, source))
        ws = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(LOWER))
        counts[lang, source].update(ws)
        docs[lang].update(set(ws))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = sorted(s for x, s in groups if x == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        share = lambda k, total: 1 + 10**9 * (k + 2) // (total + 2 * len(kept))
        p = {s: {t: share(counts[lang, s][t], n[s]) for t in kept} for s in own}
        q = {t: share(sum(counts[lang, s][t] for s in own), sum(n.values())) for t in kept}
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in divergence.audit_sources(df, **how).collect())


def test_audit_of_odd_rows(spark):
    rows = [(None, None, None), ("", "en", ""), ("A a b", "en", "x"), ("a B c1c", "en", "y"), ("Ä ä é", "en", "y"), ("lone", "de", "x"), ("1 2", "fr", "x"), ("a", "fr", "x"), ("a", "fr", "z"), ("b", "en", "x"), ("a b", "en", None)]
    for least in (1, 2, 3, 99):
        assert audit_of(spark, rows, least_docs=least) == plain_audit(rows, least=least)
    assert audit_of(spark, rows[:0]) == []


def test_audit_of_random_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TREE_ROWS", 7)
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdefghijklmnopqrst") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(40))), rng.choice(("en", "de")), f"s{rng.choice((0, 0, 0, 1, 2, 3, 10, 11))}") for _ in range(300)]
    assert audit_of(spark, rows) == plain_audit(rows)
    assert audit_of(spark, rows + [("a " * 300_000, "en", "s0")], top=3) == plain_audit(rows + [("a " * 300_000, "en", "s0")], top=3)


def test_audit_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in queries.op12_divergence(spark, sf_dir).collect()) == plain_audit(rows)


def test_shared_paths_count_once():
    tree = divergence.TermTree()
    row = [(1, 5, 1), (2, 7, 1), (3, 9, 1)]
    tree.insert(row, 4)
    tree.insert(row[:2], 2)
    assert len(tree.items) == 4 and tree.terms[1:] == [6, 6, 4]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    joint = lambda p, q: f(p, q) - f(p, 1) - f(1, q) + f(1, 1)
    assert tree.corrections() == {(2, 1): 6 * joint(7, 5), (3, 2): 4 * joint(9, 7), (3, 1): 4 * joint(9, 5)}


# --- Merkle ---


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node its place and siblings at each level."""
    level, found, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        for j, i in enumerate(at):
            run = level[i - i % 16 : i - i % 16 + 16]
            found[j].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
            at[j] = i // 16
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
    return level[0], found


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by, out = defaultdict(list), []
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (key_of(r[0]), leaf_of(r)))
    trees = {s: climb([leaf_of(r) for r in by[s]]) for s in order}
    if not order:
        return []
    root, upper = climb([trees[s][0] for s in order])
    for s, above in zip(order, upper):
        for r, own in zip(by[s], trees[s][1]):
            leaf, path = leaf_of(r), own + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = leaf_of(r[:4] + (r[4].translate(LOWER),)) if tampered else leaf
            for at, others in path:
                folded = sha("".join(others[:at] + [folded] + others[at:]))
            out.append((r[0], leaf, trees[s][0], root, sha("".join(d for _, others in path for d in others)), folded, folded == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("tree", F.lit(1)).withColumn("i", F.lit(1)).withColumn("digest", F.lit(1)).repartition(3)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(df, changed=changed, changes={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some_rows(n, seed=9):
    rng = random.Random(seed)
    rows = [(i, rng.choice(("a", "a", "a", "b", "ä", "", None)), rng.choice(("en", None)), rng.choice((1, None)), rng.choice(("Text", "text", None, "", "Ü漢"))) for i in range(n)]
    return rows + rows[:2] + [(None, "a", None, None, "X"), (5, "lone", None, 5, "A" * 200_000), (-10, "a", "en", 1, "Neg")]


@pytest.mark.parametrize("n, block", [(0, 3), (20, 3), (700, 1), (700, 2), (700, 3)])
def test_manifest_of_random_rows(spark, monkeypatch, n, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = some_rows(n) if n else []
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 1)
    rows = [(i, f"s{i % 300}", "en", i, f"Text {i}") for i in range(310)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_query_is_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_merkle(spark, sf_dir).collect()), key=repr) == plain_manifest(rows)


def test_addresses_are_a_layout():
    """Every node has a place of its own; upper halves lie before lower ones, each of which lies together."""
    for levels in range(1, 6):
        places = [merkle.address(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size_of(levels)))
        upper = levels // 2
        if levels > 1:
            assert max(p.max() for p in places[:upper]) == merkle.size_of(upper) - 1
            lower = merkle.size_of(levels - upper)
            for k in (0, 1, 16**upper - 1):
                own = np.concatenate([p[k * 16 ** (d - upper) : (k + 1) * 16 ** (d - upper)] for d, p in enumerate(places) if d >= upper])
                assert own.min() == merkle.size_of(upper) + k * lower and own.max() == own.min() + lower - 1


@pytest.mark.parametrize("leaves, levels", [(1, 1), (1, 3), (16, 2), (17, 3), (300, 4), (4096, 4)])
def test_blocks_give_back_their_nodes(leaves, levels):
    digests = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(leaves)]
    block = merkle.Block.build(digests, levels)
    assert len(block.nodes) == 32 * sum(merkle.widths(leaves, levels))
    assert [block.digest(levels - 1, i) for i in range(leaves)] == digests
    for i in {0, leaves - 1, leaves // 2}:
        assert merkle.fold(digests[i], *merkle.path_of(block, i, (b"", b""))) == block.digest(0, 0) == block.nodes[:32]
