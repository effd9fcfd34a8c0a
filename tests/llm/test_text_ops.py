"""Secrets, BPE, token files, dedup, mixing and URL filter against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteaudit.llm import bpe, exact_dedup, mixing, queries, secret_scan, token_file, url_filter
from siteaudit.llm.common import scratch

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "plain words"), (5, "x" * 120_000), (6, "a b " * 40_000), (7, "it's  two   spaces 　 and\ttabs\n\n end "),
    (8, "Ünïcödé 漢字 🎉 ​ é"), (9, "<|endoftext|> in a text"), (10, "don't CAN'T we'll 123abc 4²x"), (11, "plain words"), (12, "\x1c \x1d\x85 y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(7))


def docs_of(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# --- BPE ---


def tokens_of(text):
    return bpe.encoding(*queries.rank_file()).encode_ordinary(text or "")


def test_bpe_of_odd_texts(odd):
    got = {r.doc_id: r for r in bpe.round_trip(odd, *queries.rank_file()).collect()}
    assert set(got) == {i for i, _ in ODD}
    for i, t in ODD:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == tokens_of(t)
        assert bytes(got[i].decoded).decode() == (t or "")


def test_safe_pieces_change_nothing():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(" \n\t 　ab'sé1!.²\x1c") for _ in range(rng.randrange(400)))
        pieces = list(bpe.safe_pieces(text, rng.randrange(1, 40)))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in tokens_of(p)] == tokens_of(text)


def plain_merge(piece, enc):
    """Ids of one match by merging the pair of least rank, the first of those, until none has a rank."""
    ranks, parts = enc._mergeable_ranks, [bytes([b]) for b in piece.encode()]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[x] for x in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


RUNS = [" ", "\n", "\t", " \n", "\n\n ", "\u3000", "\xa0 "]


def test_long_runs_are_the_librarys(monkeypatch):
    """Where the library can take them, and by a plain merge."""
    enc, rng = bpe.encoding(*queries.rank_file()), random.Random(6)
    monkeypatch.setattr(bpe, "SPLIT_CHARS", 0)
    monkeypatch.setattr(bpe, "_RUN", re.compile(f"[{bpe.WHITE}]{{3,}}"))
    for run in RUNS:
        for n in (1, 2, 3, 7, 50):
            white = run * n
            for text in (white, "a" + white, white + "b", "a" + white + "b", "a" + white + ".", f"é{white}漢{white}'s {white}"):
                assert bpe.encode(text, enc) == enc.encode_ordinary(text)
            assert enc._encode_single_piece(white) == plain_merge(white, enc)
    for _ in range(300):
        text = "".join(rng.choice([*RUNS, "    ", "a", "b.", "'s", "1"]) for _ in range(rng.randrange(40)))
        assert bpe.encode(text, enc) == enc.encode_ordinary(text)


def test_millions_of_spaces_and_lines(spark):
    enc, n = bpe.encoding(*queries.rank_file()), 3_000_000
    for sign in (" ", "\n"):
        long, few = sign * n, sign * 1000  # the same matches around a shorter run
        for text in ("{}", "a{}", "{}b", "a b {}c d", "a{}b{}\t."):
            ids, want = bpe.encode(text.format(long, long), enc), enc.encode_ordinary(text.format(few, few))
            assert enc.decode(ids) == text.format(long, long) and ids[:3] == want[:3] and ids[-3:] == want[-3:]
    for sign in ("x", ".", "1", "é", "漢"):
        assert enc.decode(bpe.encode(sign * (n // 3), enc)) == sign * (n // 3)
    df = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000)], "doc_id long, text string")
    assert [bytes(r.decoded).decode() for r in bpe.round_trip(df, *queries.rank_file()).orderBy("doc_id").collect()] == ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000]


def test_bpe_query(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in queries.op9_bpe_round_trip(spark, sf_dir).collect()}
    for i, t in docs_of(spark, sf_dir):
        ids = tokens_of(t)
        assert got[i] == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


# --- token files ---


def coded(code, texts):
    return [np.frombuffer(x, code.dtype).tolist() for x in code(pa.array(texts, pa.string()))]


def test_words_are_whole_text_ids():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    plain, code = Tokenizer.from_file(path), token_file.WordEncoder(path)
    signs = [*" \n\t 　жaÀb'sé1!.²×_\x1c\x85ªƻ漢", "  ", "word", "don't", "<|endoftext|>", "<|", "endoftext"]
    texts = [t or "" for _, t in ODD if len(t or "") < 1000] + ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts += [" ".join("".join(rng.choice("aéb.,'1") for _ in range(rng.randrange(1, 6))) for _ in range(50)) for _ in range(50)]
    want = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert coded(code, texts) == want == coded(code, texts) and coded(code, []) == []
    code.model = None  # another tokenizer than the usual byte-level one
    code.spaced.clear(), code.bare.clear()
    assert coded(code, texts) == want


def test_long_runs_of_one_sign():
    path = public_tokenizers.path("byte_bpe_50k.json")
    code, plain = token_file.WordEncoder(path), Tokenizer.from_file(path)
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" * 300_000, "\t " * 200_000 + "."):
        assert coded(code, [text]) == [plain.encode(text, add_special_tokens=False).ids]


def test_special_tokens_are_the_librarys_own(spark):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    plain, parts = Tokenizer.from_file(path), ["<|endoftext|>", "<|endoftext|", "<|", "endoftext", "|>", "a", "É", "1", " ", "  ", "\n", ".", "'s", "漢", "<"]
    texts = ["<|endoftext|> in a text", "<|endoftext|>", "it<|endoftext|>'s  <|endoftext|>  x"] + ["".join(rng.choice(parts) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = scratch(spark, "sequences")
    got = {r.doc_id: tuple(r) for r in token_file.read_documents(token_file.write_sequences(df, path, folder), folder).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_a_full_memo_still_encodes(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["one two three four", "five one six", "one two", "two, two, one. seven", "one\ntwo"]
    want = coded(token_file.WordEncoder(path), texts)
    monkeypatch.setattr(token_file, "MEMO", 3)
    code = token_file.WordEncoder(path)
    assert [coded(code, [t])[0] for t in texts] == want


def test_a_shard_written_again(spark):
    folder = scratch(spark, "sequences")
    for n in (1, 2):
        writer = token_file.ShardWriter(folder, 0, "<u2", length=4, batch=2)
        for k in range(n):
            writer.add(np.arange(5, dtype="<u2").tobytes())
        writer.close(pa.array(range(n)))
    reader = token_file.ShardReader(folder, 0)
    assert reader.index.num_rows == 2 and reader.tokens(5, 5).tolist() == [0, 1, 2, 3, 4]


def test_token_file_query(spark, sf_dir):
    plain, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: tuple(r) for r in queries.op3_token_file(spark, sf_dir).collect()}
    for i, t in sorted(docs_of(spark, sf_dir)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sequences_and_masks(spark, odd):
    folder = scratch(spark, "sequences")
    shards = token_file.write_sequences(odd.unionByName(odd.where("doc_id < 5")), public_tokenizers.path("byte_bpe_50k.json"), folder, length=8, batch=3)
    back = token_file.read_documents(shards, folder).orderBy("start").collect()
    assert [r.doc_id for r in back] == sorted([i for i, _ in ODD] + [1, 2, 3, 4])
    assert back[0].n_tokens == 1 and all(a.start + a.n_tokens == b.start for a, b in zip(back, back[1:]))
    total = 0
    for s in shards.collect():
        reader, left = token_file.ShardReader(folder, s.shard), s.n_tokens
        k = 0
        while left > 0:
            ids, mask = reader.sequence(k)
            assert len(ids) == 8 and mask.to_pylist() == [j < left for j in range(8)]
            assert ids.to_numpy()[: min(8, left)].tolist() == reader.tokens(8 * k, min(8, left)).tolist()
            left, k, total = left - 8, k + 1, total + min(8, left)
    assert total == sum(r.n_tokens for r in back)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    folder = scratch(spark, "sequences")
    assert token_file.read_documents(token_file.write_sequences(none, public_tokenizers.path("byte_bpe_50k.json"), folder), folder).count() == 0
    assert bpe.round_trip(none, *queries.rank_file()).count() == 0
    assert secret_scan.find_secrets(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert mixing.mix(none, F.lit("d"), {k: F.lit(1) for k in mixing.LEVELS}).count() == 0


# --- secrets ---

GITHUB = "ghp_" + "a1B2" * 7 + "xy"


def with_checksum(body):
    n, digits = zlib.crc32(body[4:].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = secret_scan.BASE62.decode()[d] + digits
    return body + digits


def plain_scan(text):
    """The base spans by the whole expressions over the whole text."""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_scan_is_plain_scan():
    rng = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "abcdef", "x.y-z/=", "AKIA", "AKIA" + "Q1" * 8, "0a1b2c3d" * 3, "deadbeef", "é", "ſ", "K", "\n", "漢", "ghp_"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert [s for s in secret_scan.scan(text) if s[0] in ("assign", "access", "hex")] == plain_scan(text)


def test_checksums():
    good = with_checksum(GITHUB)
    assert secret_scan.scan(f"é {good} x") == [("github", 2, 42)]
    assert secret_scan.scan(f"{good[:-1]}{'0' if good[-1] != '0' else '1'}") == []
    assert secret_scan.scan(with_checksum("npm_" + "Zz" * 15))[0][0] == "npm"


def test_secret_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_secret_scan(spark, sf_dir).collect()}
    found = 0
    for i, t in docs_of(spark, sf_dir):
        base = plain_scan(t)
        found += len(base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert found


def test_secrets_of_odd_texts(odd):
    assert {r.doc_id: r.spans for r in secret_scan.find_secrets(odd).collect()} == {i: [] for i, _ in ODD}


# --- exact dedup ---


def plain_groups(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return sorted((i, min(ids), len(ids)) for ids in texts.values() for i in ids)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.unhex(F.lit("00"))])
def test_weak_digests_change_nothing(spark, sf_dir, digest):
    rows = docs_of(spark, sf_dir)[:90] + [(1000 + i, t) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))
    got = exact_dedup.exact_groups(df, digest=digest).collect()
    assert sorted((r.id, r.keep_id, r.group_size) for r in got) == plain_groups(rows)
    assert all(r.kept == (r.id == r.keep_id) for r in got)


def test_repeated_rows_keep_one(spark):
    path = scratch(spark, "docs")
    rows = [(5, "a  b", 1), (5, "a b", 2), (3, "a\tb", 3), (None, "c", 4), (7, "c", 5), (8, None, 6), (9, "", 7), (9, "", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, __file int").write.parquet(path)
    kept = exact_dedup.drop_copies(spark.read.parquet(path)).collect()
    assert sorted(r[2] for r in kept) == [3, 4, 6] and len(kept[0]) == 3


def test_copies_of_any_table(spark):
    rows = [(5, "a", 1), (3, "a", 2), (None, None, 3), (7, "", 4), (8, "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _metadata int").withColumn("file", F.lit(1)).withColumn("row", F.lit(2)).withColumn("doc", F.lit(3))
    path = scratch(spark, "docs")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    for docs in (df, stored, stored.where("doc_id IS NULL OR doc_id > 0"), stored.unionByName(stored.limit(0)), stored.orderBy("doc_id").limit(100)):
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == df.columns and sorted(r["_metadata"] for r in kept.collect()) == [2, 3, 5]
        assert exact_dedup.exact_groups(docs, from_files=True).where("kept").count() == 3
    assert exact_dedup.drop_copies(df.where("false")).count() == 0


def test_a_stream_goes_on(spark):
    rows, out, state = scratch(spark, "rows"), scratch(spark, "groups"), scratch(spark, "state")
    put = lambda *r: spark.createDataFrame([(i, 1, i, bytes([d])) for i, d in r], "id long, file long, row long, digest binary").write.mode("append").parquet(rows)
    put((5, 1), (6, 1), (7, 2))
    schema = spark.read.parquet(rows).schema
    exact_dedup.start_stream(spark.readStream.schema(schema).parquet(rows), state, out).awaitTermination()
    put((2, 1), (9, 2), (4, 3))
    exact_dedup.start_stream(spark.readStream.schema(schema).parquet(rows), state, out).awaitTermination()
    got = {r.digest[0]: (r.keep.id, r.n) for r in exact_dedup.latest_groups(spark, out, "bigint").collect()}
    assert got == {1: (2, 3), 2: (7, 2), 3: (4, 1)}


# --- mixing ---


def fill(budget, nodes):
    """(weight, capacity) of siblings: shares by repeated dealing, as fractions."""
    share, open_ = [0.0] * len(nodes), set(range(len(nodes)))
    budget = min(budget, sum(c for _, c in nodes))
    while budget > 1e-9 and open_:
        w = sum(nodes[i][0] for i in open_)
        part = {i: budget * nodes[i][0] / w for i in open_}
        full = {i for i in open_ if share[i] + part[i] >= nodes[i][1]}
        for i in open_ if not full else full:
            add = part[i] if not full else nodes[i][1] - share[i]
            share[i] += add
            budget -= add
        if not full:
            break
        open_ -= full
    return share


def test_budgets_are_dealt(spark):
    rng = random.Random(4)
    leaves = [(f"d{a}", f"l{b}", f"s{c}", rng.randrange(1, 5000)) for a in range(3) for b in range(3) for c in range(4)]
    df = spark.createDataFrame([*leaves, (None, None, "s", 10)], "domain string, lang string, source string, tokens long")
    weights = {"domain": F.expr("CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 2 END"), "lang": F.expr("1 + CAST(substring(lang, 2) AS INT)"), "source": F.lit(1)}
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, (7, 10), weights, 2).collect()}
    total = (sum(x[3] for x in leaves) + 10) * 7 // 10
    assert sum(got.values()) == total
    tops = ["d0", "d1", "d2", None]
    cap = {d: sum(2 * x[3] for x in leaves if x[0] == d) for d in tops[:3]} | {None: 20}
    for d, want in zip(tops, fill(total, [(5, cap["d0"]), (2, cap["d1"]), (1, cap["d2"]), (1, 20)])):
        assert abs(sum(v for k, v in got.items() if k[0] == d) - want) < 5
    assert all(0 <= got[x[:3]] <= 2 * x[3] for x in leaves)


def test_mix_takes_its_budget(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "s1", None])) for i in range(600)] + [(600, None, "en", "s1"), (601, " ", "en", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("epoch", F.lit(9)).withColumn("__key", F.lit("clash"))
    weights = {k: F.lit(1) for k in mixing.LEVELS}
    got = mixing.mix(df, F.lit("d"), weights, (6, 10)).collect()
    tokens = {i: len((t or "").split()) for i, t, *_ in rows}
    assert sum(r.take_tokens for r in got) == sum(tokens.values()) * 6 // 10
    assert all(0 < r.take_tokens <= r.n_tokens == tokens[r.id] for r in got) and len({(r.id, r.epoch) for r in got}) == len(got)
    whole = mixing.mix_documents(df, F.lit("d"), weights, (6, 10))
    assert whole.columns == df.columns
    some, more = sorted(r.doc_id for r in whole.collect()), sorted(r.id for r in got)
    assert set(some) <= set(more) and len(more) - 7 <= len(some) <= len(more)


# --- URL filter ---


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x"), (4, "http://example.net"), (5, "http://notnet/"), (6, "http://x.net/"), (7, "http://www.listed.com/p/?utm_a=1"), (8, "https://listed.com/p.html#t"), (9, "http://listed.com/q"), (9, "http://listed.com/q"), (10, "http://b.org/fr/?://c.net/"), (11, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("http://listed.com/p/",), ("http://listed.com/p",), (None,)], "url string")
    got = [tuple(r) for r in url_filter.filter_urls(pages, listed, queries.URL_RULES).orderBy("page_id").collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "", None, "allow"), (5, "notnet", "/", None, "allow"),
        (6, "x.net", "/", "net/", "block"), (7, "www.listed.com", "/p/", None, "block"), (8, "listed.com", "/p.html", None, "block"), (9, "listed.com", "/q", None, "allow"), (9, "listed.com", "/q", None, "allow"),
        (10, "b.org", "/fr/", "org/fr/", "allow"), (11, "", "", None, "allow"),
    ]
    assert {r.verdict for r in url_filter.filter_urls(pages, listed.where("false"), []).collect()} == {"allow"}


def test_bloom_blocks_pass_all_listed(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    blocks = url_filter.bloom_blocks(keys, "k", 141).collect()
    assert len(blocks) <= 141
    some = spark.range(200_000, 220_000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("page_id"))
    listed = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    assert url_filter.filter_urls(some, listed, []).where("verdict = 'block'").count() == 0
    assert url_filter.filter_urls(listed.withColumn("page_id", F.lit(1)), listed, []).where("verdict = 'allow'").count() == 0


def test_reads_that_repeat_rows(spark):
    """Locators of files aren't those of rows where a read is exploded, joined, united with itself or sampled with replacement."""
    path = scratch(spark, "lists")
    spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["d"])], "doc_id long, texts array<string>").coalesce(1).write.parquet(path)
    read = spark.read.parquet(path)
    exploded = read.select("doc_id", F.explode("texts").alias("text"))
    other = spark.createDataFrame([("x",), ("y",)], "text string")
    flat = read.select("doc_id", F.col("texts")[0].alias("text"))
    cases = {
        "explode": (exploded, [(1, "a"), (1, "b"), (2, "c"), (3, "d")]),
        "join": (read.select("doc_id").crossJoin(other), [(1, "x"), (1, "y")]),
        "union": (flat.unionByName(flat), [(1, "a"), (2, "b"), (3, "d")]),
        "filter": (flat.where("doc_id > 1"), [(2, "b"), (3, "d")]),
    }
    for name, (docs, want) in cases.items():
        assert sorted(tuple(r) for r in exact_dedup.drop_copies(docs).collect()) == want, name
        groups = exact_dedup.exact_groups(docs, from_files=True)
        assert groups.count() == docs.count() and groups.where("kept").count() == len(want), name
    many = flat.sample(True, 5.0, 1)
    assert sorted(tuple(r) for r in exact_dedup.drop_copies(many).collect()) == sorted({tuple(r) for r in many.collect()})
