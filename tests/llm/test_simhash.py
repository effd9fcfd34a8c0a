import random

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siteaudit.llm import simhash
from siteaudit.llm.components import components
from siteaudit.llm.queries import op4_simhash

SPACES = " \t\n\v\f\r"


def words_of(text):
    """The contract, letter by letter."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low:
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def grams(text, k):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)


def plain_print(text, k=3):
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def closure(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            for x in (a, b):
                if root[x] != m:
                    root[x], changed = m, True
    return root


def brute(rows, k=3, radius=2):
    prints = {i: plain_print(t, k) for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (prints[a] ^ prints[b]).bit_count() <= radius]
    root = closure(ids, linked)
    return {(i, f"{prints[i]:016x}", root[i]) for i in ids}


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op4_simhash(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {tuple(r) for r in got} == brute([tuple(r) for r in docs])


def test_odd_rows(spark):
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(400) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b"), (7, "É a\x1cb c d"), (8, "x " * 50_000), (9, " ".join(base)), (10, " ".join(base) + " "), (11, " ".join(base).upper())]
    for i in range(40):  # a group of near copies
        own = list(base)
        own[rng.randrange(120)] = "other%d" % i
        rows.append((20 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(0))
    got = simhash.near_duplicates(df, 3, 2).select("id", simhash.hex_print(F.col("fp")), "component").collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_small_tiles_and_repeated_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(120)
    prints = simhash.fingerprints(df, 3, "id").select("id", "fp").groupBy("fp").agg(F.min("id").alias("first"))
    links = {(r.a, r.b) for r in simhash.print_links(prints, 6, tile=4).collect()}
    fps = [r.fp for r in prints.collect()]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 6]
    assert closure(fps, links) == closure(fps, near)
    twice = df.unionByName(df)
    assert simhash.near_duplicates(twice, id_col="id").count() == 240


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.similar_documents(none).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(200, 500)] + [(7, 7), (8, 9), (9, 8)]
    df = spark.createDataFrame(chain + hub, "a long, b long")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(200, 500)]} | {8: 8, 9: 8}
    assert got == want


def plain_similar(rows, k=5, least=0.8):
    sets = {i: set(grams(t, k)) for i, t in rows}
    ids = sorted(sets)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1
    return closure(ids, [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if share(sets[a], sets[b]) >= least])


def test_similar_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.keep_id for r in simhash.similar_documents(df, first=64, radius=128, tile=64).collect()}
    want = plain_similar(rows)
    assert got == want  # with the widest radius nothing is missed
    usual = {r.id: r.keep_id for r in simhash.similar_documents(df).collect()}
    copies = [i for i in want if want[i] != i]
    assert sum(usual[i] != i for i in copies) >= 0.95 * len(copies)
    assert all(usual[i] == i for i in want if want[i] == i)


def test_no_similar_pair_is_missed(spark):
    """All pairs of sf0.1 at 0.8 or more, found by an index of all shingles, and pairs of short texts at just 0.8."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    rng, least = random.Random(12), 1_000_000
    for k in range(400):  # 4 of 5 shingles, 12 of 15 and so on
        words = ["v%d" % rng.randrange(10**9) for _ in range(9 + 5 * (k % 8))]
        rows += [(least + 2 * k, " ".join(words)), (least + 2 * k + 1, " ".join(words[: len(words) - (len(words) - 4) // 5]))]
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(grams(t, 5)), []).append(i)
    sets = [(s, min(ids)) for s, ids in sets.items()]
    index, pairs = {}, []
    for a, (s, _) in enumerate(sets):
        shared = {}
        for g in s:
            for b in index.get(g, ()):
                shared[b] = shared.get(b, 0) + 1
            index.setdefault(g, []).append(a)
        pairs += [(sets[a][1], sets[b][1]) for b, n in shared.items() if n >= 0.8 * (len(s) + len(sets[b][0]) - n) - 1e-9]
    got = {r.id: r.keep_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = [p for p in pairs if min(p) >= least]
    assert len(short) >= 400 and len(pairs) - len(short) > 40
    assert all(got[a] == got[b] for a, b in pairs if min(a, b) < least)
    assert sum(got[a] != got[b] for a, b in short) <= 2
    root = closure([i for _, i in sets], pairs)
    assert all(got[i] >= root[i] for i in root)  # nothing else is linked


def test_a_repeated_passage(spark):
    rng = random.Random(11)
    base, line = (" ".join("w%d" % rng.randrange(5000) for _ in range(n)) for n in (200, 9))
    rows = [(i, " ".join([base] + [line] * n)) for i, n in enumerate((1, 10, 20, 200))] + [(9, " ".join([line] * 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.keep_id for r in simhash.similar_documents(df).collect()}
    assert got == plain_similar(rows) == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_drop_similar_keeps_columns(spark):
    text = " ".join("w%d" % i for i in range(60))
    rows = [(3, text, 1), (4, text + " end", 2), (5, None, 3), (6, "", 4), (None, "lone", 5), (8, text.upper(), 6), (9, "quite another text", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    kept = simhash.drop_similar(df.withColumnRenamed("__gone", "n")).collect()
    assert sorted(r.n for r in kept) == [1, 3, 5, 7]


def test_text_identifiers(spark):
    a, b = (" ".join("%s%d" % (x, i) for i in range(60)) for x in "ab")
    df = spark.createDataFrame([("x", a), ("c", a + " end"), ("d", b), (None, b), ("e", None), ("f", "")], "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in simhash.drop_similar(df).collect()) == ["", "c", "d", "e"]
    got = simhash.near_duplicates(df.where("doc_id IS NOT NULL")).collect()
    assert {r.id: r.component for r in got if r.id in "def"} == {"d": "d", "e": "e", "f": "e"}


def test_repeated_ids_with_other_texts(spark):
    a, b, c = (" ".join("%s%d" % (x, i) for i in range(60)) for x in "abc")
    rows = [(3, b, 1), (5, a, 2), (5, b + " end", 3), (5, c, 4), (7, c + " end", 5), (8, a + " end", 6), (8, b, 7), (9, a.upper(), 8), (None, b, 9), (5, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert sorted(r.n for r in simhash.drop_similar(df).collect()) == [1, 2, 4, 9, 10]
    got = simhash.similar_documents(df).collect()
    assert sorted((r.id, r.keep_id) for r in got if r.id) == sorted([(3, 3), (5, 5), (5, 3), (5, 5), (7, 5), (8, 5), (8, 3), (9, 5), (5, 5)])


def test_similar_links_keep_what_is_connected():
    """Groups of up to hundreds, pairs that share a passage with them, chains and empty sets, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 2**63, n, np.uint64)
    for _ in range(10):
        base = fresh(40)
        sets = [np.unique(np.concatenate([base[k:], fresh(k)])) for k in rng.integers(0, 6, rng.integers(1, 200))]
        chain = fresh(100)
        sets += [np.unique(chain[k : k + 40]) for k in range(0, 60, 4)]  # each is similar to the next one only
        for _ in range(30):
            own = np.concatenate([base[:15], fresh(25)])
            sets += [np.unique(own), np.unique(np.concatenate([own[2:], fresh(1)]))]
        sets += [np.array([], np.uint64)] * int(rng.integers(0, 3))
        order = rng.permutation(len(sets))
        sets = [sets[i] for i in order]
        plain = [set(s.tolist()) for s in sets]
        alike = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
        every = [(i, j) for i in range(len(sets)) for j in range(i) if alike(plain[i], plain[j])]

        def roots(links):
            root = list(range(len(sets)))
            for _ in range(len(sets)):
                before = list(root)
                for i, j in links:
                    root[i] = root[j] = min(root[i], root[j])
                if root == before:
                    return root

        found = simhash.similar_links(np.arange(len(sets)), sets, 0.8)
        assert all(alike(plain[i], plain[j]) for i, j in found)
        assert roots(found) == roots(every)
        assert len(found) == len(sets) - len(set(roots(every)))
