"""Robots globs, content of parts that mingle and wildcard names, against brute force and in time."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from siteaudit.operators import markup, robots
from siteaudit.sources import scratch


def glob_regex(pattern):
    closed = pattern.endswith("$")
    body = pattern[:-1] if closed else pattern
    return "(?s)" + ".*".join(re.escape(p) for p in body.split("*")) + ("\\Z" if closed else "")


def test_globs_are_their_expressions(spark):
    rng = random.Random(5)
    rows = [("/" + "".join(rng.choice("ab/*$.") for _ in range(rng.randrange(7))), "/" + "".join(rng.choice("ab/.$") for _ in range(rng.randrange(9)))) for _ in range(4000)]
    rows += [("/*", "/"), ("/$", "/"), ("/$", "/a"), ("*a$", "/ba"), ("*a$", "/"), ("/a*a$", "/a"), ("/**b*$", "/ab"), ("$", "/"), ("", "/x"), ("/é*漢$", "/é🎉漢")]
    df = spark.createDataFrame(rows, "pattern string, path string")
    got = df.select("pattern", "path", robots.glob_matches(F.col("path"), robots.glob(F.col("pattern"))).alias("m")).collect()
    for r in got:
        assert r.m == bool(re.match(glob_regex(r.pattern), r.path)), r


def test_hostile_patterns_end(spark):
    rules = spark.createDataFrame([("http://h:80", i, False, "/" + "*a" * n + "*b") for i, n in enumerate((7, 30, 500))], "origin string, place int, allow boolean, pattern string")
    urls = spark.createDataFrame([("http://h/" + "a" * 100_000,), ("http://h/" + "a" * 2_000 + "b",)], "url string")
    began = time.time()
    got = {len(r.url): r.allowed for r in robots.robots_filter(urls, rules).collect()}
    assert got == {100_009: True, 2_010: False} and time.time() - began < 30


def words_of(e, n):
    """All sequences of up to n names that a content expression takes."""
    kind = e[0]
    if kind == "empty":
        return {()}
    if kind == "name":
        return {(e[1],)}
    if kind == "choice":
        return set().union(*(words_of(p, n) for p in e[1]))
    if kind == "sequence":
        return {a + b for a in words_of(e[1], n) for b in words_of(e[2], n) if len(a + b) <= n}
    if kind == "many":
        out = {()}
        own = words_of(e[1], n)
        for _ in range(n):
            out |= {a + b for a in out for b in own if len(a + b) <= n}
        return out
    out = {()}
    for p in e[1]:
        out = {m for a in out for b in words_of(p, n) if len(a + b) <= n for m in mixed(a, b)}
    return out


def mixed(a, b):
    return {a + b} if not a or not b else {a[:1] + m for m in mixed(a[1:], b)} | {b[:1] + m for m in mixed(a, b[1:])}


def test_content_against_all_sequences():
    rng = random.Random(7)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice("abcd")
        parts = [made(depth - 1) for _ in range(rng.randrange(2, 4))]
        return "(" + rng.choice((" ", " | ", " & ", " & ")).join(parts) + ")" + rng.choice(("", "", "?", "*"))

    tried = 0
    for _ in range(150):
        regex = made(2)
        taken = words_of(markup.content_of(regex), 4)
        if not taken:
            continue
        tried += 1
        shortest = min(map(len, taken))
        assert markup.content_errors(regex, []) == ([], sorted({w[0] for w in taken if len(w) == shortest and w})), regex
        for children in itertools.product("abcd", repeat=2):
            assert (markup.content_errors(regex, list(children)) == ([], [])) == (children in taken), regex
    assert tried > 100


def test_many_parts_in_time():
    names = [f"n{i}" for i in range(60)]
    regex = " & ".join(names)
    began = time.perf_counter()
    assert markup.content_errors(regex, []) == ([], sorted(names))
    assert markup.content_errors(regex, names[::-1]) == ([], [])
    assert markup.content_errors(regex, names[5:] + ["n7"]) == (["n7"], [])
    assert markup.content_errors(regex, names[5:]) == ([], sorted(names[:5]))
    assert time.perf_counter() - began < 0.5


def test_thousands_of_wildcards(spark):
    none = spark.createDataFrame([], "element string, variant int, attribute_set int, attribute string, required boolean, mode string")
    rules = {
        "elements": spark.createDataFrame([(f"x{i}-*", 0, None) for i in range(5_000)] + [("p", 0, None)], "name string, variant int, content_regex string"),
        "attributes": none,
        "values": spark.createDataFrame([], "element string, attribute string, match string, literal string"),
        "children": spark.createDataFrame([], "parent string, child string"),
    }
    rows = [("u", i, name, [], []) for i, name in enumerate(("p", "x0-a", "x4999-b", "x4999", "y-a"))]
    df = spark.createDataFrame(rows, "doc_url string, ord int, name string, attributes array<struct<name:string,value:string>>, children array<string>")
    assert sorted(r.name for r in markup.unknown_tags(df, rules).collect()) == ["x4999", "y-a"]
    no_wild = rules | {"elements": rules["elements"].where("name = 'p'")}
    assert markup.unknown_tags(df, no_wild).count() == 4


def test_broadcasts_by_real_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    narrow = spark.range(1000)
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))
    assert hinted(scratch.counted(narrow)) and not hinted(scratch.counted(wide)) and not hinted(scratch.counted(narrow, 999)) and hinted(scratch.counted(narrow.limit(0)))
