"""The operators' registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteaudit.llm import ann, bpe, divergence, exact_dedup, merkle, mixing, quality, secret_scan, simhash, substring, token_file, toxicity, url_filter
from siteaudit.llm.common import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> tuple[str, str]:
    """The local rank file and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, by a model fitted on a bounded sample of labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.rate(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their importance weight and whether they are in the sample, whose share is that of good labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.resample(docs, quality.train(docs, labels), quality.good_share(labels))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as Arrow files of token sequences in the shared folder, and read back from them."""
    import public_tokenizers

    folder = scratch(spark, "sequences")
    shards = token_file.write_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_file.read_documents(shards, folder)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint of 3-word shingles and component at a radius of 2 bits."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return near.select(F.col("id").alias("doc_id"), simhash.hex_print(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents. base_sha256 covers the three base kinds, spans all kinds."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of each group of equal texts."""
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), from_files=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


_OP6_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""

#: The domain of a source: the remainder of its number by three.
MIX_DOMAIN = "concat('domain', CAST(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3 AS STRING))"
MIX_WEIGHTS = {"domain": "CASE domain WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 ELSE 2 END", "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 ELSE 2 END", "source": "1"}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (6, 10), 2, 7


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tenths of all tokens, dealt by the weights above, in at most two epochs."""
    weights = {k: F.expr(v) for k, v in MIX_WEIGHTS.items()}
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(MIX_DOMAIN), weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED).withColumnRenamed("id", "doc_id")


def _deal_sql(level: int) -> str:
    """CTEs that deal the budget of one level's parents among its nodes."""
    keys = ["domain", "lang", "source"][: level + 1]
    k, parent = ", ".join(keys), ", ".join(keys[:-1])
    part = f"PARTITION BY {parent}" if parent else ""
    up = f"JOIN b{level - 1} u USING ({parent})" if parent else "CROSS JOIN root u"
    order = f"{part} ORDER BY cap::DOUBLE / w::DOUBLE, {keys[-1]}"
    return f"""
n{level} AS (SELECT {k}, sum(cap)::HUGEINT AS cap, max(w_{keys[-1]})::HUGEINT AS w FROM leaf GROUP BY {k}),
s{level} AS (SELECT n.*, least(u.budget, sum(cap) OVER ({part})) AS up FROM n{level} n {up}),
f{level} AS (SELECT *, cap * sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= w * (up - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS ok FROM s{level}),
g{level} AS (SELECT *, bool_and(ok) OVER ({order} ROWS UNBOUNDED PRECEDING) AS fills FROM f{level}),
h{level} AS (SELECT *, up - sum(CASE WHEN fills THEN cap ELSE 0 END) OVER ({part}) AS rem, sum(CASE WHEN fills THEN 0 ELSE w END) OVER ({part}) AS open,
  sum(CASE WHEN fills THEN 0 ELSE w END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM g{level}),
b{level} AS (SELECT {k}, CASE WHEN fills THEN cap ELSE (upto * rem) // open - ((upto - w) * rem) // open END AS budget FROM h{level}),"""


_OP8_SQL = f"""
WITH named AS (SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3) AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MIX_EPOCHS} AS cap,
  {MIX_WEIGHTS["domain"]} AS w_domain, {MIX_WEIGHTS["lang"]} AS w_lang, {MIX_WEIGHTS["source"]} AS w_source
  FROM named GROUP BY domain, lang, source HAVING sum(n_tokens) > 0),
root AS (SELECT (sum(tokens) * {MIX_SHARE[0]})::HUGEINT // {MIX_SHARE[1]} AS budget FROM leaf),
{_deal_sql(0)}{_deal_sql(1)}{_deal_sql(2)}
plan AS (SELECT domain, lang, source, budget // tokens AS full_epochs, budget % tokens AS rest FROM b2 JOIN leaf USING (domain, lang, source)),
keyed AS (SELECT n.*, full_epochs, rest, md5('{MIX_SEED}:' || full_epochs || ':' || doc_id) AS key FROM named n JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM keyed),
copies AS (SELECT *, least(n_tokens, greatest(0, rest - (upto - n_tokens))) AS more FROM placed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, epoch::INT AS epoch,
  (CASE WHEN epoch = full_epochs THEN more ELSE n_tokens END)::BIGINT AS take_tokens
FROM (SELECT *, unnest(range(0, (full_epochs + CASE WHEN more > 0 THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM copies)
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the rank file and decoded again."""
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), *rank_file())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: (verdict, host, path prefix)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged. Listed are the canonical URLs of pages that were reached through a campaign link (utm_ parameters)."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, pages.where(F.col("url").contains("utm_")), URL_RULES)


_HOST = "coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
_OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, url, {_HOST} AS host, {_PATH} AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
keyed AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') || CASE WHEN length(query) > 0 THEN '?' || query ELSE '' END AS key
  FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE contains(url, 'utm_') AND key <> ''),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN ruled.key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that a document with a smaller identifier has."""
    kept = substring.drop_repeats(table(spark, sf_dir, "documents"), 13, shown=lambda text: F.sha2(text.cast("binary"), 256))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


_OP11_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS k FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT k, min(doc_id) AS m FROM win WHERE n = 13 GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN firsts USING (k) WHERE n = 13 AND m < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all sources of a language differ from each other and from it, by their terms."""
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


_OP12_SQL = """
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
langs AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS s FROM cells GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(s.s, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.total + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN cells c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose identifier has a CRC-32 divisible by five are tampered with: their text in small letters."""
    small_letters = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=changed, changes={"text": small_letters}).withColumnRenamed("id", "doc_id")


#: Levels that the SQL climbs in a source, and from the sources to the root: enough for 16^5 leaves.
_SQL_LEVELS = 5


def _climb_sql(name: str, leaves: str) -> str:
    """CTEs name0 (leaves: tree, i, h) to name5: the nodes of each level; a tree of one node stays as it is and lets level alone."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(1, _SQL_LEVELS + 1):
        below = f"{name}{k - 1}"
        out.append(f"""{name}{k} AS (SELECT tree, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {below}) GROUP BY tree, i // 16)""")
    return ",\n".join(out)


def _fold_sql(name: str, frm: str, nodes: str) -> str:
    """CTEs name1 to name5: at each level the hash that a leaf's path has reached (f), its place in it, and the siblings so far (proof)."""
    out, before = [], frm
    for k in range(_SQL_LEVELS):
        own = "list_filter(run, lambda x: x.i <> place)"
        out.append(f"""{name}{k + 1} AS (SELECT p.* EXCLUDE (f, place, proof), place // 16 AS place,
  CASE WHEN n > 1 THEN sha256(array_to_string(list_transform(run, lambda x: CASE WHEN x.i = place THEN f ELSE x.h END), '')) ELSE f END AS f,
  proof || array_to_string(list_transform({own}, lambda x: x.h), '') AS proof
  FROM {before} p JOIN (SELECT tree, i // 16 AS j, list({{'i': i, 'h': h}} ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}{k}) GROUP BY tree, i // 16) r ON r.tree = p.tree AND r.j = p.place // 16)""")
        before = f"{name}{k + 1}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# CRC-32 bit by bit: a list of the start value, each byte, and eight steps after each
_CRC_SQL = "xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
_OP13_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC_SQL} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows),
{_climb_sql("a", "SELECT tree, i, leaf AS h FROM leaves")},
tops AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM a{_SQL_LEVELS}),
{_climb_sql("b", "SELECT 0 AS tree, i, subroot AS h FROM tops")},
begin AS (SELECT doc_id, leaf, tree, i AS place, coalesce(other, leaf) AS f, '' AS proof FROM leaves),
{_fold_sql("c", "begin", "a")},
over AS (SELECT doc_id, leaf, subroot, 0 AS tree, t.i AS place, f, proof FROM c{_SQL_LEVELS} c JOIN tops t ON t.tree = c.tree),
{_fold_sql("d", "over", "b")}
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b.h AS verified FROM d{_SQL_LEVELS} JOIN b{_SQL_LEVELS} b ON true
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_token_file": op3_token_file,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ann": op7_ann,
    "op8_mixing": op8_mixing,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_url_filter": op10_url_filter,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_divergence": op12_divergence,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": _OP6_SQL, "op8_mixing": _OP8_SQL, "op10_url_filter": _OP10_SQL, "op11_substring_dedup": _OP11_SQL, "op12_divergence": _OP12_SQL, "op13_merkle": _OP13_SQL}
