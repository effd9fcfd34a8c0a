"""Mixing sources to target weights by hierarchical budgets (operator 8). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.llm.common import SPACES, cut, small, text_of

#: Hex digits of the order key that name a bucket: 4096 buckets for each leaf.
DIGITS = 3
LEVELS = ["domain", "lang", "source"]


def word_count(text: Column) -> Column:
    """Words between white space, as long."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _share(nodes: DataFrame, parent: list[str], own: str, parent_budget: str, weight: str) -> DataFrame:
    """Deal parent_budget among siblings by weight, none above its capacity `cap`: adds budget.

    In the order of capacity per weight, siblings whose capacity lies under their share are filled; what they
    leave is dealt among the others. Whole tokens throughout: results don't depend on the order of sums.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col(weight).cast("double"), own) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("cap").cast("double") / F.col(weight).cast("double"), own)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    big = lambda c: c.cast("decimal(18,0)")
    out = nodes.withColumn("__before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("__from_here", F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing)))
    fills = big(F.col("cap")) * big(F.col("__from_here")) <= big(F.col(weight)) * big(F.col(parent_budget) - F.col("__before"))
    out = out.withColumn("__fills", F.min(fills.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    out = out.withColumn("__left", F.col(parent_budget) - F.sum(F.when(F.col("__fills"), F.col("cap")).otherwise(0)).over(whole))
    open_weight = F.when(F.col("__fills"), F.lit(0)).otherwise(F.col(weight))
    out = out.withColumn("__open", F.sum(open_weight).over(whole)).withColumn("__upto", F.sum(open_weight).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto, left = big(F.col("__upto")), big(F.col("__left"))
    part = F.call_function("div", upto * left, big(F.col("__open"))) - F.call_function("div", (upto - big(F.col(weight))) * left, big(F.col("__open")))
    out = out.withColumn("budget", F.when(F.col("__fills"), F.col("cap")).otherwise(part).cast("long"))
    return out.drop("__before", "__from_here", "__fills", "__left", "__open", "__upto")


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds budget.

    A budget goes down the tree. A node never gets more than its leaves can give in max_epochs, so a leaf's
    shortage goes to its siblings first and leaves their parent only when they are full too. The root's
    budget is share (a numerator and a denominator) of all tokens.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for level in LEVELS:
        caps = caps.withColumn(f"w_{level}", F.greatest(F.lit(1), F.coalesce(weights[level], F.lit(1))).cast("long"))
    above = None
    for i, level in enumerate(LEVELS):
        parent, keys = LEVELS[:i], LEVELS[: i + 1]
        nodes = caps.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("w"), F.sum("tokens").alias("tokens"))
        if above is None:
            every = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumn("up", F.call_function("div", F.sum("tokens").over(every) * share[0], F.lit(share[1])))
        else:
            nodes = nodes.join(above.select(*[F.col(k).alias(f"__{k}") for k in parent], F.col("budget").alias("up")), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in parent]).drop(*[f"__{k}" for k in parent])
        nodes = nodes.withColumn("up", F.least("up", F.sum("cap").over(Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0)))))
        above = _share(nodes, parent, level, "up", "w").select(*keys, "tokens", "budget")
    return above


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in its leaf's order of one epoch: an MD5 of seed, epoch and identifier."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan_mix(rows: DataFrame, share: tuple[int, int], weights: dict[str, Column], max_epochs: int, seed: int) -> DataFrame:
    """rows: id, domain, lang, source, n_tokens. One row for each leaf: full (whole epochs), last_key, last_take and last_whole.

    A leaf gives full whole epochs, and of the next epoch's order the documents up to last_key, of the last of
    them last_take tokens (half of it or more: last_whole). The cut is found in buckets of the order key: sums of buckets first, then only the
    bucket with the cut is sorted; no task gets a whole leaf.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    budgets = leaf_budgets(leaves, share, weights, max_epochs).withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    budgets = cut(budgets, "budgets")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in LEVELS]
    lone = F.broadcast(budgets) if budgets.count() <= 100_000 else budgets
    keyed = rows.join(lone, same(rows, budgets)).select(*[rows[k] for k in LEVELS], "n_tokens", "full", "rest", order_key(seed, F.col("full"), F.col("id")).alias("key"))
    keyed = keyed.where("rest > 0").withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("end", F.sum("n").over(upto)).where("end >= rest AND end - n < rest").select(*LEVELS, F.col("bucket").alias("at"), (F.col("end") - F.col("n")).alias("before"))
    at = cut(at, "cuts")
    lone = F.broadcast(at) if at.count() <= 100_000 else at
    inside = keyed.join(lone, [*same(keyed, at), keyed["bucket"] == at["at"]]).select(*[keyed[k] for k in LEVELS], "rest", "key", "n_tokens", "before")
    units = inside.groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = units.withColumn("end", F.col("before") + F.sum("n").over(upto)).where("end >= rest AND end - n < rest")
    take = F.col("rest") - F.col("end") + F.col("n")
    last = last.select(*[F.col(k).alias(f"__{k}") for k in LEVELS], F.col("key").alias("last_key"), take.alias("last_take"), (2 * take >= F.col("n")).alias("last_whole"))
    plan = budgets.join(last, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in LEVELS], "left")
    return plan.select(*LEVELS, "tokens", "budget", "full", "last_key", "last_take", "last_whole")


def token_rows(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, domain, lang, source, n_tokens of each row, written: texts are read once. Tokens are words between white space; a null text has none."""
    named = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("n_tokens"))
    return cut(named, "tokens")


def _copies(df: DataFrame, plan: DataFrame, id_col: str, leaf: list[Column], seed: int, rounded: bool = False) -> DataFrame:
    """df with __copies, the plan's columns as __full, __last_key, __last_take, and __key. rounded: a leaf's last document counts only if half of it is taken."""
    plan = plan.select(*[F.col(k).alias(f"__{k}") for k in LEVELS], *[F.col(c).alias(f"__{c}") for c in ("full", "last_key", "last_take", "last_whole")])
    plan = small(plan, plan.count(), 100_000)
    out = df.join(plan, [c.eqNullSafe(plan[f"__{k}"]) for c, k in zip(leaf, LEVELS)])
    out = out.withColumn("__key", order_key(seed, F.col("__full"), F.col(id_col)))
    last = (F.col("__key") == F.col("__last_key")) & (F.col("__last_whole") if rounded else F.lit(True))
    more = F.coalesce((F.col("__key") < F.col("__last_key")) | last, F.lit(False)).cast("int")
    return out.withColumn("__copies", (F.col("__full") + more).cast("int"))


def selected(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """A row for each document and epoch in which it is selected: id, domain, lang, source, n_tokens, epoch, take_tokens."""
    out = _copies(rows.where("n_tokens > 0"), plan, "id", [F.col(k) for k in LEVELS], seed)
    out = out.where("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    cut_here = (F.col("epoch") == F.col("__full")) & (F.col("__key") == F.col("__last_key"))
    take = F.when(cut_here, F.least("n_tokens", "__last_take")).otherwise(F.col("n_tokens"))
    return out.select("id", *LEVELS, "n_tokens", "epoch", take.alias("take_tokens"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], share: tuple[int, int] = (6, 10), max_epochs: int = 2, seed: int = 7, **cols: str) -> DataFrame:
    """What selected() returns for docs. Weights: an expression for each of domain, lang and source, in positive whole numbers.

    Null domains, languages and sources are nodes of their own; a missing or non-positive weight counts as 1.
    Documents without words are never selected; an empty table gives no rows. Rows of one leaf with the
    same identifier stand or fall together and are cut at the same length. Other columns of docs play no part. Budgets
    are dealt in one task for each parent: domains, and a node's children, are taken to be tens or thousands, not millions.
    """
    rows = token_rows(docs, domain, **cols)
    return selected(rows, cut(plan_mix(rows, share, weights, max_epochs, seed), "mix"), seed)


def mix_documents(docs: DataFrame, domain: Column, weights: dict[str, Column], share: tuple[int, int] = (6, 10), max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The selected rows of docs with their own columns, once for each epoch; the last one of a leaf is kept whole if half of it or more is taken, else not at all. No shuffle of texts.

    Nulls, repeated identifiers and weights are taken as mix() takes them: rows of one leaf with the same identifier
    stay or go together. Rows without words, null texts among them, go; an empty table stays empty. All columns stay as they are.
    """
    rows = token_rows(docs, domain, id_col, text_col, lang_col, source_col)
    plan = cut(plan_mix(rows, share, weights, max_epochs, seed), "mix")
    # a row travels as one value, so that no name of its own can clash
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_of(text_col).rlike("[^\\x20\\x09-\\x0D]").alias("worded"))
    out = _copies(rows.where("worded"), plan, "id", [F.col(k) for k in LEVELS], seed, rounded=True).where("__copies > 0")
    return out.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).select("doc.*")
