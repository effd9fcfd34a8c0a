"""Audits of request logs: retries and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteaudit.sources.scratch import cut, small


def retry_outcome(attempts: DataFrame, retry_count: int, retry_statuses: list[int]) -> DataFrame:
    """The attempt that counts for each URL: the first whose status is not retried, else the last of retry_count + 1. Errors are always retried."""
    done = F.col("status").isNotNull() & F.col("request_error").isNull() & ~F.col("status").isin(*retry_statuses) if retry_statuses else F.col("status").isNotNull() & F.col("request_error").isNull()
    within = attempts.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("attempt"))).where(F.col("__n") <= retry_count + 1)
    # the first that is done is the least number among those done, the last of all else: one aggregate
    row = F.struct(*attempts.columns)
    out = within.groupBy("url").agg(F.min_by(F.when(done, row), F.when(done, F.col("__n"))).alias("first"), F.max_by(row, "__n").alias("last"), F.max("__n").alias("tried"), F.min(F.when(done, F.col("__n"))).alias("n"))
    return out.select(F.coalesce("first", "last").alias("r"), F.coalesce("n", "tried").alias("used"), F.col("n").isNotNull().alias("settled")).select("r.*", "used", "settled")


def rate_limit_violations(log: DataFrame, supply: int | None, window: str = "1 hour", start: str = "0 seconds", overall: int | None = None) -> DataFrame:
    """site, window_start, n: fixed windows in which a site has more than supply requests; with a null site those in which all sites together have more than overall. None is no limit.

    The log is read once: the overall counts are sums of the sites' counts.
    """
    counts = log.groupBy("site", F.window("ts", window, startTime=start).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    if overall is not None:
        counts = counts.rollup("w", "site").agg(F.sum("n").alias("n"), F.grouping("site").alias("all")).where("w IS NOT NULL")
    limit = F.lit(supply).cast("long")
    limit = limit if overall is None else F.when(F.col("all") == 1, F.lit(overall).cast("long")).otherwise(limit)
    return counts.where(F.col("n") > limit).select("site", F.col("w.start").alias("window_start"), "n")


def numbered(df: DataFrame, key: str, order: list[Column], name: str, with_range: bool = False) -> DataFrame:
    """df with the number from 0 of each row within its key. Ranges of (key, order) are numbered apart and then shifted, so one key may fill many tasks. with_range: the number of a row's range stays, as __range."""
    placed = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__range", F.shiftright("__at", 33)), "ranges")
    firsts = placed.groupBy("__range", F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(firsts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnRenamed("__range", "__r"), "firsts")
    rows = placed.join(small(firsts, firsts.count()), (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__key")))
    rows = rows.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__r", "__key", "__first", "__n", "__before")
    return rows if with_range else rows.drop("__range")


def _slots(rows: DataFrame, key: str, order: list[Column], window: Column, supply: int, name: str) -> DataFrame:
    """rows with the number of the window in which a limit of supply requests a window lets each go, first come first served in its key. window: that in which a row comes.

    With tokens numbered through, a window's first being its number times the supply, the i-th row takes the token
    i + max(window supply - j) over all rows j up to it: what earlier windows have left over expires. The maximum is taken within
    ranges, then over the ranges before.
    """
    if not supply:
        return rows.withColumn(name, window)
    placed = numbered(rows.withColumn("__window", window), key, order, "__i", with_range=True)
    placed = cut(placed.withColumn("__free", F.col("__window") * supply - F.col("__i")), "placed")
    tops = placed.groupBy("__range", F.col(key).alias("__key")).agg(F.max("__free").alias("__top"))
    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut(tops.withColumn("__before", F.max("__top").over(before)).drop("__top").withColumnRenamed("__range", "__r"), "tops")
    inside = F.max("__free").over(Window.partitionBy(key, "__range").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("__inside", inside).join(small(tops, tops.count()), (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__key")))
    token = F.col("__i") + F.greatest("__inside", "__before")
    return out.withColumn(name, F.call_function("div", token, F.lit(supply))).select(*rows.columns, name)


def rate_limited_schedule(requests: DataFrame, supply: int, order: list[str], arrives: str | None = None, window: int = 3600, overall: tuple[int, int] | None = None) -> DataFrame:
    """requests with slot: the number of the window of their site in which each is sent, first come first served.

    Without arrives all are ready at once, in the given order; else arrives is the column of the time at which each comes,
    windows take window seconds from the epoch, and a request comes before those of later times. overall: a supply
    and a window in seconds of all sites together, which a request meets when its site lets it go; then there is overall_slot too.
    """
    if arrives is None:
        rows = numbered(requests, "site", [F.col(c) for c in order], "__i")
        return rows.withColumn("slot", F.call_function("div", F.col("__i"), F.lit(supply))).drop("__i")
    micros = F.unix_micros(arrives)
    at = lambda seconds: F.call_function("div", micros, F.lit(seconds * 1_000_000).cast("long"))
    first = [F.col(arrives), *[F.col(c) for c in order if c != arrives]]
    rows = _slots(requests, "site", first, at(window), supply, "slot")
    if overall is None:
        return rows
    supply_of_all, window_of_all = overall
    rows = cut(rows.withColumn("__sent", F.greatest(micros, F.col("slot") * window * 1_000_000)).withColumn("__all", F.lit(1)), "sent")
    of_all = F.call_function("div", F.col("__sent"), F.lit(window_of_all * 1_000_000).cast("long"))
    return _slots(rows, "__all", [F.col("__sent"), *first], of_all, supply_of_all, "overall_slot").drop("__sent", "__all")
