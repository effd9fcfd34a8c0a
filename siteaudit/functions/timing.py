"""Durations, cache ages and retry delays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of a unit.
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: Column) -> Column:
    """A number and a unit (ms s m h d w) in milliseconds; null for anything else."""
    unit = F.regexp_extract(text, "^\\s*([0-9]+)\\s*(ms|s|m|h|d|w)\\s*$", 2)
    units = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    return F.regexp_extract(text, "^\\s*([0-9]+)\\s*(ms|s|m|h|d|w)\\s*$", 1).try_cast("long") * F.try_element_at(units, unit)


def latency_ms(nanoseconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return F.call_function("div", nanoseconds, F.lit(1_000_000)).cast("long")


def retry_backoff(initial_ms: Column, factor: Column, cap_ms: Column, n: Column) -> Column:
    """Delay before the n-th retry: the initial one, then factor times the one before; the cap holds from the second on."""
    cap = F.coalesce(cap_ms.cast("double"), F.lit(float("inf")))
    steps = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, initial_ms.cast("double"), lambda d, _: F.least(d * factor, cap))


def backoff_schedule(initial_ms: Column, factor: Column, cap_ms: Column, count: Column) -> Column:
    """An array of the delays before retries 1 to count."""
    retries = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(retries, lambda n: retry_backoff(initial_ms, factor, cap_ms, n))


def freshness(fetched_at: Column, now: Column, max_age_ms: Column, swr_ms: Column) -> Column:
    """fresh up to the maximum age, stale while revalidation may wait, expired after."""
    age = F.timestamp_diff("MILLISECOND", fetched_at, now)
    return F.when(age <= max_age_ms, "fresh").when(age <= max_age_ms + swr_ms, "stale").otherwise("expired")
