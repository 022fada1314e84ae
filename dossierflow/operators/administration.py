"""The platform's report: totals, days, profiles, failures and calls, as rows of named values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational, summaries

DAYS, MOST_PROFILES, MOST_FAILURES = 30, 20, 50  # fixed values: what a report shows
WINDOWS = {"active_1": 1, "active_7": 7, "active_30": 30}


def health(down: Column, skipped: Column) -> Column:
    """``unhealthy`` from two services down, ``healthy`` where none is down or skipped, else ``degraded``."""
    return F.when(down >= 2, "unhealthy").when((down == 0) & (skipped == 0), "healthy").otherwise("degraded")


def profile_means(analyses: DataFrame, scores: list[str]) -> DataFrame:
    """``(profile, n, <scores>, ms)``: means of two places of each score and whole ones of the time, over ``analyses (profile, ms, <scores>)``; a null profile is one."""
    return analyses.groupBy("profile").agg(F.count("*").alias("n"), *[F.round(F.avg(s), 2).alias(s) for s in scores], F.round(F.avg("ms"), 0).alias("ms"))


def platform_report(users: DataFrame, documents: DataFrame, analyses: DataFrame, events: DataFrame, scores: list[str], kinds: dict[str, str], failures: list[str], call: str, failed_call: str) -> DataFrame:
    """``(section, name, value)`` of the sections ``totals``, ``daily``, ``by_profile``, ``failures`` and ``calls``.

    ``users (suspended)``, ``documents (deleted)``, ``analyses (profile, ms,
    <scores>)``, ``events (user_id, kind, ts, tokens, ms)``. ``kinds`` names
    the kinds that are counted by day, over the 30 days up to the last event.
    Each section is an aggregate of whole tables, so what is put together is a
    few hundred rows; the report shows the 20 profiles with the most analyses
    and the 50 latest counts of failures. Means over all analyses weigh those
    of the profiles, where a null one counts as 0. A value is null where there
    is nothing to take a mean of; nothing at all gives totals of 0 and no days.
    """
    events = events.select("user_id", "kind", "ts", "tokens", "ms")
    profiles = profile_means(analyses, scores)
    means = [relational.weighted_mean(profiles, s, "n").alias(f"avg_{s}") for s in scores]
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = [
        users.agg(F.count("*").alias("users"), F.count_if("suspended").alias("suspended")), documents.agg(F.count_if(~F.coalesce("deleted", F.lit(False))).alias("documents")),
        profiles.agg(zero(F.sum("n")).alias("analyses"), *means, F.round(relational.weighted_mean(profiles, "ms", "n"), 0).alias("avg_ms")), relational.active_within(events, "user_id", "ts", WINDOWS),
    ]
    daily = relational.daily_spine(relational.daily_counts(events, "ts", {n: F.col("kind") == k for n, k in kinds.items()}), DAYS)
    failed = events.where(F.col("kind").isin(*failures)).groupBy("kind", F.to_date("ts").alias("day")).agg(F.count("*").alias("count"))
    failed = failed.orderBy(F.desc("day"), F.desc("count"), "kind").limit(MOST_FAILURES)
    shown = profiles.orderBy(F.desc("n"), F.asc_nulls_last("profile")).limit(MOST_PROFILES)
    calls = events.where(F.col("kind").isin(call, failed_call))
    used = summaries.usage(calls, [], "kind", "tokens", "ms", F.col("kind") == call).select("calls", F.col("total_tokens").alias("tokens"), "avg_ms", "error_rate")
    day = F.date_format("day", "yyyy-MM-dd")
    sections = [*[_rows("totals", t, None) for t in totals], _rows("daily", daily, day), _rows("by_profile", shown, F.coalesce("profile", F.lit("none"))), _rows("failures", failed, F.concat_ws(" ", "kind", day)), _rows("calls", used, None)]
    return reduce(lambda a, b: a.unionByName(b), sections)


def _rows(section: str, table: DataFrame, prefix: Column | None) -> DataFrame:
    """A row for each value of a table, named by its column and what tells its rows apart."""
    names = [c for c in table.columns if c not in ("day", "profile", "kind")]
    named = lambda n: F.lit(n) if prefix is None else F.concat_ws(" ", prefix, F.lit(n))
    values = F.array(*[F.struct(named(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return table.select(F.inline(values)).select(F.lit(section).alias("section"), "name", "value")
