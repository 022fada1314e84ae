"""Summaries of calls, of checks and of matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from . import matching

#: What a summary of checks says.
ALL_MET = "All stated non-negotiable requirements were found in your document."
UNMET = "%d non-negotiable requirement(s) could not be verified: %s."


def usage(calls: DataFrame, key: list[str], purpose: str, tokens: str, ms: str, ok: Column) -> DataFrame:
    """One row for each key: ``calls``, ``failed``, ``error_rate`` (four places), ``all_ok``, ``total_tokens``, ``total_ms``, ``avg_ms`` (whole, over calls that succeeded and have a time) and ``by_purpose``, a map of tokens.

    Tokens and times count for calls that succeeded; null ones are 0 in sums.
    A null ``ok`` is a failure, a null purpose is ``unknown``. Calls are summed
    by key and purpose before a key's row is made, so hot keys are shared among
    tasks and a map has as many entries as there are purposes. Without a
    key there is one row, also for no calls.
    """
    good = F.coalesce(ok, F.lit(False))
    rows = calls.select(*key, F.coalesce(F.col(purpose), F.lit("unknown")).alias("__purpose"), good.alias("__ok"), F.when(good, F.col(tokens)).cast("long").alias("__tokens"), F.when(good, F.col(ms)).cast("double").alias("__ms"))
    parts = rows.groupBy(*key, "__purpose").agg(F.count("*").alias("n"), F.count_if(~F.col("__ok")).alias("bad"), F.coalesce(F.sum("__tokens"), F.lit(0)).alias("tokens"), F.sum("__ms").alias("ms"), F.count("__ms").alias("timed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    entries = F.array_sort(F.collect_list(F.struct("__purpose", "tokens")))
    out = parts.groupBy(*key).agg(total("n").alias("calls"), total("bad").alias("failed"), total("tokens").alias("total_tokens"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"), total("timed").alias("__timed"), F.map_from_entries(entries).alias("by_purpose"))
    n = F.nullif(F.col("calls"), F.lit(0))
    rate = F.when(n.isNotNull(), round_half_up(F.col("failed") / n, 4))
    timed = F.nullif(F.col("__timed"), F.lit(0))
    mean = F.when(timed.isNotNull(), round_half_up(F.col("total_ms") / timed))
    return out.withColumns({"error_rate": rate, "all_ok": F.col("failed") == 0, "avg_ms": mean}).drop("__timed")


def checks_summary(checks: Column) -> Column:
    """What an array of ``struct<requirement, verified>`` comes to, in words; requirements in their order, a null verdict is unmet."""
    unmet = F.transform(F.filter(checks, lambda c: ~F.coalesce(c["verified"], F.lit(False))), lambda c: c["requirement"])
    return F.when(F.coalesce(F.size(unmet), F.lit(0)) <= 0, ALL_MET).otherwise(F.format_string(UNMET, F.size(unmet), F.array_join(unmet, "; ")))


def matches_of(**parts: DataFrame) -> DataFrame:
    """Lists of matches as one, with ``source`` and ``list``, the place of a match's list among them."""
    sourced = [p.drop("source").withColumns({"source": F.lit(name), "list": F.lit(n)}) for n, (name, p) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b), sourced)


def category_counts(matches: DataFrame, key: str) -> DataFrame:
    """``(key, counts)``: a map of how many required and preferred matches fall in each category."""
    counted = matches.where(F.col("source").isin("required", "preferred")).groupBy(key, "category").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))


def gaps_and_unmet(matches: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """``(key, item, category, source, priority, detection)``: gaps among ``matches (key, item, source, category, credit)``, and each requirement of ``checks (key, requirement, verified, method)`` that is not verified, as missing and of high priority."""
    found = matching.gaps(matches).select(key, "item", "category", "source", "priority", F.lit("match").alias("detection"))
    unmet = checks.where(~F.coalesce("verified", F.lit(False)))
    extra = unmet.select(key, F.col("requirement").alias("item"), F.lit("MISSING_REQ").alias("category"), F.lit("required").alias("source"), F.lit("high").alias("priority"), F.col("method").alias("detection"))
    return found.unionByName(extra)
