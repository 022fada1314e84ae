"""Users seen in trailing windows of days: exactly over a table, and by mergeable sketches over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_K = 14  # of a sketch: 2^14 registers, a standard error under one in a hundred


def rolling_exact(events: DataFrame, user: str, ts: str, windows: dict[str, int]) -> DataFrame:
    """``(day, ...)``: for each day from the first to the last one, the distinct users of the window of days that ends with it.

    A user counts from a day on which they are seen until the window has
    passed or they are seen again. So a user's day is one step up and one
    down, whatever the window's length, and the count is a running sum over
    days; no user is copied into every window. Null users and times do not
    count.
    """
    seen = events.select(F.col(user).alias("user"), F.to_date(ts).alias("day")).where("user is not null and day is not null").distinct()
    after = seen.withColumn("next", F.lead("day").over(Window.partitionBy("user").orderBy("day")))
    ends = lambda days: F.least(F.date_add("day", days), F.col("next"))  # noqa: E731  least ignores a null
    steps = [F.struct(F.lit(n).alias("kind"), F.col("day").alias("at"), F.lit(1).alias("step")) for n in windows] + [F.struct(F.lit(n).alias("kind"), ends(d).alias("at"), F.lit(-1).alias("step")) for n, d in windows.items()]
    by_day = after.select(F.inline(F.array(*steps))).groupBy(F.col("at").alias("day")).pivot("kind", list(windows)).agg(F.sum("step"))
    spine = seen.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return spine.join(by_day, "day", "left").select("day", *[F.sum(F.coalesce(n, F.lit(0))).over(upto).alias(n) for n in windows])


def daily_sketches(events: DataFrame, user: str, ts: str) -> DataFrame:
    """``(day, sketch)`` of some of the events; sketches of a day merge, so this is what a micro-batch leaves."""
    return events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(F.col(user), F.lit(LG_K)).alias("sketch"))


def rolling_estimates(sketches: DataFrame, windows: dict[str, int]) -> DataFrame:
    """What :func:`rolling_exact` gives, estimated from ``sketches (day, sketch)``: a day's sketch goes to each window that it lies in."""
    days = sketches.groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))
    last = days.agg(F.max("day").alias("last"))
    reach = days.crossJoin(F.broadcast(last)).select(F.explode(F.sequence("day", F.least(F.col("last"), F.date_add("day", max(windows.values()) - 1)))).alias("to"), "day", "sketch")  # last: one row
    age = F.date_diff("to", "day")
    merged = reach.groupBy(F.col("to").alias("day")).agg(*[F.hll_sketch_estimate(F.hll_union_agg(F.when(age < d, F.col("sketch")))).alias(n) for n, d in windows.items()])
    spine = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null").select(F.explode(F.sequence("first", "last")).alias("day"))
    return spine.join(merged, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in windows])
