"""Month intervals within a key: islands, overlaps, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """``(key, s, e)`` merged; intervals that touch (start = end + 1) are one."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    flagged = df.withColumn("__prev", F.max(end).over(before)).withColumn("__new", F.when(F.col(start) <= F.col("__prev") + 1, 0).otherwise(1))
    return flagged.withColumn("__island", F.sum("__new").over(upto)).groupBy(key, "__island").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("__island")


def tenure(df: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """``(key, total_months, raw_months, overlap_months)``, ends included."""
    raw = df.groupBy(key).agg(F.sum(F.col(end) - F.col(start) + 1).alias("raw_months"))
    total = islands(df, key, start, end).groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).alias("total_months"))
    return total.join(raw, key).withColumn("overlap_months", F.col("raw_months") - F.col("total_months"))


def overlaps(df: DataFrame, key: str, pos: str, start: str = "s", end: str = "e") -> DataFrame:
    """Pairs of a key's intervals that share months, each met in the month in which the later one starts.

    An equi-join on key and month, so only pairs that overlap are made.
    """
    months = F.explode(F.sequence(F.col(start), F.col(end))).alias("__month")
    a = df.where(F.col(start) <= F.col(end)).select(key, F.col(pos).alias("ap"), F.col(start).alias("as"), F.col(end).alias("ae"), months)
    b = df.where(F.col(start) <= F.col(end)).select(key, F.col(pos).alias("bp"), F.col(start).alias("__month"), F.col(end).alias("be"))
    both = a.join(b, [key, "__month"]).where("as < __month or (as = __month and ap < bp)")
    return both.select(key, F.least("ap", "bp").alias("left_pos"), F.greatest("ap", "bp").alias("right_pos"), (F.least("ae", "be") - F.col("__month") + 1).alias("months"))


def overlap_count(df: DataFrame, key: str, least: int = 2, start: str = "s", end: str = "e") -> DataFrame:
    """``(key, overlaps)``: pairs of a key's intervals that share at least ``least`` months, without making them.

    Shortened by ``least - 1`` months, such pairs are those that meet at all:
    each interval meets those open in the month in which it starts. Starts and
    ends are counted by month first, so a key of any size is as many rows as
    there are months. Keys without such a pair have no row.
    """
    own = df.where(F.col(end) - F.col(start) >= least - 1)
    steps = F.array(F.struct(F.col(start).alias("month"), F.lit(1).alias("opened"), F.lit(0).alias("closed")), F.struct((F.col(end) - least + 2).alias("month"), F.lit(0).alias("opened"), F.lit(1).alias("closed")))
    months = own.select(key, F.inline(steps)).groupBy(key, "month").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
    before = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    open_now = F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(before), F.lit(0)) - F.col("closed")
    met = months.withColumn("__met", F.col("opened") * open_now + F.expr("opened * (opened - 1) div 2"))
    return met.groupBy(key).agg(F.sum("__met").alias("overlaps")).where("overlaps > 0")


def newest_first(df: DataFrame, key: str, pos: str, start: str = "s", block: int = 4096) -> DataFrame:
    """Whether starts never rise along ``pos``, an integer; null for fewer than two.

    Starts are compared within blocks of positions, then where blocks meet, so
    a key of any size is shared among tasks.
    """
    own = df.withColumn("__block", F.expr(f"{pos} div {block}"))
    lagged = own.withColumn("__prev", F.lag(start).over(Window.partitionBy(key, "__block").orderBy(pos)))
    falls = lambda: F.every(F.coalesce(F.col(start) <= F.col("__prev"), F.lit(True)))
    blocks = lagged.groupBy(key, "__block").agg(falls().alias("__falls"), F.min_by(start, pos).alias("__first"), F.max_by(start, pos).alias("__last"), F.count("*").alias("__n"))
    met = blocks.withColumn("__prev", F.lag("__last").over(Window.partitionBy(key).orderBy("__block")))
    every = F.every(F.col("__falls") & F.coalesce(F.col("__first") <= F.col("__prev"), F.lit(True)))
    return met.groupBy(key).agg(F.when(F.sum("__n") >= 2, every).alias("newest_first"))
