"""Reporting over tables: spines, pages, latest rows, nested children, restricted rows, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(df: DataFrame, ts: str, kinds: dict[str, Column]) -> DataFrame:
    """``(day, ...)``: how many rows of each kind a day has, in one pass."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def daily_spine(counts: DataFrame, days: int = 30) -> DataFrame:
    """A row for each of the ``days`` days up to the last in ``counts (day, ...)``; counts are 0 on days without rows."""
    spine = counts.agg(F.max("day").alias("day")).select(F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))).alias("day"))
    names = [c for c in counts.columns if c != "day"]
    return spine.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def active_within(events: DataFrame, user: str, ts: str, windows: dict[str, int]) -> DataFrame:
    """Distinct users in each trailing window of days before the latest event; null users do not count."""
    seen = events.groupBy(user).agg(F.max(ts).alias("seen"))  # a row for each user
    both = seen.crossJoin(F.broadcast(seen.agg(F.max("seen").alias("now"))))  # one row
    return both.where(F.col(user).isNotNull()).agg(*[F.count_if(F.col("seen") >= F.col("now") - F.expr(f"INTERVAL {d} DAYS")).alias(n) for n, d in windows.items()])


def weighted_mean(groups: DataFrame, mean: str, count: str, places: int = 2) -> Column:
    """Aggregate: a null mean counts as 0, no rows give null."""
    return F.round(F.sum(F.coalesce(mean, F.lit(0.0)) * F.col(count)) / F.sum(count), places)


def latest(df: DataFrame, key: str, ts: str, tie: str, k: int) -> DataFrame:
    """The ``k`` latest rows of each key with their ``rank``; Spark filters them ahead of the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col(ts).desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page(df: DataFrame, order: list[Column], number: int, size: int, least: int = 5, most: int = 100) -> DataFrame:
    """One page of rows under a total order; page sizes are clamped."""
    size = max(least, min(most, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows with ``total`` and ``total_pages`` (one at least), counted over all rows."""
    total = df.agg(F.count("*").alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).alias("total_pages")
    return page(df, order, number, size).crossJoin(F.broadcast(total.select("total", pages)))  # one row


def upserted(df: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """``df`` with the rows of ``new``: on equal keys the new row wins, or with ``update`` false the old one. Keys are unique in either."""
    old, add = (df.join(new.select(*key), key, "left_anti"), new) if update else (df, new.join(df.select(*key), key, "left_anti"))
    return old.unionByName(add)


def updated(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with columns set where the predicate is true, which ``was_updated`` tells."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()} | {"was_updated": hit})


def median_by_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value at place floor(n / 2) of each key's sorted values."""
    order = Window.partitionBy(key).orderBy(value)
    return df.select(key, value, (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n")).where("i = n div 2").select(key, F.col(value).alias("median"))


def filtered(df: DataFrame, predicates: list[Column | None]) -> DataFrame:
    """Only the predicates that are given."""
    return reduce(lambda a, p: a.where(p), [p for p in predicates if p is not None], df)


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str, newest: bool = True) -> DataFrame:
    """Parents with their children as an array of structs, sorted by the first field; parents without children have none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=not newest).alias(name))
    return parents.join(lists, key, "left")


def owned(df: DataFrame, parents: DataFrame, on: str, allowed: Column, admin: bool = False) -> DataFrame:
    """Rows whose parent the user may see; an administrator sees all."""
    return df if admin else df.join(parents.where(allowed), on, "left_semi")


def without(df: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    """What a deletion that cascades along ``on`` leaves."""
    return df.join(deleted, on, "left_anti")


def anonymised(df: DataFrame, deleted: DataFrame, user: str) -> DataFrame:
    """Rows of deleted users stay with a null user."""
    gone = deleted.select(F.col(user).alias("__gone")).distinct()
    return df.join(gone, df[user] == F.col("__gone"), "left").withColumn(user, F.when(F.col("__gone").isNull(), F.col(user))).drop("__gone")


def deltas(both: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each metric: ``(key, metric, older, newer, delta)`` from columns ``old_m`` and ``new_m``."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"old_{m}").alias("older"), F.col(f"new_{m}").alias("newer")) for m in metrics])
    return both.select(key, F.inline(parts)).withColumn("delta", F.col("newer") - F.col("older"))


def status_changes(older: DataFrame, newer: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """Items whose status changed: direction by rank; items that are new only do not count. Keys are unique on the older side."""
    a = older.select(*key, F.col("status").alias("from_status"))
    b = newer.select(*key, F.col("status").alias("to_status"))
    both = a.join(b, key).where("from_status <> to_status")
    at = lambda c: F.element_at(rank, F.col(c))
    return both.withColumn("credit_delta", (at("to_status") - at("from_status")) / 5).withColumn("direction", F.when(at("to_status") > at("from_status"), "improved").otherwise("declined"))


def chunked(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """``chunk``: numbers of runs of ``size`` rows within a key."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))
