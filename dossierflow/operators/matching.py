"""Names to canonical entities, related entities, and staged matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_skill


def alias_index(entities: DataFrame, canonical: str, aliases: str, pos: str) -> DataFrame:
    """``(norm, canonical)``: the first entry wins where normal forms collide."""
    names = entities.select(F.col(canonical).alias("canonical"), F.col(pos).alias("pos"), F.explode(F.concat(F.array(canonical), F.col(aliases))).alias("alias"))
    names = names.select("canonical", "pos", normal_skill(F.col("alias")).alias("norm")).where("norm <> ''")
    return names.groupBy("norm").agg(F.min_by("canonical", "pos").alias("canonical"))


def canonicalise(names: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """``names`` with ``canonical``; unknown names stand for themselves, trimmed."""
    looked = names.withColumn("__norm", normal_skill(F.col(name))).join(index.withColumnRenamed("norm", "__norm"), "__norm", "left")
    return looked.withColumn("canonical", F.coalesce("canonical", F.trim(name))).drop("__norm")


def related(edges: DataFrame) -> DataFrame:
    """``(a, b)`` from ``edges(child, parent)``: parent and child either way, and children of one parent. Equi-joins only."""
    up = edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))
    down = up.select(F.col("b").alias("a"), F.col("a").alias("b"))
    known = edges.select(F.col("child").alias("parent")).distinct()
    named = edges.join(known, "parent", "left_semi")  # a shared parent counts if it is an entity itself
    siblings = named.select(F.col("child").alias("a"), "parent").join(named.select(F.col("child").alias("b"), "parent"), "parent").where("a <> b").select("a", "b")
    return up.unionByName(down).unionByName(siblings).distinct()


def staged_match(required: DataFrame, held: DataFrame, pairs: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """``required(key, item, source)`` with ``category`` and ``credit``; the first stage that succeeds wins.

    Stages: the item itself is ``held``; a related one is; the best
    similarity in ``similar(key, item, similarity)`` reaches a band; missing.
    Each stage is an equi-join, so later stages see small inputs.
    """
    from ..functions.numeric import credit

    exact = held.select(key, "item").distinct().withColumn("exact", F.lit(True))
    near = held.select(key, F.col("item").alias("a")).join(pairs, "a").select(key, F.col("b").alias("item")).distinct().withColumn("near", F.lit(True))
    best = similar.groupBy(key, "item").agg(F.max("similarity").alias("similarity"))
    out = required.join(exact, [key, "item"], "left").join(near, [key, "item"], "left").join(best, [key, "item"], "left")
    partial = credit(F.coalesce("similarity", F.lit(0.0)))
    category = F.when(F.col("exact"), "EXACT").when(F.col("near"), "STRONG_RELATED").when(partial > 0, "PARTIAL").when(F.col("source") == "preferred", "MISSING_PREF").otherwise("MISSING_REQ")
    value = F.when(F.col("exact"), 1.0).when(F.col("near"), 0.85).otherwise(partial)
    return out.select(key, "item", "source", category.alias("category"), value.alias("credit"))


GAPS = ("MISSING_REQ", "MISSING_PREF", "MENTIONED_WITHOUT_EVIDENCE")


def gaps(matches: DataFrame) -> DataFrame:
    """The matches that are gaps, with a priority: high where something required is missing or not shown, else medium."""
    is_gap = F.col("category").isin(*GAPS) | ((F.col("category") == "PARTIAL") & (F.col("credit") < 0.5))
    priority = F.when((F.col("category") == "MISSING_REQ") | (F.col("source") == "required"), "high").otherwise("medium")
    return matches.where(is_gap).withColumn("priority", priority)


def first_by_key(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
