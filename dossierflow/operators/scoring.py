"""Weighted scores, their re-normalised parts, and caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, round_half_up

# The components and each profile's weights for them.
COMPONENTS = ("required_skills", "preferred_skills", "semantic_match", "experience_relevance", "ats_parseability", "content_quality", "achievements")
WEIGHTS = {
    "software_engineer": (0.35, 0.10, 0.15, 0.15, 0.10, 0.05, 0.10),
    "data_analyst": (0.30, 0.15, 0.15, 0.15, 0.10, 0.05, 0.10),
    "cybersecurity": (0.40, 0.10, 0.10, 0.15, 0.10, 0.05, 0.10),
    "product_manager": (0.20, 0.15, 0.20, 0.20, 0.10, 0.05, 0.10),
}
CAP = 70.0

for _profile, _weights in WEIGHTS.items():
    if abs(sum(_weights) - 1) > 1e-9:
        raise ValueError(f"weights of {_profile} do not sum to 1")


def weighted_score(df: DataFrame, components: list[str], weights: tuple[float, ...], name: str = "score") -> DataFrame:
    """``df`` with ``name``: each part is cleaned and rounded to four places, the sum to two.

    Built in stages, since rounding names its input several times.
    """
    parts = [f"__{name}_{k}" for k in range(len(components))]
    staged = df.withColumns({p: clamp(F.col(c), 0, 100) * w for p, c, w in zip(parts, components, weights, strict=True)})
    staged = staged.withColumns({p: round_half_up(F.col(p), 4) for p in parts})
    staged = staged.withColumn(name, clamp(reduce(lambda a, b: a + b, map(F.col, parts)), 0, 100)).drop(*parts)
    return staged.withColumn(name, round_half_up(F.col(name), 2))


def renormalised(df: DataFrame, components: list[str], weights: tuple[float, ...], name: str = "score") -> DataFrame:
    """A score over some components whose weights are stretched to sum to 1."""
    total = sum(weights)
    return weighted_score(df, components, tuple(w / total for w in weights), name)


def component_rows(df: DataFrame, key: list[str], components: list[str], weights: tuple[float, ...]) -> DataFrame:
    """A row for each component with its score, weight and weighted share of two places."""
    rows = F.array(*[F.struct(F.lit(c).alias("component"), clamp(F.col(c), 0, 100).alias("score"), F.lit(w).alias("weight")) for c, w in zip(components, weights, strict=True)])
    return df.select(*key, F.inline(rows)).withColumn("weighted", F.col("score") * F.col("weight")).withColumn("weighted", round_half_up(F.col("weighted"), 2))


def capped(required: Column, unmet: Column) -> Column:
    return F.when(unmet, F.least(required, F.lit(CAP))).otherwise(required)


def check_score(checks: list[tuple[Column, float]]) -> Column:
    """A weighted sum of checks in 0 to 1, as a score."""
    return round_half_up(reduce(lambda a, b: a + b, [clamp(c, 0, 1) * w for c, w in checks]) * 100, 2)


def structure_score(mixed: Column, unordered: Column, overlaps: Column, unparsed: Column, invalid: Column) -> Column:
    off = F.when(mixed, 15).otherwise(0) + F.when(unordered, 15).otherwise(0) + F.least(F.lit(15), 5 * overlaps) + F.least(F.lit(20), 5 * unparsed) + F.least(F.lit(30), 10 * invalid)
    return clamp(100 - off, 0, 100)
