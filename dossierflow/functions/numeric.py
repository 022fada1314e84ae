"""Numbers: clamping, rounding half up, bands, and means with their rules for nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITY_BANDS = ((0.82, 1.0), (0.72, 0.65), (0.60, 0.25))  # fixed values: least cosine and credit


def clamp(x: Column, low: float, high: float) -> Column:
    """NaN and null count as ``low``."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.nanvl(x.cast("double"), F.lit(float(low)))))


def round_half_up(x: Column, places: int = 0) -> Column:
    """Half goes up, also below zero; what is not finite gives 0, and there is no minus zero."""
    x, scale = x.cast("double"), float(10**places)
    nudged = (x + F.signum(x) * F.lit(2.0**-52)) * scale + 0.5
    value = F.floor(nudged).cast("double") / scale
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(value + 0.0)


def credit(similarity: Column) -> Column:
    """Credit of a similarity by band; below the lowest band, or not a number, none."""
    out = F.when(F.isnan(similarity), 0.0)
    for least, value in SIMILARITY_BANDS:
        out = out.when(similarity >= least, value)
    return out.otherwise(0.0)


def relevance(similarity: Column) -> Column:
    return credit(similarity).cast("double") * 100


def score_band(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "strong").when(score >= 50, "moderate").otherwise("developing")


def coverage(mean_credit: Column, empty: float) -> Column:
    """A mean credit in 0 to 1 as a score; ``empty`` where there was nothing to cover."""
    return F.coalesce(mean_credit * 100, F.lit(float(empty)))


def top_k_mean(values: Column) -> Column:
    """Mean of the larger half, at least one, of the positive values; null if none is positive."""
    positive = F.sort_array(F.filter(values, lambda x: (x > 0) & ~F.isnan(x)), asc=False)
    k = F.greatest(F.lit(1), F.ceil(F.size(positive) / 2)).cast("int")
    return F.when(F.size(positive) > 0, F.aggregate(F.slice(positive, 1, k), F.lit(0.0), lambda s, x: s + x) / k)


def years_score(months: Column, least_years: Column) -> Column:
    ratio = months / 12 / least_years
    known = F.when(least_years <= 0, 100.0).when(ratio >= 1, 100.0).otherwise(F.greatest(F.lit(30.0), ratio * 100))
    return F.when(least_years.isNull(), F.when(months > 0, 70.0).otherwise(50.0)).otherwise(known)


def backoff(base_ms: int, most_ms: int, attempts: Column) -> Column:
    """Delays that double up to ``most_ms``."""
    return F.transform(F.sequence(F.lit(0), attempts - 1), lambda i: F.least(F.lit(most_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), i)))


def skill_blend(required: Column, preferred: Column, preferred_count: Column) -> Column:
    """Seven tenths of the required score and three of the preferred one; the required one alone where nothing is preferred."""
    return clamp(F.when(preferred_count == 0, required).otherwise(0.7 * required + 0.3 * preferred), 0, 100)


def confidence(similarity: Column) -> Column:
    """The name of a similarity's band: ``high``, ``medium``, ``low`` or ``none``."""
    out = F.when(F.isnan(similarity), "none")
    for name, (least, _) in zip(("high", "medium", "low"), SIMILARITY_BANDS, strict=True):
        out = out.when(similarity >= least, name)
    return out.otherwise("none")


def shown_similarity(similarity: Column) -> Column:
    """Three places, half up."""
    return F.format_string("%.3f", F.floor(similarity * 1000 + 0.5) / 1000)


def bucket(score: Column) -> Column:
    """The ten that a score lies in."""
    return (F.floor(score / 10) * 10).cast("int")


def page_estimate(chars: Column, rows: Column) -> tuple[Column, Column]:
    """Pages of a text without pages and tables told by their rows."""
    return F.greatest(F.lit(1), F.ceil(chars / 3000)).cast("int"), F.when(rows > 0, F.greatest(F.lit(1), F.floor(rows / 4))).otherwise(0).cast("int")
