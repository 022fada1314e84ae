"""Reports on bullets, on experience, and on how well a text can be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric, privacy, text
from .scoring import check_score

IDEAL_WORDS = (12, 28)  # fixed values
#: Verbs that open a bullet strongly. A default; callers have their own lists.
VERBS = ("achieved", "analyzed", "automated", "built", "created", "cut", "delivered", "designed", "developed", "drove", "grew", "improved", "increased", "launched", "led", "migrated", "reduced", "saved", "scaled", "shipped")


def bullet_report(bullets: DataFrame, key: str, bullet: str, verbs: tuple[str, ...] = VERBS) -> DataFrame:
    """Shares of strong and passive openers and of amounts, the index of achievements, and word counts; blank bullets do not count."""
    b, low, high = F.trim(bullet), *IDEAL_WORDS
    rows = bullets.where(b != "").select(key, text.opener(b, verbs).alias("opener"), text.is_quantified(b).alias("amount"), text.count_words(b).alias("words"))
    share = lambda c: F.count_if(c) / F.count("*") * 100
    counted = F.count_if(F.col("words") > 0)
    return rows.groupBy(key).agg(
        F.count("*").alias("bullets"), F.round(share(F.col("opener") == "strong"), 2).alias("verb_density"), F.count_if(F.col("opener") == "passive").alias("passive_openers"),
        F.round(share(F.col("amount")), 2).alias("quantified_ratio"), F.round(F.least(F.lit(100.0), share(F.col("amount")) * 2), 2).alias("achievements"),
        F.coalesce(F.round(F.sum("words") / F.nullif(counted, F.lit(0)), 1), F.lit(0.0)).alias("avg_words"), F.coalesce(F.min(F.when(F.col("words") > 0, F.col("words"))), F.lit(0)).alias("min_words"), F.max("words").alias("max_words"),
        F.coalesce(F.round(F.count_if(F.col("words").between(low, high)) / F.nullif(counted, F.lit(0)) * 100, 2), F.lit(0.0)).alias("length_fit"),
    )


def quality_score(verbs: Column, structure: Column, readability: Column, length_fit: Column) -> Column:
    return numeric.round_half_up(0.4 * verbs + 0.25 * structure + 0.2 * readability + 0.15 * length_fit, 2)


#: Words of a seniority that mark a posting for beginners.
ENTRY_LEVEL = ("intern", "internship", "entry", "entry-level", "junior", "graduate", "grad", "trainee", "apprentice", "associate", "student", "no experience")


def entry_level(seniority: Column, least_years: Column, education: Column) -> Column:
    """Whether a posting is for beginners: by its seniority, by at most one year asked for, or by its education."""
    by_name = F.lower(F.coalesce(seniority, F.lit(""))).rlike("|".join(ENTRY_LEVEL))
    return by_name | F.coalesce(least_years <= 1, F.lit(False)) | F.lower(F.coalesce(education, F.lit(""))).rlike("student|intern")


def experience_score(months: Column, least_years: Column, similarities: Column, projects: Column | None = None, beginners: Column | None = None) -> Column:
    """0.35 of the years' score and 0.65 of the relevance of the better half of the similarities, in 0 to 100; 70 where none is positive.

    For beginners' postings the similarities of projects count as well; without
    any given, those of roles count twice.
    """
    if beginners is not None:
        similarities = F.when(beginners, F.concat(similarities, similarities if projects is None else projects)).otherwise(similarities)
    relevance = F.coalesce(numeric.relevance(numeric.top_k_mean(similarities)), F.lit(70.0))
    score = 0.35 * numeric.years_score(months, least_years) + 0.65 * F.when(F.size(F.filter(similarities, lambda s: s > 0)) == 0, 70.0).otherwise(relevance)
    return F.round(numeric.clamp(score, 0, 100), 2)


def parse_checks(body: Column, columns: Column, boxes: Column, tables: Column, pages: Column, images: Column, fonts: Column, odd_fonts: Column) -> list[tuple[Column, float]]:
    """Five checks in 0 to 1 with their weights: headings, layout, characters, fonts, contact data."""
    found = text.sections(body)
    core = F.size(F.filter(found, lambda n: n.isin(*text.CORE)))
    headings = core / 3 * 0.85 + F.least(F.size(found) - core, F.lit(3)) / 3 * 0.15
    layout = 1 - F.least(F.lit(0.35), columns * 0.2) - F.least(F.lit(0.3), boxes * 0.1) - F.least(F.lit(0.3), tables / F.greatest(F.lit(1), pages) * 0.15) - F.when(images > 2, F.least(F.lit(0.2), (images - 2) * 0.04)).otherwise(0.0)
    characters = text.density(body) - F.when(F.length(body) == 0, 0.0).otherwise(text.garbage_ratio(body)) * 5
    email, phone = privacy.readable_contacts(body)
    return [(headings, 0.3), (layout, 0.25), (characters, 0.25), (F.when(fonts == 0, 0.8).otherwise(1 - odd_fonts / F.greatest(F.lit(1), fonts)), 0.1), (email.cast("int") * 0.5 + phone.cast("int") * 0.5, 0.1)]


def parse_score(checks: list[tuple[Column, float]]) -> Column:
    return check_score(checks)
