"""Whole reports of a document's dates and bullets: consistency of dates, and quality of what is told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from . import intervals, quality, scoring

KINDS = ("experience", "education")
LEAST_DATES, LEAST_SHARE, LEAST_OVERLAP = 4, 0.8, 2  # fixed values


def dated(roles: DataFrame, key: str, now_month: Column) -> DataFrame:
    """``roles (key, kind, pos, start_date, end_date)`` of kind ``experience`` that have a date, with ``range``, ``s``, ``e`` and ``status``."""
    whole = F.concat_ws(" - ", F.nullif(F.col("start_date"), F.lit("")), F.nullif(F.col("end_date"), F.lit("")))
    rows = roles.where(F.col("kind") == KINDS[0]).select(key, "pos", whole.alias("range")).where(F.trim("range") != "")
    # out of an array, so that no filter above is answered by reading the dates again
    rows = rows.select(key, "pos", "range", F.inline(F.array(dates.parse_range(F.col("range"), now_month)))).withColumnsRenamed({"start": "s", "end": "e"})
    return rows.withColumn("status", dates.range_status(F.col("s"), F.col("e"), now_month))


def _mixed(roles: DataFrame, key: str) -> DataFrame:
    """``(key, mixed)``: whether the dates of a kind, four or more, have no style in four fifths of those whose style is known. One aggregation, without a row for each date."""
    both = lambda test: test(F.col("start_date")).cast("int") + test(F.col("end_date")).cast("int")
    sums, tests = [], []
    for kind in KINDS:
        here = F.col("kind") == kind
        add = lambda test, name, here=here: F.sum(F.when(here, both(test)).otherwise(0)).alias(name)
        names = [f"__{kind}_{s}" for s in dates.STYLES]
        sums += [add(lambda c: F.coalesce(c != "", F.lit(False)), f"__{kind}")] + [add(lambda c, s=s: dates.date_style(c) == s, n) for s, n in zip(dates.STYLES, names, strict=True)]
        known = reduce(lambda a, b: a + b, map(F.col, names))
        tests.append((F.col(f"__{kind}") >= LEAST_DATES) & (known > 0) & (F.greatest(*names) / known < LEAST_SHARE))
    return roles.groupBy(key).agg(*sums).select(key, F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)).alias("mixed"))


def structure_report(roles: DataFrame, key: str, now_month: Column, examples: int = 3) -> DataFrame:
    """One row for each key: ``mixed``, ``newest_first``, ``overlaps``, ``unparsed``, ``invalid``, ``months``, ``overlap_months``, ``structure_score``, ``findings``, and the first ranges that cannot be read or true.

    ``roles (key, kind, pos, start_date, end_date)``: ``kind`` is ``experience``
    or ``education``, ``pos`` an integer that orders a key's roles. Null and
    empty dates do not count; a key without dates has the full score and a
    null ``newest_first``. Keys may have any number of roles: counts are
    aggregates, pairs are counted by month, examples are limited before they
    are shuffled. Rows of null key take no part.
    """
    roles = roles.where(F.col(key).isNotNull())
    rows = dated(roles.select(key, "kind", "pos", "start_date", "end_date"), key, now_month)
    true = F.col("status") == "ok"
    counts = rows.groupBy(key).agg(F.count_if(F.col("status") == "unparsed").alias("unparsed"), F.count_if(F.col("status") == "invalid").alias("invalid"), F.sum(F.when(true, F.col("e") - F.col("s") + 1)).alias("__raw"))
    order = intervals.newest_first(rows.where("s is not null"), key, "pos")
    pairs = intervals.overlap_count(rows.where("s is not null and e is not null"), key, LEAST_OVERLAP)
    spent = intervals.islands(rows.where(true).select(key, "s", "e").distinct(), key).groupBy(key).agg(F.sum(F.col("e") - F.col("s") + 1).alias("months"))
    odd = rows.where("status <> 'ok'").withColumn("__n", F.row_number().over(Window.partitionBy(key, "status").orderBy("pos", "range"))).where(F.col("__n") <= examples)
    shown = odd.groupBy(key).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.struct("__n", "range")))), lambda x: x["range"]).alias(f"{s}_ranges") for s in ("unparsed", "invalid")])
    out = _mixed(roles, key)
    for part in (counts, order, pairs, spent, shown):
        out = out.join(part, key, "left")
    out = out.fillna(0, ["unparsed", "invalid", "overlaps", "months", "__raw"]).withColumn("overlap_months", F.col("__raw") - F.col("months")).drop("__raw")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("unparsed_ranges", "invalid_ranges")})
    unordered = F.coalesce(~F.col("newest_first"), F.lit(False))
    told = {"mixed_dates": F.col("mixed"), "not_newest_first": unordered, "overlaps": F.col("overlaps") > 0, "unparsed_ranges": F.col("unparsed") > 0, "invalid_ranges": F.col("invalid") > 0}
    score = scoring.structure_score(F.col("mixed"), unordered, F.col("overlaps"), F.col("unparsed"), F.col("invalid"))
    return out.withColumns({"structure_score": score, "findings": names_of(told)})


def names_of(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))


LEAST_TEXT, EMPTY_READABILITY, LONG_SENTENCE, LEAST_VERBS, LEAST_FIT, LEAST_ACHIEVEMENTS = 40, 60.0, 34, 60, 60, 60  # fixed values


def quality_report(bullets: DataFrame, structure: DataFrame, key: str, bullet: str, verbs: tuple[str, ...] = quality.VERBS) -> DataFrame:
    """One row for each key of ``structure`` (see :func:`structure_report`) or ``bullets``: what :func:`quality.bullet_report` says, readability of the bullets as one text, ``quality_score`` and ``findings``.

    Words, sentences and syllables are summed over bullets, never joined to one
    text, which has the same counts. A key without bullets has a readability of
    60 and no share of verbs; one without roles a structure of 100. Rows of null
    key take no part.
    """
    bullets = bullets.where(F.col(key).isNotNull())
    told = quality.bullet_report(bullets, key, bullet, verbs)
    b = F.trim(bullet)
    rows = bullets.where(b != "").select(key, F.length(b).alias("chars"), text.count_words(b).alias("w"), text.worded_parts(b).alias("p"), text.syllables(b).alias("v"))
    sums = rows.groupBy(key).agg((F.sum("chars") + 2 * (F.count("*") - 1)).alias("__chars"), F.sum("w").alias("words"), F.greatest(F.lit(1), F.sum("p")).alias("sentences"), F.sum("v").alias("syllables"))
    both = told.join(sums, key).join(structure, key, "full").fillna(0, ["bullets", "__chars", "words", "sentences", "syllables", "passive_openers", "min_words", "max_words"])
    both = both.fillna(0.0, ["verb_density", "quantified_ratio", "achievements", "avg_words", "length_fit"]).fillna(100.0, ["structure_score"])
    w, s, v = F.col("words"), F.col("sentences"), F.col("syllables")
    one = lambda c: F.floor(c * 10 + 0.5) / 10
    both = both.withColumns({"ease": one(text.reading_ease(w, s, v)), "grade": one(text.grade_level(w, s, v)), "sentence_words": F.when(w > 0, one(w / s)).otherwise(0.0)})
    readable = F.when(F.col("__chars") > LEAST_TEXT, text.readability_score(F.col("ease"))).otherwise(EMPTY_READABILITY)
    both = both.withColumn("readability", numeric.round_half_up(readable, 2))
    score = numeric.clamp(quality.quality_score(F.col("verb_density"), F.col("structure_score"), F.col("readability"), F.col("length_fit")), 0, 100)
    any_ = F.col("bullets") > 0
    own = names_of({
        "few_verbs": any_ & (F.col("verb_density") < LEAST_VERBS), "passive_openers": F.col("passive_openers") > 0, "long_sentences": (F.col("__chars") > LEAST_TEXT) & (F.col("sentence_words") > LONG_SENTENCE),
        "odd_lengths": (F.col("max_words") > 0) & (F.col("length_fit") < LEAST_FIT), "few_amounts": any_ & (F.col("achievements") < LEAST_ACHIEVEMENTS), "no_bullets": ~any_,
    })
    found = F.concat(F.coalesce("findings", F.array().cast("array<string>")), own)
    return both.withColumns({"quality_score": score, "findings": found}).drop("__chars")
