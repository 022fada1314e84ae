"""Hard requirements checked by ordered rules, and evidence for terms. No similarity takes part."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_term, to_sentence

# Words that state a kind of requirement, or that answer one.
AUTHORISATION_ASKED = r"citizen|citizenship|green card|permanent resident|work authoriz|authoris|visa|right to work|sponsor"
AUTHORISATION = ("citizen", "citizenship", "green card", "permanent resident", "work authorization", "authorized to work", "authorised to work", "right to work", "work permit", "visa", "h-1b", "h1b", "opt", "cpt", "ead", "tn visa", "sponsorship")
CLEARANCE_ASKED = r"clearance|top secret|ts\/sci|public trust|polygraph|secret\b"
CLEARANCE = ("clearance", "secret", "top secret", "ts/sci", "ts sci", "sci", "public trust", "polygraph", "security clearance", "dod", "department of defense")
YEARS = r"(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)"
LICENCE_ASKED = r"licen[cs]e|certification|certified|registration|accreditation"
LICENCES = (
    "cpa", "cfa", "pmp", "rn", "lpn", "np", "md", "do", "dds", "dvm", "pe", "eit", "bar admission", "law license", "series 7", "series 63", "series 66", "acls", "bls",
    "six sigma", "itil", "cissp", "cism", "ceh", "oscp", "ccna", "ccnp", "aws certified", "azure certified", "scrum master", "safe", "prince2",
)
DEGREES = (
    ("doctorate", r"\bphd\b|\bdoctorate\b|\bdoctoral\b|\bph\.d\b"),
    ("master", r"\bmaster'?s?\b|\bmsc\b|\bm\.s\.\b|\bmba\b|\bm\.a\.\b"),
    ("bachelor", r"\bbachelor'?s?\b|\bbsc\b|\bb\.s\.\b|\bba\b|\bb\.a\.\b|\bundergraduate degree\b"),
    ("associate", r"\bassociate'?s? degree\b|\ba\.a\.\b|\ba\.s\.\b"),
    ("degree", r"\bdegree\b"),
)
COMMON = ("with", "must", "have", "able", "that", "this", "from", "your", "will", "years", "work")
LEAST_SHARE = 0.6


def first_term(text: Column, terms: tuple[str, ...]) -> Column:
    """The first of the terms that the text holds, else null; most texts fail one pattern of them all."""
    some = "|".join(re.sub(r"\\ ", r"[\\s\\-]+", re.escape(t)) for t in terms)
    return F.when(text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}])({some})([^\p{{L}}\p{{N}}]|$)"), _each(text, terms))


def _each(text: Column, terms: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(contains_term(text, F.lit(t)), F.lit(t)) for t in terms])


def _first_held(names: Column | None, test) -> Column:
    """The first of an array of names that passes, else null."""
    return F.lit(None).cast("string") if names is None else F.get(F.filter(names, lambda n: F.coalesce(test(n), F.lit(False))), F.lit(0))


def verdicts(df: DataFrame, asked: list[str], text: str, months: str, degrees: str | None = None, certifications: str | None = None) -> DataFrame:
    """``df`` with each requirement of a stated list: ``requirement``, ``method``, ``verified``, ``matched``, by the rules of :func:`checked`.

    Which rule a requirement falls under is decided while the plan is built,
    so a text meets only constant patterns, and is not copied.
    """
    body, held, certs = F.col(text), F.col(degrees) if degrees else None, F.col(certifications) if certifications else None
    actual = F.floor(F.coalesce(F.col(months), F.lit(0)) / 12 * 10 + 0.5) / 10

    def verdict(requirement: str) -> Column:
        low, matched = requirement.strip().lower(), F.lit(None).cast("string")
        years = re.search(YEARS, low)
        licence = next((t for t in LICENCES if re.search(rf"(^|[\W_]){re.escape(t)}([\W_]|$)", low)), None)
        level = next(((n, p) for n, p in DEGREES if re.search(p, low)), None)
        method = "keyword"
        if re.search(AUTHORISATION_ASKED, low):
            matched = first_term(body, AUTHORISATION)
        elif re.search(CLEARANCE_ASKED, low):
            matched = first_term(body, CLEARANCE)
        elif years:
            method = "experience_months"
        elif licence or re.search(LICENCE_ASKED, low):
            own = F.when(contains_term(body, F.lit(licence)), licence) if licence else matched
            matched = F.coalesce(own, _first_held(certs, lambda n: contains_term(body, n)))
        elif level:
            method, (name, pattern) = "education", level
            matched = F.coalesce(_first_held(held, lambda d: F.lower(d).rlike(pattern)), F.when(contains_term(body, F.lit(name)), name))
        else:
            method = "pattern"
            words = [w for w in dict.fromkeys(w.lower() for w in re.findall(r"\b[A-Za-z][A-Za-z+#.-]{3,}\b", requirement)) if w not in COMMON][:6]
            hits = [contains_term(body, F.lit(w)) for w in words]
            matched = F.coalesce(matched, *[F.when(h, w) for w, h in zip(words, hits, strict=True)])
        if method == "experience_months":
            verified = actual >= float(years[1])
        elif method == "pattern":
            verified = sum((F.coalesce(h, F.lit(False)).cast("int") for h in hits), F.lit(0)) >= LEAST_SHARE * len(words) if words else F.lit(False)
        else:
            verified = matched.isNotNull()
        return F.struct(F.lit(requirement).alias("requirement"), F.lit(method).alias("method"), verified.alias("verified"), matched.alias("matched"))

    return df.select("*", F.inline(F.array(*[verdict(r) for r in asked])))


def checked(df: DataFrame, requirement: str, text: str, months: str, degrees: str | None = None, certifications: str | None = None) -> DataFrame:
    """``df`` with ``method``, ``verified`` and ``matched``: the first rule whose wording the requirement has decides.

    Rules in order: work authorisation, clearance, years of experience,
    licences (the one asked for, else the first of the array
    ``certifications`` that the text names), degrees (the first of the array
    ``degrees`` of that level, else the level's name in the text), and at last
    the requirement's own distinctive words, 60 % of which must occur. For a
    stated list of requirements :func:`verdicts` is far cheaper.
    """
    asked, body = F.lower(F.trim(F.col(requirement))), F.col(text)
    years = F.regexp_extract(asked, YEARS, 1)
    licence = first_term(asked, LICENCES)
    level = F.coalesce(*[F.when(asked.rlike(p), F.lit(n)) for n, p in DEGREES])
    held, certs = F.col(degrees) if degrees else None, F.col(certifications) if certifications else None
    degree = F.coalesce(*[F.when(level == n, F.coalesce(_first_held(held, lambda d, p=p: F.lower(d).rlike(p)), F.when(contains_term(body, F.lit(n)), F.lit(n)))) for n, p in DEGREES])
    words = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(F.col(requirement), F.lit(r"\b[A-Za-z][A-Za-z+#.-]{3,}\b"), F.lit(0)), F.lower)), lambda w: ~w.isin(*COMMON))
    rules = df.withColumns({"__years": years, "__licence": licence, "__level": level, "__words": F.slice(words, 1, 6)})
    is_licence = F.col("__licence").isNotNull() | asked.rlike(LICENCE_ASKED)
    method = F.when(asked.rlike(AUTHORISATION_ASKED) | asked.rlike(CLEARANCE_ASKED), "keyword").when(F.col("__years") != "", "experience_months").when(is_licence, "keyword").when(F.col("__level").isNotNull(), "education").otherwise("pattern")
    rules = rules.withColumn("method", method)
    found = F.when(F.col("method") == "pattern", F.filter(F.col("__words"), lambda w: contains_term(body, w)))
    rules = rules.withColumns({"__found": found, "__degree": degree})
    actual = F.floor(F.coalesce(F.col(months), F.lit(0)) / 12 * 10 + 0.5) / 10
    matched = (
        F.when(asked.rlike(AUTHORISATION_ASKED), first_term(body, AUTHORISATION))
        .when(asked.rlike(CLEARANCE_ASKED), first_term(body, CLEARANCE))
        .when(F.col("__years") != "", F.lit(None).cast("string"))
        .when(is_licence, F.coalesce(F.when(F.coalesce(contains_term(body, F.col("__licence")), F.lit(False)), F.col("__licence")), _first_held(certs, lambda n: contains_term(body, n))))
        .when(F.col("__level").isNotNull(), F.col("__degree"))
        .otherwise(F.get("__found", F.lit(0)))
    )
    rules = rules.withColumn("matched", matched)
    verified = (
        F.when(F.col("method") == "experience_months", actual >= F.col("__years").try_cast("double"))
        .when(F.col("method") == "pattern", (F.size("__words") > 0) & (F.size("__found") >= LEAST_SHARE * F.size("__words")))
        .otherwise(F.col("matched").isNotNull())
    )
    return rules.withColumn("verified", verified).drop("__years", "__licence", "__level", "__words", "__found", "__degree")


def evidence(lines: DataFrame, key: str, pos: str, text: str, terms: list[str], most: int = 2) -> DataFrame:
    """``(key, term, rank, pos, snippet)``: the first ``most`` lines of each key that hold each term, cut to a sentence."""
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: contains_term(F.col(text), t))
    found = lines.select(key, pos, text, F.explode(hits).alias("term"))
    order = Window.partitionBy(key, "term").orderBy(pos)
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.select(key, "term", "rank", pos, to_sentence(F.col(text)).alias("snippet"))
