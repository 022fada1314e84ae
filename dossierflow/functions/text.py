"""Texts: counts, readability, quality gates, HTML, normal forms. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[A-Za-z][A-Za-z'’\-]*"
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"  # of words of ASCII letters and digits; Java's own looks at all letters
ZERO_WIDTH = "[​-‍⁠﻿]"
#: Names of entities that are decoded, and what they become.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "-", "mdash": "-", "hellip": "...",
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "bull": "•", "middot": "·", "copy": "(c)", "reg": "(R)", "trade": "(TM)",
}
#: Section names and the headings that open them; the first three are the core.
SECTIONS = {
    "Experience": (r"^\s*(?:work|professional|relevant)?\s*(?:experience|employment|work history)\b", r"^\s*(?:employment|career)\s+history\b", r"^\s*experience\b"),
    "Education": (r"^\s*(?:education|academic background|academics|qualifications)\b", r"^\s*education\s*&?\s*training\b"),
    "Skills": (r"^\s*(?:skills|technical skills|core competencies|competencies|technologies|technical proficiencies)\b", r"^\s*(?:areas of expertise)\b"),
    "Summary": (r"^\s*(?:summary|professional summary|profile|objective|about me|career summary|overview)\b",),
    "Projects": (r"^\s*(?:projects|personal projects|selected projects|portfolio)\b",),
    "Certifications": (r"^\s*(?:certifications?|licenses?|certificates?|professional development)\b", r"^\s*(?:certifications?\s*(?:&|and)\s*licenses?)\b"),
    "Awards": (r"^\s*(?:awards?|honors?|honours?|achievements?|publications?)\b",),
}
CORE = ("Experience", "Education", "Skills")
#: Openings that tell of duties rather than deeds.
PASSIVE_OPENERS = (
    "responsible for", "responsible to", "was responsible for", "were responsible for", "duties included", "duty included", "tasked with", "worked on", "worked with",
    "helped with", "helped to", "assisted with", "assisted in", "involved in", "in charge of", "participated in", "part of a team", "part of the team", "was involved",
    "handled", "took part in", "in support of", "various duties", "familiar with", "exposure to",
)
#: Limits of extracted text that can be worked with.
LEAST_CHARS, LEAST_KNOWN, MOST_SPACE, MOST_UNBROKEN, MOST_GARBAGE, MOST_NONSENSE = 150, 0.6, 0.5, 200, 0.02, 0.35
#: Signs that a sentence tells an amount.
QUANTIFIED = (
    r"\d+(?:\.\d+)?\s?%",
    r"\$\s?\d[\d,.]*\s?(?:[kKmMbB]|million|billion|thousand)?",
    r"(?i)\b\d+(?:\.\d+)?\s?x\b",
    r"(?i)\b\d[\d,.]*\s?(?:users|customers|clients|accounts|requests|transactions|records|rows|documents|tickets|calls|leads|downloads|installs|signups|subscribers|employees|engineers|people|members|patients|students|hours|days|weeks|months|minutes|seconds|ms|milliseconds|tb|gb|pb|mb|kb|fps|qps|rps|rpm|tps)\b",
    r"(?i)\b(?:reduced|increased|improved|cut|grew|boosted|saved|accelerated|decreased)\b[^.\n]{0,40}\b\d",
    r"(?i)\b\d+(?:\.\d+)?\s?(?:percent|percentage points)\b",
)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def chain(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_sentences(text: Column) -> Column:
    """Parts between sentence ends that hold a word; one at least, but none in an empty text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.greatest(F.lit(1), worded_parts(text)))


def worded_parts(text: Column) -> Column:
    """Parts between sentence ends that hold a word. Of texts joined by a full stop and a blank, the sum of theirs."""
    return F.size(F.filter(F.split(text, r"[.!?]+(?=\s|$)"), lambda s: s.rlike("[A-Za-z]")))


def syllables(text: Column) -> Column:
    """Syllables of all words."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(0), lambda n, w: n + count_syllables(w))


def count_syllables(word: Column) -> Column:
    """Vowel groups after a silent ending; 1 for up to three letters, 0 without letters."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    bare = F.regexp_replace(letters, "(?:es|ed|(?<!l)e)$", "")
    return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiouy]+"))))


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(words > 0, 206.835 - 1.015 * words / sentences - 84.6 * syllables / words).otherwise(0.0)


def grade_level(words: Column, sentences: Column, syllables: Column) -> Column:
    return F.when(words > 0, 0.39 * words / sentences + 11.8 * syllables / words - 15.59).otherwise(0.0)


def readability_score(ease: Column) -> Column:
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.abs(ease - 50) / 35 * 60))
    return F.when(F.isnan(ease) | (F.abs(ease) == float("inf")), 0.0).otherwise(score)


def whitespace_ratio(text: Column) -> Column:
    return _share(text, r"\s")


def _share(text: Column, pattern: str) -> Column:
    """Share of the characters that match; 1 in an empty text."""
    return F.when(F.length(text) == 0, 1.0).otherwise(F.regexp_count(text, F.lit(pattern)) / F.length(text))


def longest_unbroken(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, r"\s+"), F.length))


ALLOWED = r"[\p{L}\p{N} \n\t.,;:!?'\"()\[\]{}\-_/\\|+&@#%*=<>~$•·–—’‘“”…★☆▪◦]"  # fixed values: letters, digits, usual punctuation
STANDARD = r"[\p{L}\p{N}\s.,;:!?'\"()\[\]{}\-–—_/\\|+&@#%*=<>.$~•·]"  # fixed values, likewise


def longest_garbage(text: Column) -> Column:
    """Length of the longest run of characters that no usual text holds."""
    return F.array_max(F.transform(F.split(text, ALLOWED, -1), F.length))


def garbage_ratio(text: Column) -> Column:
    """Share of replacement, private-use and geometric characters; 1 in an empty text."""
    return _share(text, r"[\uFFFD\uE000-\uF8FF\u25A0-\u25FF]")


def density(text: Column) -> Column:
    """Share of standard characters; 0 in an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(_share(text, STANDARD))


def nonsense_ratio(text: Column) -> Column:
    """Share of words of three or more letters with under 15 % vowels or six consonants in a row; 1 without words."""
    odd = lambda w: (F.regexp_count(w, F.lit("[aeiouAEIOU]")) / F.length(w) < 0.15) | w.rlike("(?i)[bcdfghjklmnpqrstvwxz]{6,}")
    share = lambda ws: F.when(F.size(ws) == 0, 1.0).otherwise(F.size(F.filter(ws, odd)) / F.size(ws))
    return bound(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)), share)


def alphabetic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'’\-]+"), F.lit(0))


def normal_token(token: Column) -> Column:
    """Without what is no letter at either end, and without a possessive."""
    return chain(F.lower(token), ("^[^a-z]+", ""), ("[^a-z'’]+$", ""), ("['’]s$", ""))


def word_stems(token: Column) -> Column:
    """The forms of a token that a dictionary is asked for: itself, and without s, es, ing, ed, ly."""

    def forms(t: Column) -> Column:
        ends = (("s", 1), ("es", 2), ("ing", 3), ("ed", 2), ("ly", 2))
        bare = [F.when(t.endswith(e), F.substring(t, F.lit(1), F.length(t) - n)) for e, n in ends]
        return F.when(F.length(t) >= 2, F.array_compact(F.array(t, *bare))).otherwise(F.array().cast("array<string>"))

    return bound(normal_token(token), forms)


def quality_reasons(chars: Column, known: Column, space: Column, unbroken: Column, garbage: Column, nonsense: Column) -> Column:
    """Names of the limits that a text fails; none means that it can be worked with."""
    failed = {
        "too_short": chars <= LEAST_CHARS, "unknown_words": known < LEAST_KNOWN, "whitespace": space > MOST_SPACE,
        "unbroken_run": unbroken > MOST_UNBROKEN, "garbage": garbage > MOST_GARBAGE, "nonsense": nonsense > MOST_NONSENSE,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]))


def opener(line: Column, verbs: tuple[str, ...]) -> Column:
    """How a bullet opens: ``passive``, ``strong`` (one of ``verbs``, also with s or es) or ``other``."""

    def is_strong(first: Column) -> Column:
        known = F.lit(False)
        for n, end in ((0, ""), (1, "s"), (2, "es")):
            known = known | (first.endswith(end) & F.substring(first, F.lit(1), F.length(first) - n).isin(*verbs))
        return known

    def kind(t: Column) -> Column:
        passive = reduce(lambda a, p: a | t.startswith(p), PASSIVE_OPENERS, F.lit(False))
        strong = bound(F.regexp_replace(F.get(F.split(t, " "), F.lit(0)), "[^a-z'-]", ""), is_strong)
        return F.when(t == "", "other").when(passive, "passive").when(strong, "strong").otherwise("other")

    return bound(F.trim(chain(F.lower(line), (r"^[\s•\-–—*·◦▪‣⁃]+", ""), (r"\s+", " "))), kind)


def sentences(text: Column) -> Column:
    """Trimmed parts between sentence ends and line ends, without empty ones."""
    return F.filter(F.transform(F.split(text, r"[.!?;]+\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def to_sentence(text: Column, most: int = 240) -> Column:
    """At most ``most`` characters: cut at the last sentence end beyond 80, else at the last blank, with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(t, 1, most)
    at = F.length(F.regexp_extract(cut, r"(?s)^(.*)[.;] ", 1))
    blank = F.length(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    short = F.when(at > 80, F.substring(cut, F.lit(1), at + 1)).when(blank > 0, F.substring(cut, F.lit(1), blank)).otherwise(cut)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(short, F.lit("…")))


def quoted_passages(text: Column) -> Column:
    """Passages of 12 or more characters in straight double, curly and single quotation marks, in this order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ('"([^"]{12,})"', "“([^”]{12,})”", "'([^']{12,})'")]
    return F.transform(F.concat(*found), lambda s: F.trim(s))


def replaced(text: Column, pattern: str, put) -> Column:
    """``text`` with each match of the pattern replaced by ``put(match)``."""

    def joined(t: Column) -> Column:
        parts = F.arrays_zip(F.split(t, pattern, -1).alias("part"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))
        return F.array_join(F.transform(parts, lambda p: F.concat(p["part"], F.when(p["found"].isNull(), "").otherwise(put(p["found"])))), "")

    return bound(text, joined)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def decode_entities(text: Column) -> Column:
    """Hexadecimal, then decimal, then named entities, each once; unknown names stay, impossible code points stay too."""
    point = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    number = lambda m, base: F.conv(F.regexp_extract(m, "([0-9a-fA-F]+);", 1), base, 10).try_cast("long")
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    steps = (
        ("&#x", "&#x[0-9a-fA-F]+;", lambda m: F.coalesce(point(number(m, 16)), m)),
        ("&#", "&#[0-9]+;", lambda m: F.coalesce(point(number(m, 10)), m)),
        ("&", "&[a-zA-Z]+;", lambda m: F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(m, "&([a-zA-Z]+);", 1))), m)),
    )
    for sign, pattern, put in steps:
        text = bound(text, _where(sign, pattern, put))
    return text


def _where(sign: str, pattern: str, put):
    """Texts without the sign stay as they are."""
    return lambda t: F.when(F.contains(t, F.lit(sign)), replaced(t, pattern, put)).otherwise(t)


ANCHOR = r'(?i)<a\b[^>]*href="([^"]*)"[^>]*>([\s\S]*?)</a>'


def html_to_text(html: Column) -> Column:
    """Anchors as ``text (url)``, whatever tags they hold; table rows between bars; items as ``- ``; blocks and breaks as line ends."""

    def link(anchor: Column) -> Column:
        label, url = F.trim(strip_tags(F.regexp_extract(anchor, ANCHOR, 2))), F.trim(decode_entities(F.regexp_extract(anchor, ANCHOR, 1)))
        shown = lambda s: F.when(s["url"] == "", s["label"]).when(s["label"] == "", s["url"]).otherwise(F.concat(s["label"], F.lit(" ("), s["url"], F.lit(")")))
        return bound(F.struct(label.alias("label"), url.alias("url")), shown)

    text = chain(
        replaced(html, ANCHOR, link),
        (r"(?i)<tr\b[^>]*>", "\n| "), (r"(?i)</tr>", " |"), (r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | "), (r"(?i)</?t(?:able|head|body|foot)\b[^>]*>", "\n"),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|li|section|article)>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "),
    )
    return chain(decode_entities(strip_tags(text)), ("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))


def normal_extracted(text: Column) -> Column:
    """Line ends, blanks, quotation marks, dashes, bullets and ligatures made alike, lines trimmed; apply NFKC beforehand where needed."""
    text = chain(
        text, (r"\r\n?", "\n"), ("\u00a0", " "), ("\ufb01", "fi"), ("\ufb02", "fl"), ("[\u2018\u2019\u201b\u2032]", "'"), ("[\u201c\u201d\u2033]", '"'),
        ("[\u2010\u2011\u2012\u2013\u2014\u2212]", "-"), ("[\u2022\u25cf\u25aa\u25e6\u2043\u2219]", "•"), ("[\u200b-\u200d\ufeff]", ""), (r"[ \t]+", " "),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="(https?://[^"]*)"'), F.lit(1)))


def normal_for_hash(text: Column) -> Column:
    """Line ends, zero-width characters, blanks and case made alike; apply NFC or NFKC beforehand where needed."""
    text = chain(text, (r"\r\n?", "\n"), (ZERO_WIDTH, ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"))
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def normal_for_repeats(line: Column) -> Column:
    return F.trim(chain(F.lower(line), ("[0-9]+", "#"), (r"[^a-z#\s]", ""), (r"\s+", " ")))


def normal_for_grounding(text: Column) -> Column:
    return F.trim(chain(F.lower(text), ("[‘’]", "'"), ("[“”]", '"'), ("[‐-―]", "-"), (r"\s+", " "), (r"[^\p{L}\p{N}\s'%$.,:;/()+-]", "")))


#: What is made alike in the names of skills, in this order.
SKILL_RULES = (
    (ZERO_WIDTH, ""), ("[\u2010-\u2015]", "-"), (r"c\+\+", "cpp"), ("c#", "csharp"), ("f#", "fsharp"), (r"\.net\b", "dotnet"), (r"node\.js", "nodejs"), (r"next\.js", "nextjs"), (r"vue\.js", "vuejs"),
    (r"react\.js", "reactjs"), (r"express\.js", "expressjs"), (r"socket\.io", "socketio"), (r"\.js\b", " "), (r"\.ts\b", " "), (r"\bv?\d+(\.\d+){0,3}\b", " "),
    (r"[()\[\]{}.,;:!?\"'`/\\|@#$%^&*_+=~<>]", " "), (r"\b([a-z]{3,})js\b", "$1"), (r"\s+", " "),
)


def normal_skill(name: Column) -> Column:
    """One spelling for the names of skills, null as empty; apply NFKC beforehand where needed."""
    return F.trim(chain(F.lower(F.trim(F.coalesce(name, F.lit("")))), *SKILL_RULES))


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term containment, case aside; blanks in the term match blanks or hyphens; terms of one character never match."""
    escaped = F.regexp_replace(F.regexp_replace(F.trim(term), r"([.*+?^${}()|\[\]\\])", r"\\$1"), r"\s+", r"[\\s\\-]+")
    pattern = F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])"), escaped, F.lit(r"([^\p{L}\p{N}]|$)"))
    first = F.contains(F.lower(text), F.lower(F.regexp_extract(F.trim(term), r"^\S+", 0)))  # far cheaper than the pattern, and true of every hit
    return (F.length(F.trim(term)) >= 2) & first & F.call_function("regexp_like", text, pattern)


def is_quantified(text: Column) -> Column:
    out = F.lit(False)
    for pattern in QUANTIFIED:
        out = out | text.rlike(pattern)
    return out


def looks_like_heading(line: Column) -> Column:
    t = F.trim(line)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    upper = F.length(F.regexp_replace(letters, "[^A-Z]", "")) / F.greatest(F.length(letters), F.lit(1))
    words = F.size(F.split(t, r"\s+"))
    return (words <= 8) & ~t.rlike(r"[.!?]$") & (F.length(letters) >= 3) & ((upper > 0.6) | t.rlike(r"^[A-Z][\w\s&/,'-]{2,60}:?$"))


def sections(text: Column) -> Column:
    """Names of the sections that a short line opens."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda x: (F.length(x) > 0) & (F.length(x) <= 60))
    found = []
    for name, patterns in SECTIONS.items():
        found.append(F.when(F.exists(lines, _matcher(patterns)), F.lit(name)))
    return F.array_compact(F.array(*found))


def _matcher(patterns: tuple[str, ...]):
    return lambda x: reduce(lambda a, b: a | b, [x.rlike("(?i)" + p) for p in patterns])


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def normal_ocr(text: Column) -> Column:
    """Recognised text: words that a line end divides are joined, blanks before line ends go, and no line has over two blanks together."""
    whole = chain(text, (r"\r\n?", "\n"), (r"([A-Za-z])-\n([a-z])", "$1$2"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    lines = F.transform(F.split(whole, "\n"), lambda s: chain(s, (r"\s{2,}", "  "), (r"^\s+|\s+$", "")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def slug(place: Column, name: Column) -> Column:
    """``3-apache-spark``: a place and a name in lower case, all but letters and digits as dashes."""
    return F.concat(place.cast("string"), F.lit("-"), F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"))


def title_label(name: Column) -> Column:
    """``Resume Uploaded`` from ``resume_uploaded``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


FENCE = "untrusted_document_content"  # fixed value


def fenced(text: Column) -> Column:
    """The text between an opening and a closing tag, which within it are made harmless."""
    start, end = f"<{FENCE}>", f"</{FENCE}>"
    inner = F.replace(F.replace(text, F.lit(start), F.lit(f"[[{FENCE}]]")), F.lit(end), F.lit(f"[[/{FENCE}]]"))
    return F.concat(F.lit(start + "\n"), inner, F.lit("\n" + end))


def with_extension(name: Column, extension: str) -> Column:
    """A file's name that ends as asked for; another ending of up to five letters or digits goes."""
    return F.when(F.lower(name).endswith(f".{extension}"), name).otherwise(F.concat(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), F.lit(f".{extension}")))
