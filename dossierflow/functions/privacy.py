"""Masking, neutralising instructions, and checks that a quotation is grounded. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, chain, normal_for_grounding

# Patterns of contact data, in the order in which they are replaced.
SOCIAL_URL = r"(?i)\b(?:https?://)?(?:www\.)?(?:linkedin\.com|github\.com|gitlab\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|behance\.net|dribbble\.com|medium\.com|stackoverflow\.com|angel\.co|crunchbase\.com)/[^\s,;)]*"
ADDRESS = r"(?i)\b\d{1,6}\s+(?:[A-Za-z0-9.'-]+\s){0,4}(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Road|Rd\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Way|Place|Pl\.?|Terrace|Ter\.?|Highway|Hwy\.?|Parkway|Pkwy\.?|Circle|Cir\.?|Suite|Ste\.?|Apt\.?|Unit)\b\.?"
PHONES = (
    r"\+\d{1,3}[\s.\-()]?\d{2,4}[\s.\-()]?\d{3,4}[\s.\-()]?\d{2,4}",
    r"\(?\b\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b",
    r"\b0\d{2,3}[\s.\-]\d{3,4}[\s.\-]\d{3,4}\b",
)
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
# Families of instruction-like wording.
INJECTIONS = {
    "ignore_previous_instructions": r"(?i)\bignore\s+(?:all\s+|any\s+)?(?:the\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instructions?|prompts?|rules?|directives?|commands?)",
    "disregard_above": r"(?i)\bdisregard\s+(?:the\s+|all\s+|any\s+)?(?:above|previous|prior|earlier|foregoing)\b[^.\n]{0,60}",
    "system_prompt_reference": r"(?i)\bsystem\s+(?:prompt|directive|instruction|instructions|message|role)s?\b",
    "role_override": r"(?i)\byou\s+are\s+now\b[^.\n]{0,60}",
    "admin_mode": r"(?i)\b(?:admin|administrator|root|developer|debug|god|sudo)\s+mode\b",
    "print_system_instructions": r"(?i)\b(?:print|show|reveal|display|output|repeat|echo)\s+(?:me\s+)?(?:the\s+|your\s+)?(?:system\s+|initial\s+|original\s+|full\s+|hidden\s+){0,2}(?:prompt|instructions?|directives?|rules?)\b",
    "api_key_probe": r"(?i)\b(?:api[\s_-]?key|secret[\s_-]?key|access[\s_-]?token|env(?:ironment)?\s+variables?)\b",
    "jailbreak": r"(?i)\b(?:jailbreak|jail\s+break|DAN\s+mode|do\s+anything\s+now)\b",
    "score_manipulation": r"(?i)\b(?:set|assign|force|override|change|inflate)\s+(?:the\s+)?(?:final\s+)?(?:score|scores|scoring|rating|ranking|result)\b[^.\n]{0,40}",
    "instruction_override": r"(?i)\b(?:override|ignore|bypass|skip)\b[^\n]{0,24}\b(?:system|scoring|score|rules?|guardrails?|filters?)\b",
    "unrestricted_persona": r"(?i)\b(?:act|behave|respond|answer)\s+as\s+(?:an?\s+)?(?:ai|a\.i\.|assistant|model|bot|chatbot)\b[^.\n]{0,60}|\bwith\s+no\s+(?:restrictions?|limitations?|filters?|rules?|guardrails?)\b",
    "output_format_override": r"(?i)\b(?:respond|reply|output|answer)\s+(?:only\s+)?(?:with|in)\s+(?:the\s+)?(?:following|this)\s+(?:format|json|text|way)\b[^.\n]{0,40}",
    "new_instructions": r"(?i)\bnew\s+(?:instructions?|rules?|system\s+prompt)\s*[:\-]",
    "schema_manipulation": r"(?i)\b(?:bypass|ignore|skip)\s+(?:the\s+)?(?:schema|validation|safety|guardrails?|filters?)\b",
    "tool_invocation": r"(?i)</?(?:untrusted_document_content|system|assistant|tool_use|function_calls?)>",
}
REDACTED, MARK = "[REDACTED]", "[redacted-instruction]"


def java_form(pattern: str) -> str:
    """The pattern for Java with the meaning that it has in SQL.

    Words end where ASCII letters, digits and underscores do (Java looks at all
    letters), a vertical tab is no blank, and where case is ignored ſ counts
    as s and the Kelvin sign as k.
    """
    fold = pattern.startswith("(?i)")

    def part(m: re.Match) -> str:
        t = m[0]
        if t.startswith("["):
            return ("[\u017f\u212a" if fold and "A-Z" in t else "[") + t[1:].replace(r"\s", r"\t\n\f\r ")
        ahead = r"(?=[0-9])(?<![A-Za-z0-9_])" if m.string[m.end() :].startswith((r"\d", "0")) else EDGE  # the same ahead of a digit, and sooner told
        of = {r"\b": ahead, r"\s": r"[\t\n\f\r ]"} | ({"s": "[s\u017f]", "k": "[k\u212a]"} if fold else {})
        return of.get(t if t.startswith("\\") else t.lower(), t)

    return re.sub(r"\\.|\[(?:\\.|[^\]])*\]|.", part, pattern)


def masked(text: Column, emails: bool = False) -> tuple[Column, dict[str, Column]]:
    """The text with contact data replaced, and how often each kind was found ahead of its own replacement."""
    social_url, address, email, *phones = map(java_form, (SOCIAL_URL, ADDRESS, EMAIL, *PHONES))
    bare = ~text.rlike("[0-9/@]")  # each pattern holds one of these, and no replacement does

    def count(*patterns: str) -> Column:
        return F.when(bare, 0).otherwise(sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0)))

    def put(what: str, *patterns: str) -> Column:
        return F.when(bare, text).otherwise(chain(text, *[(p, what) for p in patterns]))

    counts = {"social_url": count(social_url)}
    text = put("[REDACTED_PROFILE_URL]", social_url)
    counts["address"] = count(address)
    text = put("[REDACTED_ADDRESS]", address)
    counts["phone"] = count(*phones)
    text = put(REDACTED, *phones)
    if emails:
        counts["email"] = count(email)
        text = put(REDACTED, email)
    return text, counts


def neutralised(text: Column, most: int = 30_000) -> tuple[Column, Column]:
    """The text with instruction-like wording replaced, and the names of the families found in order.

    Runs of blanks and line ends are shortened. A longer text is cut at
    ``most`` characters, at a blank if one is near, marked, and named ``truncated``.
    """
    text = chain(text, ("[\u200b-\u200d\u2060\ufeff]", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "))
    found = []
    for name, pattern in INJECTIONS.items():
        found.append(F.when(text.rlike(pattern), F.lit(name)))
        text = F.regexp_replace(text, pattern, MARK)
    text = chain(text, (r"[ \t]{3,}", "  "), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+$", ""))
    cut = F.substring(text, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*)[\n ]", 1)
    cut = F.concat(F.when(F.length(whole) > most * 0.9, whole).otherwise(cut), F.lit("\n[content truncated]"))
    long = F.length(text) > most
    return F.when(long, cut).otherwise(text), F.array_compact(F.array(*found, F.when(long, F.lit("truncated"))))


def grounded(quote: Column, source: Column) -> Column:
    """The quotation occurs in the source, normal forms compared; or 92 % of its six or more words do."""
    q, s = normal_for_grounding(quote), normal_for_grounding(source)
    words = F.filter(F.split(q, " "), lambda w: F.length(w) > 1)
    missing = F.array_except(words, F.split(s, " "))  # once for each pair, not for each word
    held = F.size(words) - F.aggregate(missing, F.lit(0), lambda n, w: n + F.size(F.filter(words, lambda x: x == w)))
    return (F.length(q) >= 4) & (F.contains(s, q) | ((F.size(words) >= 6) & (held / F.size(words) >= 0.92)))


def mask_email(email: Column) -> Column:
    t = F.trim(email)
    local, domain = F.regexp_extract(t, "(?s)^(.+)@([^@]+)$", 1), F.regexp_extract(t, "(?s)^(.+)@([^@]+)$", 2)
    shown = F.least(F.lit(2), F.greatest(F.lit(1), F.length(local) - 1)).cast("int")
    full = F.concat(F.substring(local, F.lit(1), shown), F.lit("***@"), domain)
    return F.when(email.isNull() | (email == ""), "—").when(local == "", "***").otherwise(full)


def mask_phone(phone: Column) -> Column:
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) < 4, "•••").otherwise(F.concat(F.lit("•••-••"), F.substring(digits, -2, 2)))


def mask_secret(secret: Column, visible: int = 4) -> Column:
    """All but the last characters as up to eight dots."""
    dots = F.repeat(F.lit("•"), F.least(F.lit(8), F.length(secret) - visible))
    short = F.repeat(F.lit("•"), F.length(secret))
    return F.when(secret.isNull() | (secret == ""), "—").when(F.length(secret) <= visible, short).otherwise(F.concat(dots, F.right(secret, F.lit(visible))))


def mask_id(value: Column) -> Column:
    return F.when(value.isNull() | (value == ""), "—").when(F.length(value) < 12, "•••").otherwise(F.concat(F.substring(value, 1, 8), F.lit("…"), F.substring(value, -4, 4)))


def mask_ip(ip: Column) -> Column:
    v6, v4 = F.array_join(F.slice(F.split(ip, ":"), 1, 3), ":"), F.array_join(F.slice(F.split(ip, r"\."), 1, 3), ".")
    return F.when(ip.isNull() | (ip == ""), "—").when(ip.contains(":"), F.concat(v6, F.lit(":••••"))).when(F.size(F.split(ip, r"\.")) != 4, "•••").otherwise(F.concat(v4, F.lit(".••")))


#: Parts of keys that hint at personal data, and of keys that are never logged.
SENSITIVE = ("email", "phone", "address", "name", "linkedin", "github", "resume_text", "jd_text")


def safe_metadata(metadata: Column, most: int = 500) -> Column:
    """A string map without keys that hint at personal data, long values cut."""
    keep = F.map_filter(metadata, lambda k, v: ~F.lower(k).rlike("|".join(SENSITIVE)))
    return F.transform_values(keep, lambda k, v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v))


#: Parts of keys whose values are never logged.
UNLOGGED = ("password", "token", "apikey", "api_key", "authorization", "cookie", "secret", "email", "raw_text", "rawtext")


def redacted_for_log(context: Column, most: int = 300) -> Column:
    """A string map whose secrets are hidden by key, other long values cut."""
    return F.transform_values(context, lambda k, v: F.when(F.lower(k).rlike("|".join(UNLOGGED)), "[redacted]").when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("…"))).otherwise(v))


# Contact data that a machine can read.
READABLE_EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
READABLE_PHONES = (r"\+?\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{2,4}", r"\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}")


def readable_contacts(text: Column) -> tuple[Column, Column]:
    """Whether an e-mail address and whether a telephone number can be read."""
    return text.rlike(READABLE_EMAIL), text.rlike(READABLE_PHONES[0]) | text.rlike(READABLE_PHONES[1])


def excerpt_line(excerpt: Column, source: Column) -> Column:
    """Number of the first line, from 1, that holds the excerpt's first 120 characters, else its first six words; else null."""
    needle = F.substring(normal_for_grounding(excerpt), 1, 120)
    lines = F.transform(F.split(source, r"\r?\n"), normal_for_grounding)
    at = lambda what: F.array_position(F.transform(lines, lambda x: F.contains(x, what)), True)
    six = F.array_join(F.slice(F.split(needle, " "), 1, 6), " ")
    return F.when(needle != "", F.coalesce(F.nullif(at(needle), F.lit(0)), F.nullif(at(six), F.lit(0))))


def appears(value: Column, source: Column) -> Column:
    """Whether a name stands in a source: as it is, or with blanks and hyphens dropped if it has six letters or more."""
    q, s = normal_for_grounding(value), normal_for_grounding(source)
    tight, loose = F.regexp_replace(q, r"[\s-]+", ""), F.regexp_replace(s, r"[\s-]+", "")
    return F.when(value.isNull() | (value == ""), False).otherwise((F.length(q) < 2) | F.contains(s, q) | ((F.length(tight) >= 6) & F.contains(loose, tight)))
