"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Native DataFrame functions only. Spark gives the matches of a pattern but not
their places, so a text is cut at the matches and the places are summed up
from the lengths of what lies between. The patterns use possessive
quantifiers and start only where a run starts, which changes no match and
keeps them linear in the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

#: Kinds in the order that breaks ties between spans with equal starts.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "aws_key", "secret")

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=(?:[0-9][\x20-]?){12})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+",
}
#: Words that, near a span, speak for its kind.
CONTEXT = {
    "email": "e-?mail|mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer|swift",
    "ssn": "ssn|social security|social-security",
    "aws_key": "aws|amazon|access|key|secret",
    "secret": "password|passwd|secret|token|api.?key|access.?key|private.?key|bearer|credential",
}
#: Score of a confirmed span without and with context, and the least score of a span that counts.
SCORES = {"email": (0.95, 1.0), "ip": (0.8, 0.95), "card": (0.9, 1.0), "phone": (0.8, 0.95), "iban": (0.9, 1.0), "ssn": (0.4, 0.9), "aws_key": (0.9, 1.0), "secret": (0.3, 0.9)}
LEAST_SCORE = 0.5
CONTEXT_CHARS = 40
PART = 256


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check; an empty one does not."""
    places = F.sequence(F.lit(1), F.length(number))
    back = F.reverse(number)
    doubled = F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.get(doubled, digit(i))).otherwise(digit(i)))
    return (F.length(number) > 0) & (F.when(F.length(number) > 0, total).otherwise(F.lit(1)) % 10 == 0)


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check (remainder 1)."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda s, c: ((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int")
    chars = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]?)"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits(found)).between(12, 19) & luhn(digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(found, " ", ""))
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _gate(kind: str, text: Column) -> Column:
    """A cheap test that every text with such a span passes."""
    if kind in ("email", "phone"):
        return text.contains("@" if kind == "email" else "+")
    if kind == "aws_key":
        return text.contains("AKIA") | text.contains("ASIA")
    if kind == "secret":  # without such a word its score is too low
        return text.rlike("(?i)" + CONTEXT["secret"])
    numbers = text.rlike("[0-9]")
    return numbers & text.rlike({"ssn": "[0-9]-[0-9]{2}-[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}[kind]) if kind in ("ssn", "iban") else numbers


def _pairs(kind: str, text: Column) -> Column:
    """Every match of the kind's pattern between what lies before and after it: ``array<struct<b, m, a>>``."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    after = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(between.alias("b"), matches.alias("m"), after.alias("a")), lambda p: p["m"].isNotNull())
    return F.when(_gate(kind, text), pairs)


def _located(pairs: Column) -> Column:
    """Matches with their places: ``array<struct<start, end, found, near>>``, ``near`` being what lies around.

    The text around reaches ``CONTEXT_CHARS`` to either side, but not past the next match.
    """
    nothing = "cast(array() as array<struct<start:bigint,end:bigint,found:string,near:string>>)"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        near = F.lower(F.concat(F.right(pair["b"], F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(pair["a"], F.lit(CONTEXT_CHARS))))
        one = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), pair["m"].alias("found"), near.alias("near"))
        return F.struct(end.cast("long").alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def some(low: Column) -> Column:
        # a long list is summed up in parts, as it is copied with every match that is added
        begin = F.aggregate(F.slice(pairs, F.lit(1), low), F.lit(0).cast("long"), lambda n, p: n + F.length(p["b"]) + F.length(p["m"]))
        return F.aggregate(F.slice(pairs, low + 1, F.lit(PART)), F.struct(begin.alias("at"), F.expr(nothing).alias("out")), step, lambda s: s["out"])

    located = F.flatten(F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(PART)), some))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, located).otherwise(F.expr(nothing))


def find_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """``docs`` with ``out_col array<struct<start, rank, kind, end, score>>``, ordered by start, then kind.

    Starts and ends are code points, ends exclusive. Base kinds count
    whenever their check passes; further kinds need ``LEAST_SCORE``, which
    some reach by the words around them only. Texts that are null or empty,
    and tables without rows, have no spans; repeated rows have theirs each. A
    column of ``docs`` named ``out_col`` is replaced; others are untouched.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    names = {kind: fresh(f"found_{kind}", docs) for kind in KINDS}
    # columns of their own, so that no pattern is run twice
    out = docs.withColumns({names[kind]: _pairs(kind, text) for kind in KINDS})
    out = out.withColumns({names[kind]: _located(F.col(names[kind])) for kind in KINDS})

    def judged(kind: str) -> Column:
        plain, near = SCORES[kind]
        score = lambda s: F.when(s["near"].rlike(CONTEXT[kind]), near).otherwise(plain)
        spans = F.filter(F.col(names[kind]), lambda s: _confirmed(kind, s["found"]))
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), score(s).alias("score")))
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)

    spans = F.array_sort(F.concat(*[judged(kind) for kind in KINDS]))
    return out.withColumn(out_col, spans).drop(*names.values())


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets.

    Overlapping spans become one, named after the first. Texts without spans,
    null and empty ones among them, stay as they are; all columns stay.
    """
    name = fresh("spans", docs)
    spanned, spans = find_spans(docs, text_col, name), F.col(name)
    text = col(text_col)

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        piece = F.concat(F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(piece))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    clean = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    return spanned.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(name)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text with their scores and number; one row per row of ``docs``."""
    rows = find_spans(docs.select(id_col, text_col), text_col)
    spans = F.col("pii_spans")
    of_rank = lambda rank: F.filter(spans, lambda s: s["rank"] == rank)
    counts = [F.size(of_rank(rank)).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE_KINDS)]
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    scores = F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")
    return rows.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), scores.alias("scores"), F.size(spans).cast("long").alias("n_spans"))
