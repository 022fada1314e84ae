"""Nested documents checked against their source, written as texts or as canonical JSON, and advice checked against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import appears, grounded
from ..functions.text import EDGE, normal_for_grounding, quoted_passages

#: Advice that is never given, in the order in which it is looked for.
FORBIDDEN = (
    ("add_skill_instruction", r"""(?i)\badd\s+["'“”]?[\w .+#/&-]{2,40}["'“”]?\s+(?:to|into)\s+your\s+(?:skills?|resume|cv|profile|list)"""),
    ("include_skill_instruction", r"""(?i)\binclude\s+["'“”]?[\w .+#/&-]{2,40}["'“”]?\s+(?:in|on|to)\s+your\s+(?:skills?|resume|cv|profile)"""),
    ("claim_skill_instruction", r"(?i)\b(?:claim|state|say|write|mention)\s+(?:that\s+)?you\s+(?:have|possess|know)\b"),
    ("score_gaming", r"(?i)\b(?:boost|increase|raise|improve|maximi[sz]e|inflate|jump)\b[^.\n]{0,30}\b(?:score|points?|rating|percentage|percent|%)\b"),
    ("points_or_percentage", r"(?i)\b\d+(?:\.\d+)?\s*(?:points?|(?:per\s?cent|%))\b"),
    ("keyword_stuffing", r"(?i)\b(?:stuff|stuffed|keyword\s+stuff(?:ing)?|cram|pad)\b[^.\n]{0,30}\b(?:keywords?|skills?|resume)\b"),
    ("fabrication", r"(?i)\b(?:fabricat\w*|exaggerat\w*|invent\w*|fake|lie|dishonest\w*)\b"),
    ("guarantee", r"(?i)\bguarantee\w*\b[^.\n]{0,40}\b(?:interview|job|offer|hire|screen\w*)\b"),
)
LEAST_ACTION = 40
#: What a warning says of a field whose value the source does not hold.
REASONS = {
    "contact.email": "Email address was not found verbatim in the document text.",
    "education.institution": "Institution was not found verbatim in the document text, so the entry was removed.",
    "education.degree": "Degree title was not found verbatim in the document text.",
    "experience.company": "Employer name was not found verbatim in the document text.",
    "certifications.name": "Certification was not found verbatim in the document text.",
}


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, at any depth, without blanks; null where it is no JSON. Equal values have equal texts."""
    return F.to_json(F.try_parse_json(text))


def content_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def cache_key(*parts: Column) -> Column:
    """The parts as texts with ``::`` between them, null as empty."""
    return F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def stands_in(value: Column, source: Column) -> Column:
    """Whether a name stands in a source, as :func:`appears` has it, or with another first name of the same initial."""
    words = F.filter(F.split(normal_for_grounding(value), " "), lambda w: F.length(w) > 1)
    surname, initial, s = F.element_at(words, -1), F.substring(F.get(words, F.lit(0)), 1, 1), normal_for_grounding(source)
    quoted = F.regexp_replace(surname, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit(EDGE), F.regexp_replace(initial, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"\w*\s+"), quoted)
    by_initial = F.when((F.size(words) >= 2) & (F.try_element_at(words, F.lit(-1)).isNotNull()), (F.length(surname) > 3) & F.contains(s, surname) & F.call_function("regexp_like", s, pattern)).otherwise(False)
    return appears(value, source) | F.coalesce(F.when(F.coalesce(value, F.lit("")) != "", by_initial), F.lit(False))


def validated(docs: DataFrame, source: str) -> DataFrame:
    """``docs`` without what their source does not hold, with ``warnings`` and ``validated``.

    ``contact.email`` becomes null; entries of ``education`` without a known
    institution go, a degree that is not found becomes null; ``company`` in
    ``experience`` becomes empty; ``certifications`` go. ``warnings`` has
    ``(field, value, reason)`` in this order. Null lists count as empty. Other
    fields and columns stay as they are.
    """
    body = F.col("__source")
    rows = docs.withColumn("__source", normal_for_grounding(F.coalesce(F.col(source), F.lit(""))))
    held = lambda v: stands_in(v, body)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(docs.schema[c].dataType))
    warning = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(REASONS[field]).alias("reason"))
    email = F.col("contact.email")
    bad_email = (F.coalesce(email, F.lit("")) != "") & ~held(email)
    known = F.filter(listed("education"), lambda e: held(e["institution"]))
    degree_fails = lambda e: (F.coalesce(e["degree"], F.lit("")) != "") & ~held(e["degree"])
    warnings = F.concat(
        F.array_compact(F.array(F.when(bad_email, warning("contact.email", email)))),
        F.transform(F.filter(listed("education"), lambda e: ~held(e["institution"])), lambda e: warning("education.institution", e["institution"])),
        F.transform(F.filter("__known", degree_fails), lambda e: warning("education.degree", e["degree"])),
        F.transform(F.filter(listed("experience"), lambda e: ~held(e["company"])), lambda e: warning("experience.company", e["company"])),
        F.transform(F.filter(listed("certifications"), lambda c: ~held(c["name"])), lambda c: warning("certifications.name", c["name"])),
    )
    rows = rows.withColumn("__known", known).withColumn("warnings", warnings)
    rebuilt = {
        "contact": F.when(F.col("contact").isNotNull(), F.col("contact").withField("email", F.when(~bad_email, email))),
        "education": F.transform("__known", lambda e: e.withField("degree", F.when(~degree_fails(e), e["degree"]))),
        "experience": F.transform(listed("experience"), lambda e: e.withField("company", F.when(held(e["company"]), e["company"]).otherwise(""))),
        "certifications": F.filter(listed("certifications"), lambda c: held(c["name"])),
    }
    return rows.withColumns(rebuilt).withColumn("validated", F.size("warnings") == 0).drop("__source", "__known")


def merged_notices(notices: DataFrame, key: str) -> DataFrame:
    """``(key, flagged, matches, documents)`` from ``notices (key, flagged, matches, document)``: sets over the flagged ones only, in order."""
    some = F.when(F.col("flagged"), F.col("matches"))
    rows = notices.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(some)))).alias("matches"), F.array_sort(F.collect_set(F.when(F.col("flagged"), F.col("document")))).alias("documents"))
    return rows.select(key, (F.size("matches") > 0).alias("flagged"), "matches", "documents")


def rejection(detection: Column, action: Column, assets: Column, excerpt: Column, posting: Column, resume: Column, known_excerpt: Column, known_assets: Column) -> Column:
    """Why advice is refused, null if it is not: the first check that fails.

    Forbidden wordings by family; an excerpt that is not in the posting; a
    quoted passage that is in neither text nor the known excerpt; an asset
    that is neither known nor in the resume; an action that is too short.
    """
    said = F.concat_ws("\n", F.coalesce(detection, F.lit("")), F.coalesce(action, F.lit("")), F.array_join(F.coalesce(assets, F.array().cast("array<string>")), ", "))
    families = [F.when(said.rlike(p), f"forbidden_pattern:{n}") for n, p in FORBIDDEN]
    loose = F.exists(quoted_passages(said), lambda q: ~(grounded(q, posting) | grounded(q, resume) | grounded(q, known_excerpt)))
    known, body = F.transform(F.coalesce(known_assets, F.array().cast("array<string>")), normal_for_grounding), normal_for_grounding(resume)
    foreign = F.exists(F.filter(F.transform(F.coalesce(assets, F.array().cast("array<string>")), normal_for_grounding), lambda a: F.length(a) >= 2), lambda a: ~F.array_contains(known, a) & ~F.contains(body, a))
    return F.coalesce(
        *families, F.when(~F.coalesce(grounded(excerpt, posting), F.lit(False)), "requirement_excerpt_not_grounded"), F.when(loose, "quoted_text_not_grounded"),
        F.when(foreign, "unverified_related_asset"), F.when(F.length(F.trim(F.coalesce(action, F.lit("")))) < LEAST_ACTION, "action_too_short"),
    )


def descendants(links: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """``(node, depth)``: what hangs from ``roots (node)`` along ``links (parent, node)``, roots included, each node once at its least depth.

    One equi-join for each level of the hierarchy; a node that is met again,
    in a circle as well, is not followed twice.
    """
    found = front = roots.select("node").distinct().withColumn("depth", F.lit(0))
    for level in range(1, levels + 1):
        near = front.select(F.col("node").alias("parent")).join(links, "parent").select("node").distinct()
        front = near.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        found = found.unionByName(front)
    return found


def deletion_keys(owned: DataFrame, sources: list[DataFrame], size: int = 100) -> DataFrame:
    """``(chunk, key)``: the keys that ``sources (node, key)`` hold for the nodes of ``owned``, as one set, in chunks of at most ``size``.

    Keys are dealt by hash to as many parts as are expected to be needed and
    numbered within each, so no part holds them all.
    """
    keys = None
    for source in sources:
        own = source.join(owned.select("node"), "node", "left_semi").select("key").where("key is not null and key <> ''")
        keys = own if keys is None else keys.unionByName(own)
    from pyspark.sql import Window

    rows = keys.distinct().withColumn("part", F.substring(F.sha2("key", 256), 1, 2))
    n = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return rows.select(F.concat_ws("-", "part", F.floor(n / size).cast("string")).alias("chunk"), "key")


def _fields(kind, names: list[str]) -> list[str]:
    """Those of the names that a struct type has, or the elements of an array of structs."""
    struct = getattr(kind, "elementType", kind)
    return [n for n in names if n in struct.names]


def flattened(docs: DataFrame) -> Column:
    """A nested document as one text: its statements in a stated order, under the usual headings, a line each; fields that are missing or empty leave nothing."""
    schema = docs.schema
    empty = F.array().cast("array<string>")

    def line(owner: Column, kind, names: list[str], between: str) -> Column:
        return F.concat_ws(between, *[F.nullif(owner[n].cast("string"), F.lit("")) for n in _fields(kind, names)])

    def many(name: str, parts) -> Column:
        if name not in docs.columns:
            return empty
        kind = schema[name].dataType
        return F.flatten(F.transform(F.coalesce(F.col(name), F.array().cast(kind)), lambda o: F.flatten(F.array(*[F.coalesce(p, empty) for p in parts(o, kind)]))))

    def lists(o: Column, kind, name: str) -> Column:
        return o[name] if name in _fields(kind, [name]) else empty

    def tools(o: Column, kind) -> Column:
        names = F.coalesce(lists(o, kind, "technologies_used"), empty)
        return F.when(F.size(names) > 0, F.array(F.concat(F.lit("Technologies: "), F.array_join(names, ", ")))).otherwise(empty)

    def heading(name: str, title: str) -> Column:
        return F.when(F.size(name) > 0, F.array(F.lit(title))).otherwise(empty) if name in docs.columns else empty

    parts = []
    if "summary" in docs.columns:
        parts.append(F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.array(F.lit("SUMMARY"), F.col("summary"))).otherwise(empty))
    if "contact" in docs.columns:
        parts.append(F.array(line(F.col("contact"), schema["contact"].dataType, ["email", "phone", "location", "linkedin_url", "github_url", "portfolio_url"], " | ")))
    parts += [heading(n, n.upper()) for n in ("experience", "projects", "education")]
    parts.append(many("education", lambda o, k: [F.array(line(o, k, ["degree", "field_of_study", "institution", "start_date", "end_date", "gpa"], ", ")), lists(o, k, "honors")]))
    parts.append(many("experience", lambda o, k: [F.array(line(o, k, ["title", "company", "location", "start_date", "end_date"], ", ")), lists(o, k, "bullet_points"), tools(o, k)]))
    parts.append(many("projects", lambda o, k: [F.array(line(o, k, ["title", "description", "link"], ", ")), lists(o, k, "bullet_points"), tools(o, k)]))
    if "skills" in docs.columns:
        own = F.concat(*[F.coalesce(F.col("skills")[n], empty) for n in _fields(schema["skills"].dataType, ["technical", "frameworks_and_tools", "soft_skills", "languages"])])
        listed = F.when(F.size(own) > 0, F.array(F.concat(F.lit("Skills: "), F.array_join(own, ", ")))).otherwise(empty)
        parts.append(F.when(F.size(own) > 0, F.array(F.lit("SKILLS"))).otherwise(empty))
    parts += [heading(n, n.upper()) for n in ("certifications", "achievements")]
    if "skills" in docs.columns:
        parts.append(listed)
    parts.append(many("certifications", lambda o, k: [F.array(line(o, k, ["name", "issuer", "date_obtained"], ", "))]))
    if "achievements" in docs.columns:
        parts.append(F.coalesce(F.col("achievements"), empty))
    return F.array_join(F.filter(F.concat(*parts), lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), "\n")
