"""Queries that assess whole documents: their dates and what their bullets tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numeric, privacy, requests, text
from ..operators import administration, quality, structure, summaries
from .catalogue import SYLLABLES
from .registry import query, read
from .reports import AMOUNT, OPENERS

NOW = 2000 * 12 + 5
FORMATS = ("yyyy-MM", "MM/yyyy", "MMM yyyy", "yyyy")


def _roles(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as roles; a fifth of them write dates in another style, and ends are open, missing, unreadable or before the start as well."""
    style = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 4).otherwise(F.col("o_custkey") % 4)
    written = lambda day: F.when(style == 0, F.date_format(day, FORMATS[0])).when(style == 1, F.date_format(day, FORMATS[1])).when(style == 2, F.date_format(day, FORMATS[2])).otherwise(F.date_format(day, FORMATS[3]))
    kind = F.when(F.col("o_orderkey") % 6 == 0, "education").otherwise("experience")
    ends = F.add_months(F.trunc("o_orderdate", "MM"), (F.col("o_orderkey") % 40 - 3).cast("int"))
    how = F.col("o_orderkey") % 7
    end = F.when(how == 0, "Present").when(how == 1, "").when(how == 2, "soon").otherwise(written(ends))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), kind.alias("kind"), F.col("o_orderkey").alias("pos"), written(F.col("o_orderdate")).alias("start_date"), end.alias("end_date"))


def _written(day: str) -> str:
    return f"CASE st WHEN 0 THEN strftime({day}, '%Y-%m') WHEN 1 THEN strftime({day}, '%m/%Y') WHEN 2 THEN strftime({day}, '%b %Y') ELSE strftime({day}, '%Y') END"


#: A range is split at its dashes, so dates written 2000-01 keep their year only.
STRUCTURE = f"""o AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_orderkey % 6 <> 0 AS job, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 ELSE o_custkey % 4 END AS st, o_orderkey % 7 AS how, o_orderdate AS d1, date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 40 - 3 AS INTEGER)) AS d2,
        year(o_orderdate) * 12 + month(o_orderdate) - 1 AS m1, year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 40 - 3 AS m2 FROM orders),
    p AS (SELECT doc_id, pos, {_written('d1')} || CASE how WHEN 0 THEN ' - Present' WHEN 1 THEN '' WHEN 2 THEN ' - soon' ELSE ' - ' || {_written('d2')} END AS w, CASE WHEN st IN (0, 3) OR how = 1 THEN m1 // 12 * 12 ELSE m1 END AS s,
        CASE WHEN how = 0 THEN {NOW} WHEN how = 2 OR how = 1 AND st = 0 THEN NULL WHEN how = 1 THEN m1 // 12 * 12 + 11 WHEN st IN (0, 3) THEN m2 // 12 * 12 ELSE m2 END AS e FROM o WHERE job),
    q AS (SELECT *, CASE WHEN e IS NULL THEN 'unparsed' WHEN e < s OR e - s + 1 > 600 OR s < 23400 OR e // 12 > {NOW} // 12 + 1 THEN 'invalid' ELSE 'ok' END AS status FROM p),
    k AS (SELECT doc_id, job, st, sum(1 + CAST(how <> 1 AS INTEGER)) AS n, sum(1 + CAST(how > 2 AS INTEGER)) AS known FROM o GROUP BY 1, 2, 3),
    x AS (SELECT doc_id, bool_or(bad) AS mixed FROM (SELECT doc_id, job, sum(n) >= 4 AND max(known) / CAST(sum(known) AS DOUBLE) < 0.8 AS bad FROM k GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT doc_id, count(*) FILTER (status = 'unparsed') AS unparsed, count(*) FILTER (status = 'invalid') AS invalid, coalesce(sum(e - s + 1) FILTER (status = 'ok'), 0) AS raw,
        coalesce(array_to_string((list(w ORDER BY pos) FILTER (status = 'unparsed'))[1:3], '; '), '') AS unparsed_ranges, coalesce(array_to_string((list(w ORDER BY pos) FILTER (status = 'invalid'))[1:3], '; '), '') AS invalid_ranges FROM q GROUP BY 1),
    g AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN bool_and(coalesce(s <= b, true)) END AS newest FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM q) GROUP BY 1),
    v AS (SELECT a.doc_id, count(*) AS met FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.e IS NOT NULL AND b.e IS NOT NULL AND least(a.e, b.e) - greatest(a.s, b.s) >= 1 GROUP BY 1),
    m AS (SELECT doc_id, count(DISTINCT mo) AS months FROM (SELECT doc_id, unnest(generate_series(s, e)) AS mo FROM q WHERE status = 'ok') GROUP BY 1),
    j AS (SELECT x.doc_id, mixed, newest, coalesce(met, 0) AS met, coalesce(unparsed, 0) AS unparsed, coalesce(invalid, 0) AS invalid, coalesce(months, 0) AS months, coalesce(raw, 0) - coalesce(months, 0) AS overlap_months, coalesce(unparsed_ranges, '') AS unparsed_ranges, coalesce(invalid_ranges, '') AS invalid_ranges
        FROM x LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN m USING (doc_id)),
    t AS (SELECT doc_id, mixed, coalesce(CAST(newest AS VARCHAR), 'too few') AS newest_first, CAST(met AS BIGINT) AS "overlaps", CAST(unparsed AS BIGINT) AS unparsed, CAST(invalid AS BIGINT) AS invalid, CAST(months AS BIGINT) AS months, CAST(overlap_months AS BIGINT) AS overlap_months, unparsed_ranges, invalid_ranges,
        greatest(0e0, 100e0 - CASE WHEN mixed THEN 15 ELSE 0 END - CASE WHEN newest THEN 0 WHEN newest IS NULL THEN 0 ELSE 15 END - least(15, 5 * met) - least(20, 5 * unparsed) - least(30, 10 * invalid)) AS structure_score,
        concat_ws(',', CASE WHEN mixed THEN 'mixed_dates' END, CASE WHEN NOT newest THEN 'not_newest_first' END, CASE WHEN met > 0 THEN 'overlaps' END, CASE WHEN unparsed > 0 THEN 'unparsed_ranges' END, CASE WHEN invalid > 0 THEN 'invalid_ranges' END) AS findings FROM j)"""


@query(f"WITH {STRUCTURE} SELECT * FROM t")
def structure_reports(spark, d):
    """Dates of each customer's orders as roles: their style, order, overlaps, and those that cannot be read or true."""
    told = structure.structure_report(_roles(spark, d), "doc_id", F.lit(NOW))
    joined = {c: F.array_join(c, "; ") for c in ("unparsed_ranges", "invalid_ranges")}
    return told.withColumns({**joined, "findings": F.array_join("findings", ","), "newest_first": F.coalesce(F.col("newest_first").cast("string"), F.lit("too few"))})


@query(rf"""WITH {STRUCTURE}, verbs(v) AS (VALUES {", ".join(f"('{v}')" for v in quality.VERBS)}),
    b1 AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?;]+\s+|\n+'), lambda z: trim(z)), lambda z: z <> '')) AS l FROM documents), b AS (SELECT doc_id, l, trim(regexp_replace(regexp_replace(lower(l), '^[\s•\-–—*·◦▪‣⁃]+', ''), '\s+', ' ', 'g')) AS o FROM b1),
    f AS (SELECT *, regexp_replace(string_split(o, ' ')[1], '[^a-z''-]', '', 'g') AS f, {AMOUNT} AS amount, regexp_extract_all(l, '[A-Za-z][A-Za-z''’\-]*') AS ws, len(list_filter(string_split_regex(regexp_replace(l, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), chr(1)), lambda z: regexp_matches(z, '[A-Za-z]'))) AS parts FROM b),
    h AS (SELECT doc_id, l, len(ws) AS words, parts, amount, {OPENERS} AS opener FROM f),
    y AS (SELECT doc_id, sum(n * ({SYLLABLES})) AS syllables FROM (SELECT doc_id, regexp_replace(lower(w), '[^a-z]', '', 'g') AS l, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM f) GROUP BY 1, 2) GROUP BY 1),
    u AS (SELECT doc_id, count(*) AS bullets, round(count(*) FILTER (opener = 'strong') / CAST(count(*) AS DOUBLE) * 100, 2) AS verb_density, count(*) FILTER (opener = 'passive') AS passive_openers, count(*) FILTER (amount) / CAST(count(*) AS DOUBLE) * 100 AS amounts, count(*) FILTER (words > 0) AS worded,
        coalesce(round(count(*) FILTER (words BETWEEN 12 AND 28) / CAST(nullif(count(*) FILTER (words > 0), 0) AS DOUBLE) * 100, 2), 0) AS length_fit, sum(length(l)) + 2 * (count(*) - 1) AS chars, sum(words) AS words, greatest(1, sum(parts)) AS sentences FROM h GROUP BY 1),
    z AS (SELECT coalesce(t.doc_id, u.doc_id) AS doc_id, coalesce(bullets, 0) AS bullets, coalesce(verb_density, 0) AS verb_density, coalesce(passive_openers, 0) AS passive_openers, coalesce(round(least(100e0, amounts * 2), 2), 0) AS achievements, coalesce(worded, 0) AS worded, coalesce(length_fit, 0) AS length_fit, coalesce(chars, 0) AS chars, coalesce(words, 0) AS words,
        sentences, coalesce(syllables, 0) AS syllables, coalesce(structure_score, 100) AS structure_score, findings FROM t FULL JOIN u USING (doc_id) LEFT JOIN y ON y.doc_id = u.doc_id),
    e AS (SELECT *, CASE WHEN words > 0 THEN floor((206.835e0 - 1.015e0 * words / sentences - 84.6e0 * syllables / words) * 10 + 0.5) / 10 ELSE 0 END AS ease, CASE WHEN words > 0 THEN floor(words / CAST(sentences AS DOUBLE) * 10 + 0.5) / 10 ELSE 0 END AS length FROM z),
    r AS (SELECT *, floor((2.220446049250313e-16 + CASE WHEN chars > 40 THEN greatest(0, least(100, 100 - abs(ease - 50) / 35e0 * 60)) ELSE 60 END) * 100 + 0.5) / 100 AS readability FROM e)
    SELECT doc_id, CAST(bullets AS BIGINT) AS bullets, structure_score, readability, ease, floor((0.4e0 * verb_density + 0.25e0 * structure_score + 0.2e0 * readability + 0.15e0 * length_fit + 2.220446049250313e-16) * 100 + 0.5) / 100 AS quality_score,
        concat_ws(',', nullif(findings, ''), CASE WHEN bullets > 0 AND verb_density < 60 THEN 'few_verbs' END, CASE WHEN passive_openers > 0 THEN 'passive_openers' END, CASE WHEN chars > 40 AND length > 34 THEN 'long_sentences' END, CASE WHEN worded > 0 AND length_fit < 60 THEN 'odd_lengths' END,
            CASE WHEN bullets > 0 AND achievements < 60 THEN 'few_amounts' END, CASE WHEN bullets = 0 THEN 'no_bullets' END) AS findings FROM r""")
def quality_reports(spark, d):
    """Quality of each document: sentences as bullets, and the orders of the customer of the same number as roles."""
    bullets = read(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("bullet"))
    told = structure.structure_report(_roles(spark, d), "doc_id", F.lit(NOW))
    report = structure.quality_report(bullets, told, "doc_id", "bullet")
    return report.select("doc_id", "bullets", "structure_score", "readability", "ease", "quality_score", F.array_join("findings", ",").alias("findings"))


# summaries --------------------------------------------------------------------------------------

USAGE = """count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, CAST(coalesce(sum(k) FILTER (event_type <> 'error'), 0) AS BIGINT) AS total_tokens, floor(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS error_rate,
    bool_and(event_type <> 'error') AS all_ok, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 4) AS total_ms"""


@query(f"""WITH e AS (SELECT coalesce(user_id, -1) AS user_id, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), p AS (SELECT user_id, string_agg(event_type || '=' || CAST(t AS VARCHAR), ',' ORDER BY event_type) AS by_purpose FROM (SELECT user_id, event_type, coalesce(sum(k) FILTER (event_type <> 'error'), 0)::BIGINT AS t FROM e GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, {USAGE}, any_value(by_purpose) AS by_purpose FROM e JOIN p USING (user_id) GROUP BY 1""")
def usage_by_user(spark, d):
    """Calls, failures, tokens by purpose and times of each user; users without a number are one."""
    events = read(spark, d, "events").select(F.coalesce("user_id", F.lit(-1)).alias("user_id"), "event_type", "value", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    told = summaries.usage(events, ["user_id"], "event_type", "k", "value", F.col("event_type") != "error")
    tokens = F.transform(F.map_entries("by_purpose"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return told.select("user_id", "calls", "failed", "total_tokens", "error_rate", "all_ok", F.round("total_ms", 4).alias("total_ms"), F.array_join(tokens, ",").alias("by_purpose"))


LIST = "CASE l_linenumber % 3 WHEN 1 THEN 'required' WHEN 2 THEN 'preferred' ELSE 'other' END"
CATEGORY = "CASE WHEN l_quantity >= 30 THEN 'EXACT' WHEN l_quantity >= 15 THEN 'PARTIAL' WHEN l_linenumber % 3 = 1 THEN 'MISSING_REQ' WHEN l_linenumber % 3 = 2 THEN 'MISSING_PREF' ELSE 'MENTIONED_WITHOUT_EVIDENCE' END"
CREDIT = "CASE WHEN l_quantity >= 30 THEN 1e0 WHEN l_quantity >= 22 THEN 0.65e0 WHEN l_quantity >= 15 THEN 0.25e0 ELSE 0e0 END"


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as matches: the first of three is required, the second preferred, the third another."""
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("item"), (F.col("l_linenumber") % 3).alias("l"), F.expr(CATEGORY).alias("category"), F.expr(CREDIT.replace("e0", "D")).alias("credit"))
    return summaries.matches_of(**{name: rows.where(F.col("l") == n).drop("l") for name, n in (("required", 1), ("preferred", 2), ("other", 0))})


CHECKS = "SELECT l_orderkey, 'Part ' || CAST(l_partkey AS VARCHAR) AS requirement, l_discount < 0.05 AS verified, l_linenumber AS pos FROM lineitem WHERE l_tax >= 0.05"


@query(f"""WITH m AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS item, {LIST} AS source, {CATEGORY} AS category, {CREDIT} AS credit FROM lineitem), c AS ({CHECKS})
    SELECT l_orderkey, item, category, source, CASE WHEN category = 'MISSING_REQ' OR source = 'required' THEN 'high' ELSE 'medium' END AS priority, 'match' AS detection FROM m WHERE category IN ('MISSING_REQ', 'MISSING_PREF', 'MENTIONED_WITHOUT_EVIDENCE') OR category = 'PARTIAL' AND credit < 0.5
    UNION ALL SELECT l_orderkey, requirement, 'MISSING_REQ', 'required', 'high', 'keyword' FROM c WHERE NOT coalesce(verified, false)""")
def gaps_and_unmet(spark, d):
    """Gaps of each order's matches, and its requirements that are not verified."""
    checks = read(spark, d, "lineitem").where("l_tax >= 0.05").select("l_orderkey", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("requirement"), (F.col("l_discount") < 0.05).alias("verified"), F.lit("keyword").alias("method"))
    return summaries.gaps_and_unmet(_matches(spark, d), checks, "l_orderkey")


@query(f"""WITH m AS (SELECT l_orderkey, {CATEGORY} AS category, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2), t AS (SELECT l_orderkey, string_agg(category || '=' || CAST(n AS VARCHAR), ',' ORDER BY category) AS counts FROM m GROUP BY 1), c AS ({CHECKS}),
    u AS (SELECT l_orderkey, count(*) FILTER (NOT coalesce(verified, false)) AS n, string_agg(requirement, '; ' ORDER BY pos, requirement) FILTER (NOT coalesce(verified, false)) AS names FROM c GROUP BY 1)
    SELECT o_orderkey, coalesce(counts, '') AS counts, CASE WHEN coalesce(n, 0) = 0 THEN '{summaries.ALL_MET}' ELSE CAST(n AS VARCHAR) || ' non-negotiable requirement(s) could not be verified: ' || names || '.' END AS summary FROM orders LEFT JOIN t ON t.l_orderkey = o_orderkey LEFT JOIN u ON u.l_orderkey = o_orderkey""")
def match_summary(spark, d):
    """For each order, its matches by category and what its requirements come to."""
    counts = summaries.category_counts(_matches(spark, d), "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    told = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    check = F.struct("l_linenumber", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("requirement"), (F.col("l_discount") < 0.05).alias("verified"))
    checks = read(spark, d, "lineitem").where("l_tax >= 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(check)).alias("checks"))  # an order has a few lines
    rows = read(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").join(checks, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce(told, F.lit("")).alias("counts"), summaries.checks_summary(F.col("checks")).alias("summary"))


OCR = r"""(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)),
    lambda z: regexp_replace(regexp_replace(z, '\s{2,}', '  ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g'))"""


@query(rf"""WITH x AS (SELECT doc_id, lang, source, replace(coalesce(text, ''), '. ', '-' || chr(10)) AS t FROM documents)
    SELECT doc_id, sha256({OCR}) AS ocr_sha256, CAST(doc_id % 9 + 1 AS VARCHAR) || '-' || regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') AS slug, sha256('<{text.FENCE}>' || chr(10) || t || chr(10) || '</{text.FENCE}>') AS fenced_sha256,
        CASE WHEN doc_id % 2 = 0 THEN 'A.' || lang || '.pdf' ELSE 'a.pdf' END AS file, left(t, 300) || CASE WHEN length(t) > 300 THEN '…' ELSE '' END AS logged FROM x""")
def text_utilities(spark, d):
    """Recognised texts made tidy, slugs, fences around texts, files' endings, values for logs."""
    t = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("-\n"))
    file = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A."), F.col("lang"), F.lit(".docx"))).otherwise("a.pdf")
    log = privacy.redacted_for_log(F.create_map(F.lit("text"), t, F.lit("user_Email"), F.col("source")))
    return read(spark, d, "documents").select(
        "doc_id", F.sha2(text.normal_ocr(t), 256).alias("ocr_sha256"), text.slug(F.col("doc_id") % 9 + 1, F.col("source")).alias("slug"), F.sha2(text.fenced(t), 256).alias("fenced_sha256"),
        text.with_extension(file, "pdf").alias("file"), log["text"].alias("logged"),
    )


@query("""SELECT o_orderkey, CASE (o_orderkey % 12) WHEN 0 THEN 'Jan' WHEN 1 THEN 'Feb' WHEN 2 THEN 'Mar' WHEN 3 THEN 'Apr' WHEN 4 THEN 'May' WHEN 5 THEN 'Jun' WHEN 6 THEN 'Jul' WHEN 7 THEN 'Aug' WHEN 8 THEN 'Sep' WHEN 9 THEN 'Oct' WHEN 10 THEN 'Nov' ELSE 'Dec' END || ' ' || CAST(o_orderkey // 12 AS VARCHAR) AS label,
    CASE WHEN s >= 0.82 THEN 'high' WHEN s >= 0.72 THEN 'medium' WHEN s >= 0.6 THEN 'low' ELSE 'none' END AS confidence, printf('%.3f', floor(s * 1000 + 0.5) / 1000) AS shown, CASE WHEN o_custkey % 4 = 0 THEN s * 100 ELSE 0.7e0 * (s * 100) + 0.3e0 * CAST(o_custkey % 101 AS DOUBLE) END AS blend,
    coalesce(o_orderstatus, '') IN ('O', '') AS is_current FROM (SELECT *, (o_orderkey % 1009) / 1009e0 AS s FROM orders)""")
def shown_values(spark, d):
    """Months, similarities and blends as they are shown; ends that are open."""
    s = (F.col("o_orderkey") % 1009) / F.lit(1009.0)
    end = F.when(F.col("o_orderstatus") == "O", "to date").when(F.col("o_orderstatus").isNotNull(), "Mar 2020")
    blend = numeric.skill_blend(s * 100, (F.col("o_custkey") % 101).cast("double"), F.col("o_custkey") % 4)
    return read(spark, d, "orders").select("o_orderkey", dates.month_label(F.col("o_orderkey")).alias("label"), numeric.confidence(s).alias("confidence"), numeric.shown_similarity(s).alias("shown"), blend.alias("blend"), dates.is_current(end).alias("is_current"))


# administration ---------------------------------------------------------------------------------


@query("""WITH a AS (SELECT c_mktsegment AS profile, least(100e0, o_totalprice / 5000) AS overall, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS parse, o_orderkey % 9000 AS ms FROM orders JOIN customer ON o_custkey = c_custkey),
    p AS (SELECT profile, count(*) AS n, round(avg(overall), 2) AS overall, round(avg(parse), 2) AS parse, round(avg(ms), 0) AS ms FROM a GROUP BY 1),
    e AS (SELECT user_id, event_type AS kind, ts, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events), l AS (SELECT max(ts) AS now, max(day) AS last FROM e),
    u AS (SELECT user_id, max(ts) AS seen FROM e WHERE user_id IS NOT NULL GROUP BY 1), d AS (SELECT CAST(last - CAST(g AS INTEGER) AS DATE) AS day FROM l, generate_series(0, 29) t(g)),
    c AS (SELECT d.day, count(*) FILTER (kind = 'signup') AS registrations, count(*) FILTER (kind = 'click') AS uploads, count(*) FILTER (kind = 'purchase') AS analyses FROM d LEFT JOIN e ON e.day = d.day GROUP BY 1),
    f AS (SELECT kind, day, count(*) AS n FROM e WHERE kind IN ('error', 'view') GROUP BY 1, 2 ORDER BY day DESC, n DESC, kind LIMIT 50),
    g AS (SELECT count(*) AS calls, sum(k) FILTER (kind = 'view') AS tokens, floor(avg(value) FILTER (kind = 'view') + 0.5) AS ms, floor(count(*) FILTER (kind = 'error') / CAST(count(*) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS rate FROM e WHERE kind IN ('view', 'error'))
    SELECT 'totals' AS section, 'users' AS name, CAST(count(*) AS DOUBLE) AS value FROM customer UNION ALL SELECT 'totals', 'suspended', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'totals', 'documents', count(*) FROM part WHERE p_size <= 40
    UNION ALL SELECT 'totals', 'analyses', sum(n) FROM p UNION ALL SELECT 'totals', 'avg_overall', round(sum(coalesce(overall, 0) * n) / sum(n), 2) FROM p UNION ALL SELECT 'totals', 'avg_parse', round(sum(coalesce(parse, 0) * n) / sum(n), 2) FROM p UNION ALL SELECT 'totals', 'avg_ms', round(round(sum(ms * n) / sum(n), 2), 0) FROM p
    UNION ALL SELECT 'totals', 'active_' || CAST(w AS VARCHAR), count(*) FILTER (seen >= now - to_days(CAST(w AS INTEGER))) FROM u, l, (VALUES (1), (7), (30)) v(w) GROUP BY w
    UNION ALL SELECT 'daily', strftime(day, '%Y-%m-%d') || ' registrations', registrations FROM c UNION ALL SELECT 'daily', strftime(day, '%Y-%m-%d') || ' uploads', uploads FROM c UNION ALL SELECT 'daily', strftime(day, '%Y-%m-%d') || ' analyses', analyses FROM c
    UNION ALL SELECT 'by_profile', profile || ' n', n FROM p UNION ALL SELECT 'by_profile', profile || ' overall', overall FROM p UNION ALL SELECT 'by_profile', profile || ' parse', parse FROM p UNION ALL SELECT 'by_profile', profile || ' ms', ms FROM p
    UNION ALL SELECT 'failures', kind || ' ' || strftime(day, '%Y-%m-%d') || ' count', n FROM f UNION ALL SELECT 'calls', 'calls', calls FROM g UNION ALL SELECT 'calls', 'tokens', tokens FROM g UNION ALL SELECT 'calls', 'avg_ms', ms FROM g UNION ALL SELECT 'calls', 'error_rate', rate FROM g""")
def platform_report(spark, d):
    """Customers as users, parts as documents, orders as analyses by market segment, events as what users and calls did."""
    users = read(spark, d, "customer").select((F.col("c_acctbal") < 0).alias("suspended"))
    documents = read(spark, d, "part").select((F.col("p_size") > 40).alias("deleted"))
    owners = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("profile"))
    parse = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 101).cast("double"))
    analyses = read(spark, d, "orders").join(owners, "o_custkey").select("profile", F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("overall"), parse.alias("parse"), (F.col("o_orderkey") % 9000).alias("ms"))
    events = read(spark, d, "events").select("user_id", F.col("event_type").alias("kind"), "ts", F.get_json_object("props", "$.k").try_cast("long").alias("tokens"), F.col("value").alias("ms"))
    kinds = {"registrations": "signup", "uploads": "click", "analyses": "purchase"}
    return administration.platform_report(users, documents, analyses, events, ["overall", "parse"], kinds, ["error", "view"], "view", "error")


@query("""WITH g AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'two' WHEN 2 THEN '1.5' ELSE CAST(c_custkey % 1300 AS VARCHAR) END AS page, CAST(c_custkey % 130 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '.0' ELSE '' END AS size, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 32) AS h, c_name AS action, c_acctbal FROM customer),
    v AS (SELECT *, TRY_CAST(page AS DOUBLE) AS p, CAST(size AS DOUBLE) AS s, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, CASE WHEN k % 3 = 0 THEN 11 ELSE 12 END) AS id FROM g),
    w AS (SELECT *, page IS NOT NULL AND NOT coalesce(p = floor(p) AND p BETWEEN 1 AND 1000, false) AS bad_page, s NOT BETWEEN 10 AND 100 AS bad_size, k % 3 = 0 AS bad_id, k % 7 = 0 AS bad_from FROM v)
    SELECT k AS c_custkey, CASE WHEN page IS NULL THEN 1 WHEN NOT bad_page THEN CAST(p AS BIGINT) ELSE -1 END AS page, CASE WHEN NOT bad_size THEN CAST(s AS BIGINT) ELSE -1 END AS page_size, CASE WHEN NOT bad_id THEN id ELSE '' END AS admin_user_id, action,
        concat_ws(',', CASE WHEN bad_page THEN 'page' END, CASE WHEN bad_size THEN 'page_size' END, CASE WHEN bad_id THEN 'admin_user_id' END, CASE WHEN bad_from THEN 'from' END) AS wrong, CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'active' END AS status FROM w""")
def audit_requests(spark, d):
    """A request for the audit page by each customer: values, and the parameters that are wrong."""
    k = F.col("c_custkey")
    page = F.when(k % 5 == 0, None).when(k % 5 == 1, "two").when(k % 5 == 2, "1.5").otherwise((k % 1300).cast("string"))
    size = F.concat((k % 130).cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))
    h = F.sha2(k.cast("string"), 256)
    last = F.when(k % 3 == 0, F.substring(h, 21, 11)).otherwise(F.substring(h, 21, 12))
    user = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), last)
    start = F.when(k % 7 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z")
    given = F.create_map(F.lit("page"), page, F.lit("page_size"), size, F.lit("action"), F.col("c_name"), F.lit("admin_user_id"), user, F.lit("from"), start)
    status = F.when(F.col("c_acctbal") < 0, "suspended").when(k % 2 == 0, "Suspended")
    rows = read(spark, d, "customer").select("c_custkey", requests.account_status(status).alias("status"), F.inline(F.array(requests.audit_parameters(given))))
    none = F.lit(-1).cast("long")
    return rows.select("c_custkey", F.coalesce("page", none).alias("page"), F.coalesce("page_size", none).alias("page_size"), F.coalesce("admin_user_id", F.lit("")).alias("admin_user_id"), "action", F.array_join("wrong", ",").alias("wrong"), "status")
