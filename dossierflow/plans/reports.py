"""Further queries: administration, validation, requirements, quality, nested documents, layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric, privacy, text
from ..operators import documents, layout, quality, relational, requirements, scoring
from .registry import query, read

# administration ---------------------------------------------------------------------------------


@query("""WITH m AS (SELECT max(ts) AS now FROM events), o AS (SELECT count(*) AS orders, round(avg(o_totalprice), 2) AS avg_price FROM orders),
    e AS (SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT CASE WHEN ts >= now - INTERVAL 7 DAY THEN user_id END) AS active_7, round(avg(value), 0) AS mean_latency,
        CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens FROM events, m),
    t AS (SELECT string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS by_type FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1))
    SELECT (SELECT count(*) FROM customer) AS users, orders, avg_price, events, errors, round(errors / CAST(nullif(events, 0) AS DOUBLE), 4) AS error_rate, active_7, mean_latency, tokens, by_type,
           CASE WHEN errors * 2 > events THEN 'unhealthy' WHEN errors > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM o, e, t""")
def admin_metrics(spark, d):
    """One row of counts, rates, tallies and a health status; each table is read once and joined by single rows."""
    events = read(spark, d, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)))
    tally = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("seen"), F.sum("value").alias("v"), F.count("value").alias("nv"), F.sum("k").alias("k"))  # what all that follows is summed from
    now = tally.agg(F.max("seen").alias("now"))
    users = tally.crossJoin(F.broadcast(now)).where(F.col("seen") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).agg(F.count_distinct("user_id").alias("active_7"))
    errors = F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0))
    sums = tally.agg(F.sum("n").alias("events"), errors.alias("errors"), F.round(F.sum("v") / F.sum("nv"), 0).alias("mean_latency"), F.sum("k").alias("tokens"))
    kinds = tally.groupBy("event_type").agg(F.sum("n").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "n"))), ",").alias("by_type"))  # a row for each type
    orders = read(spark, d, "orders").agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    one = read(spark, d, "customer").agg(F.count("*").alias("users"))
    for part in (orders, sums, users, kinds):
        one = one.crossJoin(F.broadcast(part))  # one row each
    status = F.when(F.col("errors") * 2 > F.col("events"), "unhealthy").when(F.col("errors") > 0, "degraded").otherwise("healthy")
    return one.withColumns({"error_rate": F.round(F.col("errors") / F.nullif(F.col("events"), F.lit(0)), 4), "status": status})


@query("""WITH t AS (SELECT count(*) AS total FROM customer) SELECT c_custkey, total, CAST(greatest(1, ceil(total / 20.0)) AS BIGINT) AS total_pages FROM customer, t ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40""")
def page_with_total(spark, d):
    return relational.page_with_total(read(spark, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 20).select("c_custkey", "total", "total_pages")


@query("""SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey * 2, 'new', 1 FROM part WHERE p_partkey % 3 = 0 AND (p_partkey * 2) % 3 = 0 AND p_partkey % 2 = 1
    UNION ALL SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 3 = 0 AND NOT (p_partkey % 2 = 0 AND (p_partkey // 2) % 3 = 0 AND (p_partkey // 2) % 2 = 1 AND (p_partkey // 2) IN (SELECT p_partkey FROM part))""")
def upserted_parts(spark, d):
    """New rows win on equal keys."""
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 3 = 0 and p_partkey % 2 = 1").select((F.col("p_partkey") * 2).alias("p_partkey"), F.lit("new").alias("p_brand"), F.lit(1).alias("p_size"))
    return relational.upserted(part, new, ["p_partkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 0e0 ELSE c_acctbal END AS balance, coalesce(c_acctbal < 0, false) AS was_updated FROM customer")
def updated_customers(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return relational.updated(rows, F.col("balance") < 0, {"segment": F.lit("blocked"), "balance": F.lit(0.0)})


@query("""WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_totalprice AS median FROM r WHERE i = n // 2""")
def median_order_price(spark, d):
    return relational.median_by_index(read(spark, d, "orders"), "o_custkey", "o_totalprice")


@query("""SELECT p_partkey, p_name FROM part WHERE p_brand IS NOT NULL AND p_type LIKE '%A%' AND (contains(lower(p_name), 'a') OR p_size IS NULL)""")
def filtered_grid(spark, d):
    return relational.filtered(read(spark, d, "part"), [F.col("p_brand").isNotNull(), F.col("p_type").contains("A"), None, F.lower("p_name").contains("a") | F.col("p_size").isNull()]).select("p_partkey", "p_name")


NEEDLES = ("timeout", "error", "rate limit")


@query("""SELECT event_id, 400 + CAST(event_id % 130 AS INTEGER) AS status, 400 + event_id % 130 IN (408, 409, 429) OR 400 + event_id % 130 >= 500 OR regexp_matches(lower(event_type), 'timeout|error|rate limit') AS retry,
    coalesce(CAST(user_id AS VARCHAR), 'anonymous') AS limit_key FROM events""")
def retry_decisions(spark, d):
    """Which failures are tried again, and the key that a limit counts by."""
    status = (400 + F.col("event_id") % 130).cast("int")
    retry = status.isin(408, 409, 429) | (status >= 500) | F.lower("event_type").rlike("|".join(NEEDLES))
    return read(spark, d, "events").select("event_id", status.alias("status"), retry.alias("retry"), F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("limit_key"))


@query("""WITH x AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)
    SELECT conv_id, turn, concat_ws(';', CASE WHEN length(t) < 40 THEN 'text=too short' WHEN length(t) > 400 THEN 'text=too long' WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'text=no letters' END, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'role=unknown' END, CASE WHEN turn IS NULL OR turn < 1 THEN 'turn=too small' END) AS errors FROM x""")
def validation_report(spark, d):
    """The first failed rule of each field."""
    t = F.coalesce("text", F.lit(""))
    rules = [
        ("text", F.length(t) >= 40, "too short"), ("text", F.length(t) <= 400, "too long"), ("text", t.rlike("[A-Za-z]"), "no letters"),
        ("role", F.col("role").isin("user", "assistant"), "unknown"), ("turn", F.col("turn") >= 1, "too small"),
    ]
    entries = F.transform(F.map_entries(documents.first_errors(rules)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(entries, ";").alias("errors"))


@query("""SELECT c_custkey, left(c_name, 2) || '***@example.org' AS email, '•••-••' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS phone, '••••••••' || right(c_name, 4) AS secret, left(c_name, 8) || '…' || right(c_name, 4) AS id,
    CASE WHEN c_custkey % 2 = 0 THEN '10.0.' || CAST(c_nationkey AS VARCHAR) || '.••' ELSE '2001:db8:' || CAST(c_nationkey AS VARCHAR) || ':••••' END AS ip FROM customer""")
def masked_fields(spark, d):
    nation = F.col("c_nationkey").cast("string")
    ip = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("10.0."), nation, F.lit(".7"))).otherwise(F.concat(F.lit("2001:db8:"), nation, F.lit(":1:2:3")))
    phone = F.concat(F.lit("+1 (415) 5"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"))
    email = F.concat(F.lit(" "), F.col("c_name"), F.lit("@example.org "))
    return read(spark, d, "customer").select("c_custkey", privacy.mask_email(email).alias("email"), privacy.mask_phone(phone).alias("phone"), privacy.mask_secret(F.col("c_name")).alias("secret"), privacy.mask_id(F.col("c_name")).alias("id"), privacy.mask_ip(ip).alias("ip"))


@query("""SELECT o_orderkey, round(o_custkey / 12.0, 1)::DOUBLE AS years, strftime(o_orderdate, '%Y-%m') AS month, CAST(floor(least(100, o_totalprice / 5000) / 10) * 10 AS INTEGER) AS bucket, CAST(greatest(1, ceil(o_orderkey / 3000.0)) AS INTEGER) AS pages,
    CASE WHEN o_orderkey % 90000 < 1000 THEN CAST(o_orderkey % 90000 AS VARCHAR) || 'ms' WHEN o_orderkey % 90000 < 60000 THEN printf('%.1f', floor((o_orderkey % 90000) / 100.0 + 0.5) / 10) || 's' ELSE CAST((o_orderkey % 90000) // 60000 AS VARCHAR) || 'm' END AS took,
    o_orderpriority LIKE '%URGENT' OR o_orderstatus = 'O' AS is_current FROM orders""")
def formatted_values(spark, d):
    """Years, months, score buckets, page estimates, durations, and open ends told by null or by wording."""
    pages, _ = numeric.page_estimate(F.col("o_orderkey"), F.lit(0))
    return read(spark, d, "orders").select(
        "o_orderkey", dates.years(F.col("o_custkey")).alias("years"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), numeric.bucket(F.least(F.lit(100.0), F.col("o_totalprice") / 5000)).alias("bucket"),
        pages.alias("pages"), dates.duration(F.col("o_orderkey") % 90000).alias("took"), (F.col("o_orderpriority").endswith("URGENT") | (F.col("o_orderstatus") == "O")).alias("is_current"),
    )


# requirements and quality -----------------------------------------------------------------------

ASKED = (
    "Must be authorized to work: no visa sponsorship", "Active secret clearance", "5+ years of experience", "10 years in the field", "AWS certified engineer", "A licence of any kind",
    "Bachelor's degree in the field", "Experience with Apache Spark software", "Was of the best",
)


def _holds(terms: tuple[str, ...]) -> str:
    return "regexp_matches(t, '(^|[^\\p{L}\\p{N}])(" + "|".join(x.replace("/", "\\/").replace(" ", "[\\s\\-]+") for x in terms) + ")([^\\p{L}\\p{N}]|$)')"


REQUIRED = f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t, (doc_id * 7) % 150 AS months FROM documents),
    c AS (SELECT doc_id, months, {_holds(requirements.AUTHORISATION)} AS a, {_holds(requirements.CLEARANCE)} AS b, {_holds(('aws certified',))} AS l, {_holds(('bachelor',))} OR doc_id % 4 = 0 AS g, CASE doc_id % 3 WHEN 0 THEN {_holds(('license',))} WHEN 1 THEN {_holds(('best',))} ELSE {_holds(('experience',))} END AS h,
        (CAST({_holds(('experience',))} AS INTEGER) + CAST({_holds(('apache',))} AS INTEGER) + CAST({_holds(('spark',))} AS INTEGER) + CAST({_holds(('software',))} AS INTEGER)) >= 2.4 AS p, {_holds(('best',))} AS q FROM x),
    y AS (SELECT doc_id, floor(months / 12.0 * 10 + 0.5) / 10 AS years, a, b, l, g, h, p, q FROM c),
    r AS (SELECT unnest([{{'requirement': '{ASKED[0]}', 'method': 'keyword', 'verified': a}}, {{'requirement': '{ASKED[1]}', 'method': 'keyword', 'verified': b}}, {{'requirement': '{ASKED[2]}', 'method': 'experience_months', 'verified': years >= 5}},
        {{'requirement': '{ASKED[3]}', 'method': 'experience_months', 'verified': years >= 10}}, {{'requirement': '{ASKED[4]}', 'method': 'keyword', 'verified': l OR h}}, {{'requirement': '{ASKED[5]}', 'method': 'keyword', 'verified': h}},
        {{'requirement': '{ASKED[6].replace("'", "''")}', 'method': 'education', 'verified': g}}, {{'requirement': '{ASKED[7]}', 'method': 'pattern', 'verified': p}}, {{'requirement': '{ASKED[8]}', 'method': 'pattern', 'verified': q}}]) AS u FROM y)
    SELECT u.requirement AS requirement, u.method AS method, u.verified AS verified, count(*) AS n FROM r GROUP BY 1, 2, 3"""


@query(REQUIRED)
def hard_requirements(spark, d):
    """A stated list of requirements against every document, summed up by requirement and verdict."""
    names = F.array(F.lit("license"), F.lit("best"), F.lit("experience"))  # held certifications and degrees, by id
    docs = read(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("body"), ((F.col("doc_id") * 7) % 150).alias("months"), F.array(F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int"))).alias("certs"), F.array_compact(F.array(F.when(F.col("doc_id") % 4 == 0, "BSc in physics"))).alias("degrees"))
    return requirements.verdicts(docs, list(ASKED), "body", "months", "degrees", "certs").groupBy("requirement", "method", "verified").agg(F.count("*").alias("n"))


TERMS = ["license", "the", "contact"]


@query(r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS l FROM s),
    h AS (SELECT doc_id, pos, v.term FROM l, (VALUES ('license'), ('the'), ('contact')) v(term) WHERE regexp_matches(lower(l), '(^|[^\p{L}\p{N}])' || term || '([^\p{L}\p{N}]|$)'))
    SELECT doc_id, term, CAST(rank AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY pos) AS rank FROM h) WHERE rank <= 2""")
def term_evidence(spark, d):
    """The first two lines of each document that hold each of some terms."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return requirements.evidence(lines, "doc_id", "pos", "line", TERMS).select("doc_id", "term", "rank", "pos")


def _bullets(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


OPENERS = "CASE " + "WHEN " + " OR ".join(f"starts_with(o, '{p}')" for p in text.PASSIVE_OPENERS) + " THEN 'passive' WHEN f IN (SELECT v FROM verbs) OR (f LIKE '%s' AND left(f, length(f) - 1) IN (SELECT v FROM verbs)) OR (f LIKE '%es' AND left(f, length(f) - 2) IN (SELECT v FROM verbs)) THEN 'strong' ELSE 'other' END"
AMOUNT = "(" + " OR ".join("regexp_matches(l, '" + p.replace("'", "''") + "')" for p in text.QUANTIFIED) + ")"


@query(rf"""WITH verbs(v) AS (VALUES {", ".join(f"('{v}')" for v in quality.VERBS)}), s AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents), b AS (SELECT doc_id, l, trim(regexp_replace(regexp_replace(lower(l), '^[\s•\-–—*·◦▪‣⁃]+', ''), '\s+', ' ', 'g')) AS o FROM s WHERE l <> ''),
    f AS (SELECT *, regexp_replace(string_split(o, ' ')[1], '[^a-z''-]', '', 'g') AS f, {AMOUNT} AS amount, len(regexp_extract_all(l, '[A-Za-z][A-Za-z''’\-]*')) AS words FROM b), k AS (SELECT *, {OPENERS} AS opener FROM f)
    SELECT doc_id, count(*) AS bullets, round(count(*) FILTER (opener = 'strong') / CAST(count(*) AS DOUBLE) * 100, 2) AS verb_density, count(*) FILTER (opener = 'passive') AS passive_openers, round(count(*) FILTER (amount) / CAST(count(*) AS DOUBLE) * 100, 2) AS quantified_ratio,
        round(least(100e0, count(*) FILTER (amount) / CAST(count(*) AS DOUBLE) * 100 * 2), 2) AS achievements, coalesce(round(sum(words) / CAST(nullif(count(*) FILTER (words > 0), 0) AS DOUBLE), 1), 0) AS avg_words, coalesce(min(words) FILTER (words > 0), 0) AS min_words, max(words) AS max_words,
        coalesce(round(count(*) FILTER (words BETWEEN 12 AND 28) / CAST(nullif(count(*) FILTER (words > 0), 0) AS DOUBLE) * 100, 2), 0) AS length_fit FROM k GROUP BY 1""")
def opener_and_quantified(spark, d):
    """Lines as bullets: openers, amounts and lengths of each document."""
    return quality.bullet_report(_bullets(spark, d), "doc_id", "line")


def _line_of(patterns: tuple[str, ...]) -> str:
    return "len(list_filter(ls, lambda l: " + " OR ".join(f"regexp_matches(l, '(?i){p}')" for p in patterns) + ")) > 0"


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda l: trim(l)), lambda l: length(l) BETWEEN 1 AND 60) AS ls FROM documents),
    c AS (SELECT doc_id, t, """ + " + ".join(f"CAST({_line_of(p)} AS INTEGER)" for n, p in text.SECTIONS.items() if n in text.CORE) + " AS core, " + " + ".join(f"CAST({_line_of(p)} AS INTEGER)" for n, p in text.SECTIONS.items() if n not in text.CORE) + r""" AS other,
        regexp_matches(t, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}') AS email, regexp_matches(t, '\+?\d{1,3}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{2,4}') OR regexp_matches(t, '\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}') AS phone FROM s),
    v AS (SELECT doc_id, core / 3e0 * 0.85 + least(other, 3) / 3e0 * 0.15 AS a, greatest(0, least(1, 1 - least(0.35e0, (doc_id % 3) * 0.2) - least(0.3e0, (doc_id % 2) * 0.1) - least(0.3e0, (doc_id % 5) / 2e0 * 0.15))) AS b, CASE WHEN email THEN 0.5 ELSE 0 END + CASE WHEN phone THEN 0.5 ELSE 0 END AS e FROM c)
    SELECT doc_id, round(a * 0.3 + b * 0.25 + e * 0.1, 6) AS parse_parts FROM v""")
def parse_checks(spark, d):
    """Headings, layout and contact data of each document, weighted."""
    body = F.coalesce("text", F.lit(""))
    i = F.col("doc_id")
    checks = quality.parse_checks(body, i % 3, i % 2, i % 5, F.lit(2), F.lit(0), F.lit(0), F.lit(0))
    a, b, _, _, e = [numeric.clamp(c, 0, 1) * w for c, w in checks]
    return read(spark, d, "documents").select("doc_id", F.round(a + b + e, 6).alias("parse_parts"))


@query()
def parse_scores(spark, d):
    """All five checks as one score; the share of standard characters has no SQL here."""
    body = F.coalesce("text", F.lit(""))
    i = F.col("doc_id")
    return read(spark, d, "documents").select("doc_id", quality.parse_score(quality.parse_checks(body, i % 3, i % 2, i % 5, F.lit(2), F.lit(0), i % 4, i % 2)).alias("score"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS months, list(round(o_totalprice / 600000, 6)) AS sims, coalesce(list(round(o_totalprice / 450000, 6)) FILTER (o_orderstatus = 'O'), []) AS projects FROM orders GROUP BY 1),
    l AS (SELECT o_custkey, months, sims, projects, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 5 - 1 END AS least FROM o),
    k AS (SELECT o_custkey, months, least, list_sort(list_filter(CASE WHEN coalesce(least <= 1, false) THEN list_concat(sims, projects) ELSE sims END, lambda x: x > 0), 'DESC') AS pos FROM l),
    r AS (SELECT *, CASE WHEN least IS NULL THEN CASE WHEN months > 0 THEN 70 ELSE 50 END WHEN least <= 0 OR months / 12e0 / least >= 1 THEN 100 ELSE greatest(30, months / 12e0 / least * 100) END AS years, list_avg(pos[1:CAST(greatest(1, ceil(len(pos) / 2e0)) AS BIGINT)]) AS m FROM k)
    SELECT o_custkey, round(years, 6) AS years_score, coalesce(least <= 1, false) AS entry_level, round(0.35 * years + 0.65 * CASE WHEN m IS NULL THEN 70 WHEN m >= 0.82 THEN 100 WHEN m >= 0.72 THEN 65 WHEN m >= 0.6 THEN 25 ELSE 0 END, 2) AS score FROM r""")
def experience_report(spark, d):
    """Years against what is asked for, relevance of the better half, and whether a posting is for beginners."""
    orders = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("months"), F.collect_list(F.round(F.col("o_totalprice") / 600000, 6)).alias("sims"), F.collect_list(F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") / 450000, 6))).alias("projects"))
    least = F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 5 - 1).cast("double"))
    level = quality.entry_level(F.lit(None).cast("string"), least, F.lit(None).cast("string"))
    return orders.select("o_custkey", F.round(numeric.years_score(F.col("months"), least), 6).alias("years_score"), level.alias("entry_level"), quality.experience_score(F.col("months"), least, F.col("sims"), F.col("projects"), level).alias("score"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_discount * 1000 AS b FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, unnest([{'component': 'a', 'score': least(100e0, a), 'weight': 0.2e0}, {'component': 'b', 'score': least(100e0, b), 'weight': 0.15e0}]) AS u FROM x) "
       "SELECT l_orderkey, l_linenumber, u.component AS component, u.score AS score, u.weight AS weight, floor((u.score * u.weight + sign(u.score) * 2.220446049250313e-16) * 100e0 + 0.5e0) / 100e0 AS weighted FROM r")  # fmt: skip
def component_breakdown(spark, d):
    """A row for each part of a score, here the first two of a profile."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("a"), (F.col("l_discount") * 1000).alias("b"))
    return scoring.component_rows(rows, ["l_orderkey", "l_linenumber"], ["a", "b"], scoring.WEIGHTS["product_manager"][:2])


# nested documents -------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS f, list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F') AS g FROM orders GROUP BY 1),
    n AS (SELECT o_custkey, coalesce(f, []) AS f, coalesce(g, []) AS g FROM o)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(f)), ',') AS required, array_to_string(list_sort(list_distinct(list_filter(g, lambda x: NOT list_contains(f, x)))), ',') AS preferred_only, len(list_distinct(list_concat(f, g))) AS either FROM n""")
def ordered_set_ops(spark, d):
    """Distinct values, what only the second list has, and the union, by normal form."""
    norm = lambda v: F.lower(F.trim(v))
    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("o_orderkey", "o_orderpriority")))), lambda s: s["o_orderpriority"])
    o = read(spark, d, "orders").groupBy("o_custkey").agg(lists(F.col("o_orderstatus") == "F").alias("f"), lists(F.col("o_orderstatus") != "F").alias("g"))
    sorted_ = lambda c: F.array_join(F.array_sort(c), ",")
    only = documents.distinct_by(documents.difference_by(F.col("g"), F.col("f"), norm), norm)
    return o.select("o_custkey", sorted_(documents.distinct_by(F.col("f"), norm)).alias("required"), sorted_(only).alias("preferred_only"), F.size(documents.distinct_trimmed(F.concat("f", "g"))).alias("either"))


@query("""WITH l AS (SELECT l_orderkey, list(coalesce(nullif(trim(CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag || l_linenumber END), ''), '') ORDER BY l_linenumber, l_partkey, l_returnflag) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_filter(b, lambda x: x <> ''), ',') AS bullets FROM l""")
def flattened_bullets(spark, d):
    """The texts of all nested children in order, trimmed, without empty ones."""
    line = F.when(F.col("l_linenumber") % 3 == 0, " ").otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit(" ")))
    jobs = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.array(line).alias("bullet_points")))).alias("jobs"))
    return jobs.select("l_orderkey", F.array_join(documents.flat_texts(F.col("jobs"), "bullet_points"), ",").alias("bullets"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' AS json, coalesce(json_extract_string(props, '$.k'), '0') AS k, 'none' AS missing, split_part('events/' || event_type || '/' || CAST(event_id AS VARCHAR), '/', 2) AS folder FROM events""")
def property_documents(spark, d):
    """JSON maps cleaned, with defaults, in one order of keys; values by name with a fallback; path segments."""
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"), F.lit("blank"), F.lit(" ")))
    filled = documents.with_defaults(fields, {"missing": "none"})
    entries = F.transform(F.map_entries(filled), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    path = F.concat_ws("/", F.lit("events"), "event_type", "event_id")
    return read(spark, d, "events").select(
        "event_id", documents.stable_json(documents.without_empty(fields)).alias("json"), documents.named(entries, "k", "value", F.lit("0")).alias("k"),
        F.try_element_at(filled, F.lit("missing")).alias("missing"), F.get(F.split(path, "/"), F.lit(1)).alias("folder"),
    )


@query("""WITH t AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL), m AS (SELECT key FROM t WHERE key NOT IN (SELECT key FROM s))
    SELECT key, left(key, 2) AS bucket, CAST((row_number() OVER (PARTITION BY left(key, 2) ORDER BY key) - 1) // 96 AS BIGINT) AS batch FROM m""")
def embedding_batches(spark, d):
    """Distinct texts that have no stored vector yet, in batches of 96 within buckets of their hash."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    missing = docs.select("key").distinct().join(docs.where("doc_id % 3 = 0").select("key"), "key", "left_anti")
    return relational.chunked(missing.withColumn("bucket", F.substring("key", 1, 2)), "bucket", "key", 96).select("key", "bucket", F.col("chunk").alias("batch"))


# texts and layout -------------------------------------------------------------------------------


@query(r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, len(list_filter(list_transform(string_split_regex(t, '[.!?;]+\s+|\n+'), lambda s: trim(s)), lambda s: s <> '')) AS sentences,
        len(regexp_extract_all(t, '"([^"]{12,})"')) + len(regexp_extract_all(t, '“([^”]{12,})”')) + len(regexp_extract_all(t, '''([^'']{12,})''')) AS quotations, len(regexp_extract_all(lower(t), '[a-z][a-z''’\-]+')) AS tokens,
        sha256(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS normal FROM
        (SELECT doc_id, t FROM x WHERE NOT regexp_matches(t, '[^\x00-\x7F]'))""")
def text_forms(spark, d):
    """Sentences, quotations, tokens and the normal form of every ASCII text."""
    t = F.coalesce("text", F.lit(""))
    docs = read(spark, d, "documents").where(~t.rlike(r"[^\x00-\x7F]"))
    return docs.select("doc_id", F.size(text.sentences(t)).alias("sentences"), F.size(text.quoted_passages(t)).alias("quotations"), F.size(text.alphabetic_tokens(t)).alias("tokens"), F.sha2(text.normal_extracted(t), 256).alias("normal"))


@query("""SELECT event_id, CAST(round(0.299 * (event_id % 256) + 0.587 * (event_id * 7 % 256) + 0.114 * (event_id * 13 % 256)) AS INTEGER) AS grey, round(0.299 * (event_id % 256) + 0.587 * (event_id * 7 % 256) + 0.114 * (event_id * 13 % 256)) >= 128 AS white FROM events""")
def binarised_pixels(spark, d):
    grey = layout.luma(F.col("event_id") % 256, F.col("event_id") * 7 % 256, F.col("event_id") * 13 % 256)
    return read(spark, d, "events").select("event_id", grey.alias("grey"), (grey >= 128).alias("white"))


@query("""WITH i AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_partkey, (l_partkey % 500) * 1e0 AS x, (700 - l_linenumber * 12) * 1e0 AS y, CASE WHEN l_linenumber = 1 THEN 400e0 ELSE 20e0 END AS width FROM lineitem),
    s AS (SELECT *, CASE WHEN x < 248 AND x + width > 252 THEN 'spanning' WHEN x >= 248 THEN 'right' ELSE 'left' END AS side FROM i)
    SELECT doc, page, side, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY CASE side WHEN 'spanning' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, y DESC, x, CAST(l_partkey AS VARCHAR)) AS INTEGER) AS place, CAST(l_partkey AS VARCHAR) AS text FROM s""")
def reading_order(spark, d):
    """Items of each page: what spans the columns, then the left, then the right column."""
    width = F.when(F.col("l_linenumber") == 1, 400.0).otherwise(20.0)
    items = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_partkey") % 500).cast("double").alias("x"), (700 - F.col("l_linenumber") * 12).cast("double").alias("y"), width.alias("width"))
    return layout.in_reading_order(items, F.lit(250.0)).select("doc", "page", "side", "place", "text")


def _items(spark, d):
    """Items on pages of 600 by 800: two columns on even pages, a line of four items in each row on the others."""
    two = F.when(F.col("l_linenumber") % 2 == 0, 330).otherwise(50) + F.col("l_partkey") % 5
    x = F.when(F.col("l_orderkey") % 2 == 0, two).otherwise(F.col("l_partkey") % 500).cast("double")
    y = (F.floor(F.col("l_orderkey") / 20) % 60 * 12).cast("double")
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 20).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", F.lit(" page "), "l_linenumber").alias("text"), x.alias("x"), y.alias("y"), F.lit(100.0).alias("width"), F.lit(10.0).alias("height"))


def _sizes(items):
    return items.select("doc", "page").distinct().select("doc", "page", F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


ITEMS = """SELECT l_suppkey AS doc, l_orderkey % 20 AS page, l_orderkey * 10 + l_linenumber AS pos, l_returnflag || ' page ' || CAST(l_linenumber AS VARCHAR) AS text,
    CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 330 ELSE 50 END + l_partkey % 5 ELSE l_partkey % 500 END * 1e0 AS x, (l_orderkey // 20) % 60 * 12e0 AS y FROM lineitem"""


@query()
def page_columns(spark, d):
    """The split of every page of two columns."""
    items = _items(spark, d)
    return layout.column_split(items, _sizes(items))


@query(rf"""WITH i AS ({ITEMS}), k AS (SELECT *, CASE WHEN y >= 800 * 0.92e0 OR y <= 800 * 0.08e0 THEN trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^a-z#\s]', '', 'g')) END AS key FROM i),
    r AS (SELECT doc, key FROM k WHERE length(key) >= 3 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2)
    SELECT doc, page, pos FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = k.doc AND r.key = k.key)""")
def lines_without_headers(spark, d):
    """What is left of every page without its repeating headers and footers."""
    lines = _items(spark, d)
    return layout.strip_repeated(lines, _sizes(lines)).select("doc", "page", "pos")


@query(f"""WITH i AS ({ITEMS}), l AS (SELECT doc, page, pos AS nr, 'https://example.org/' || CAST(pos AS VARCHAR) AS url, x + 40 AS x1, y + 5 AS y1, x - 5 AS x2, y - 3 AS y2 FROM i WHERE pos % 10 = 1),
    m AS (SELECT l.doc, l.page, nr, url, max(i.pos) AS pos FROM i, l WHERE i.doc = l.doc AND i.page = l.page AND x <= greatest(x1, x2) AND x + 100 >= least(x1, x2) AND y <= greatest(y1, y2) AND y + 10 >= least(y1, y2) GROUP BY 1, 2, 3, 4),
    a AS (SELECT doc, page, pos, string_agg(' (' || url || ')', '' ORDER BY nr) AS more FROM m GROUP BY 1, 2, 3)
    SELECT doc, page, pos, text || coalesce(more, '') AS text FROM i LEFT JOIN a USING (doc, page, pos)""")
def link_targets(spark, d):
    """Every item with the addresses of the links that lie on it; the first line of each order has a link."""
    items = _items(spark, d)
    first = items.where("pos % 10 = 1")  # what a link is here
    links = first.select("doc", "page", F.col("pos").alias("nr"), F.concat(F.lit("https://example.org/"), "pos").alias("url"), (F.col("x") + 40).alias("x1"), (F.col("y") + 5).alias("y1"), (F.col("x") - 5).alias("x2"), (F.col("y") - 3).alias("y2"))
    return layout.with_link_targets(items, links).select("doc", "page", "pos", "text")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), g AS (SELECT doc_id, l, len(regexp_extract_all(l, '\s{3,}')) AS gaps FROM l)
    SELECT doc_id, count(*) AS lines, count(*) FILTER (gaps >= 2 OR (gaps >= 1 AND regexp_matches(l, '[|•·]'))) AS table_rows FROM g GROUP BY 1""")
def table_like_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(layout.like_table_row(F.col("line"))).alias("table_rows"))


FONTS = ("ABCDEF+Garland", "Arial Narrow", "Wingdings 2", "Garland", "serif", " ", "abcdef+Garland", "CMMI10")


@query(rf"""WITH f AS (SELECT p_partkey, trim(list_extract([{", ".join(f"'{f}'" for f in FONTS)}], CAST(p_partkey % {len(FONTS)} AS INTEGER) + 1)) AS f FROM part)
    SELECT CASE WHEN f = '' OR f IN ('sans-serif', 'serif', 'monospace') THEN NULL WHEN regexp_matches(lower(f), '{"|".join(layout.SYMBOL_FONTS)}') THEN 'symbol'
        WHEN regexp_matches(f, '^[A-Z]{{6}}\+') OR regexp_matches(lower(f), '{"|".join(layout.STANDARD_FONTS)}') THEN 'safe' ELSE 'unembedded' END AS kind, count(*) AS n FROM f GROUP BY 1""")
def font_kinds(spark, d):
    name = F.element_at(F.array(*[F.lit(f) for f in FONTS]), (F.col("p_partkey") % len(FONTS) + 1).cast("int"))
    return read(spark, d, "part").groupBy(layout.font_kind(name).alias("kind")).agg(F.count("*").alias("n"))
