"""The queries that apply each operator to the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric, privacy, text, vectors
from ..operators import intervals, layout, matching, relational, scoring, similarity
from ..streaming import stateful
from .registry import ORACLE_SQL, QUERIES, query, read

# relational -----------------------------------------------------------------------------------


@query("""
    WITH last AS (SELECT max(CAST(ts AS DATE)) AS d FROM events),
    spine AS (SELECT CAST(d - INTERVAL (g) DAY AS DATE) AS day FROM last, generate_series(0, 29) t(g)),
    c AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT s.day, coalesce(signups, 0) AS signups, coalesce(purchases, 0) AS purchases, coalesce(errors, 0) AS errors FROM spine s LEFT JOIN c USING (day)""")
def daily_activity_spine(spark, d):
    events = read(spark, d, "events")
    kinds = {"signups": "signup", "purchases": "purchase", "errors": "error"}
    return relational.daily_spine(relational.daily_counts(events, "ts", {n: F.col("event_type") == k for n, k in kinds.items()})).orderBy("day")


@query("""SELECT c_mktsegment AS segment, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price, round(max(o_totalprice), 2) AS best
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def avg_by_segment(spark, d):
    both = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), F.round(F.max("o_totalprice"), 2).alias("best"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events
    WHERE event_type LIKE '%!_failed' ESCAPE '!' OR event_type LIKE '%error' GROUP BY 1, 2""")
def failure_counts_by_day(spark, d):
    failed = read(spark, d, "events").where(F.expr("event_type like '%!_failed' escape '!' or event_type like '%error'"))
    return failed.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day"), F.desc("n"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
    SELECT count(DISTINCT CASE WHEN ts >= now - INTERVAL 1 DAY THEN user_id END) AS day_1, count(DISTINCT CASE WHEN ts >= now - INTERVAL 7 DAY THEN user_id END) AS day_7,
           count(DISTINCT CASE WHEN ts >= now - INTERVAL 30 DAY THEN user_id END) AS day_30 FROM events, m""")
def active_users_trailing(spark, d):
    events = read(spark, d, "events")
    return relational.active_within(events, "user_id", "ts", {"day_1": 1, "day_7": 7, "day_30": 30})


@query("""SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 4) AS error_rate,
    CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_sum, round(avg(value), 4) AS mean_value FROM events GROUP BY 1""")
def event_error_rate(spark, d):
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    rate = F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4)
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(rate.alias("error_rate"), F.sum(k).alias("k_sum"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("""WITH g AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, round(sum(coalesce(mean, 0) * n) / sum(n), 2) AS weighted FROM g GROUP BY 1""")
def weighted_mean_of_means(spark, d):
    groups = read(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    return groups.groupBy("o_orderstatus").agg(relational.weighted_mean(groups, "mean", "n").alias("weighted"))


@query("""WITH p AS (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20),
    o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1)
    SELECT c_custkey, left(c_name, 2) || '***@example.org' AS email, coalesce(n, 0) AS orders, CAST(last AS DATE) AS last_day FROM p LEFT JOIN o ON c_custkey = o_custkey""")
def user_summary_page(spark, d):
    people = relational.page(read(spark, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 20)
    counts = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    email = privacy.mask_email(F.concat("c_name", F.lit("@example.org")))
    return people.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", email.alias("email"), F.coalesce("n", F.lit(0)).alias("orders"), F.to_date("last").alias("last_day"))


LATEST = "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders"


@query(f"SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM ({LATEST}) WHERE rank <= 3")
def latest_k_per_user(spark, d):
    return relational.latest(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank")


@query(f"""WITH r AS ({LATEST}), t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1)
    SELECT o_custkey, round(avg(o_totalprice), 6) AS recent_avg, max(o_totalprice) AS recent_best, any_value(total) AS total FROM r JOIN t USING (o_custkey) WHERE rank <= 20 GROUP BY 1""")
def recent_stats_vs_total(spark, d):
    orders = read(spark, d, "orders")
    recent = relational.latest(orders, "o_custkey", "o_orderdate", "o_orderkey", 20).groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("recent_avg"), F.max("o_totalprice").alias("recent_best"))
    return recent.join(orders.groupBy("o_custkey").agg(F.count("*").alias("total")), "o_custkey")


@query(f"""SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY rank DESC) AS INTEGER) AS step FROM ({LATEST}) WHERE rank <= 20""")
def trend_last_20(spark, d):
    recent = relational.latest(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 20)
    return recent.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("rank"))).alias("step"))


@query("""WITH l AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber DESC, l_partkey DESC) AS lines FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def nested_children_sorted(spark, d):
    parents = read(spark, d, "orders").select("o_orderkey")
    children = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    both = relational.nested(parents, children, "o_orderkey", ["l_linenumber", "l_partkey"], "lines")
    return both.select("o_orderkey", F.coalesce(F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ","), F.lit("")).alias("lines"))


@query("""SELECT l_orderkey, l_linenumber, o_orderpriority, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45""")
def two_hop_lookup(spark, d):
    lines = read(spark, d, "lineitem").where("l_quantity > 45")
    both = lines.join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_name")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = 7)""")
def owner_scoped_lines(spark, d):
    parents = read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return relational.owned(read(spark, d, "lineitem"), parents, "l_orderkey", F.col("o_custkey") == 7).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')""")
def cascade_delete_survivors(spark, d):
    deleted = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relational.without(read(spark, d, "lineitem"), deleted, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id FROM events")
def anonymise_events(spark, d):
    events = read(spark, d, "events")
    return relational.anonymised(events, events.where("user_id % 10 = 0").select("user_id"), "user_id").select("event_id", "user_id")


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""")
def filtered_audit_page(spark, d):
    rows = relational.filtered(read(spark, d, "events"), [F.col("event_type") == "click", None, F.col("ts") >= F.lit("2024-01-05").cast("timestamp"), F.col("ts") < F.lit("2024-01-11").cast("timestamp")])
    return relational.page(rows, [F.desc("ts"), F.asc("event_id")], 2, 50).select("event_id", "event_type")


def _two_periods(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    total = lambda c: F.round(F.sum(F.when(c, F.col("o_totalprice")).otherwise(0.0)), 2)
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(old).alias("old_orders"), F.count_if(~old).alias("new_orders"), total(old).alias("old_spend"), total(~old).alias("new_spend"))


@query("""WITH p AS (SELECT o_custkey, o_orderdate < TIMESTAMP '1998-01-01' AS old, o_totalprice FROM orders),
    s AS (SELECT o_custkey, CAST(count(*) FILTER (old) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT old) AS DOUBLE) AS b, round(coalesce(sum(o_totalprice) FILTER (old), 0), 2) AS c, round(coalesce(sum(o_totalprice) FILTER (NOT old), 0), 2) AS d FROM p GROUP BY 1)
    SELECT o_custkey, 'orders' AS metric, a AS older, b AS newer, round(b - a, 2) AS delta FROM s UNION ALL SELECT o_custkey, 'spend', c, d, round(d - c, 2) FROM s""")
def compare_unpivot_deltas(spark, d):
    both = _two_periods(spark, d).withColumns({c: F.col(c).cast("double") for c in ("old_orders", "new_orders")})
    return relational.deltas(both, "o_custkey", ["orders", "spend"]).withColumn("delta", F.round("delta", 2))


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, max_by(o_orderstatus, -o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS f, max_by(o_orderstatus, -o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS t FROM orders GROUP BY 1, 2),
    v AS (SELECT *, CASE f WHEN 'P' THEN 1 WHEN 'O' THEN 3 ELSE 5 END AS a, CASE t WHEN 'P' THEN 1 WHEN 'O' THEN 3 ELSE 5 END AS b FROM r WHERE f IS NOT NULL AND t IS NOT NULL AND f <> t)
    SELECT o_custkey, o_orderpriority, f AS from_status, t AS to_status, (b - a) / 5.0::DOUBLE AS credit_delta, CASE WHEN b > a THEN 'improved' ELSE 'declined' END AS direction FROM v""")
def status_change(spark, d):
    orders, key = read(spark, d, "orders"), ["o_custkey", "o_orderpriority"]
    first = lambda cond: orders.where(cond).groupBy(*key).agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"))
    cut = F.lit("1998-01-01").cast("timestamp")
    rank = F.create_map(*[F.lit(x) for x in ("P", 1, "O", 3, "F", 5)])
    return relational.status_changes(first(F.col("o_orderdate") < cut), first(F.col("o_orderdate") >= cut), key, rank)


@query("""SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) / 5) AS BIGINT) AS chunk, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey""")
def chunked_keys(spark, d):
    both = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")
    return relational.chunked(both, "c_custkey", "o_orderkey", 5).select("c_custkey", "chunk", "o_orderkey")


@query("""WITH o AS (SELECT o_custkey, string_agg('{"o_orderkey":' || o_orderkey || ',"total":"' || printf('%.2f', o_totalprice) || '"}', ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1)
    SELECT c_custkey, '{"c_name":"' || c_name || '","orders":[' || coalesce(orders, '') || ']}' AS document FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def export_json(spark, d):
    """A nested document for each customer; amounts are texts, so that they stay as they are."""
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.format_string("%.2f", "o_totalprice").alias("total"))
    people = relational.nested(read(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", ["o_orderkey", "total"], "orders", newest=False)
    lists = F.coalesce("orders", F.array().cast("array<struct<o_orderkey:bigint,total:string>>")).alias("orders")
    return people.select("c_custkey", F.to_json(F.struct("c_name", lists)).alias("document"))


# intervals and dates --------------------------------------------------------------------------

SPANS = """SELECT o_custkey, o_orderkey AS pos, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS s, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 4 AS INTEGER) AS e FROM orders"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    return read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), month.alias("s"), (month + F.col("o_orderkey") % 4).cast("int").alias("e"))


@query(f"""WITH x AS ({SPANS}), m AS (SELECT o_custkey, count(DISTINCT mo) AS total FROM x, LATERAL (SELECT unnest(generate_series(s, e)) AS mo) GROUP BY 1),
    r AS (SELECT o_custkey, CAST(sum(e - s + 1) AS BIGINT) AS raw FROM x GROUP BY 1)
    SELECT o_custkey, CAST(total AS BIGINT) AS total_months, raw AS raw_months, CAST(raw - total AS BIGINT) AS overlap_months FROM m JOIN r USING (o_custkey)""")
def merged_tenure_months(spark, d):
    return intervals.tenure(_spans(spark, d), "o_custkey")


@query(f"""WITH x AS ({SPANS}) SELECT a.o_custkey, a.pos AS left_pos, b.pos AS right_pos, CAST(least(a.e, b.e) - greatest(a.s, b.s) + 1 AS INTEGER) AS months
    FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.pos < b.pos AND a.s <= b.e AND b.s <= a.e""")
def overlap_pairs(spark, d):
    return intervals.overlaps(_spans(spark, d), "o_custkey", "pos").withColumn("months", F.col("months").cast("int"))


@query(f"""WITH x AS ({SPANS}), g AS (SELECT o_custkey, s, lag(s) OVER (PARTITION BY o_custkey ORDER BY pos) AS p FROM x)
    SELECT o_custkey, coalesce(CAST(CASE WHEN count(*) >= 2 THEN bool_and(coalesce(s <= p, true)) END AS VARCHAR), 'too few') AS newest_first FROM g GROUP BY 1""")
def reverse_chronological(spark, d):
    told = intervals.newest_first(_spans(spark, d), "o_custkey", "pos")
    return told.withColumn("newest_first", F.coalesce(F.col("newest_first").cast("string"), F.lit("too few")))


def _styled() -> Column:
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    return F.when(kind == 0, F.date_format(day, "yyyy-MM")).when(kind == 1, F.date_format(day, "MM/yyyy")).when(kind == 2, F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "yyyy"))


STYLES = "CASE o_orderkey % 4 WHEN 0 THEN 'YEAR_MONTH' WHEN 1 THEN 'NUMERIC_MONTH_YEAR' WHEN 2 THEN 'MONTH_NAME_YEAR' ELSE 'YEAR_ONLY' END"


@query(f"""WITH c AS (SELECT o_custkey, {STYLES} AS style, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_custkey, style, n, max(n) OVER (PARTITION BY o_custkey) / CAST(sum(n) OVER (PARTITION BY o_custkey) AS DOUBLE) >= 0.8 AS uniform FROM c""")
def date_style_mix(spark, d):
    counts = read(spark, d, "orders").groupBy("o_custkey", dates.date_style(_styled()).alias("style")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("o_custkey")
    return counts.withColumn("uniform", F.max("n").over(own) / F.sum("n").over(own) >= 0.8)


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 12 + CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE month(o_orderdate) - 1 END AS INTEGER) AS month FROM orders")
def year_month_parse(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.parse_month(_styled()).alias("month"))


# texts ----------------------------------------------------------------------------------------

WORDS = r"len(regexp_extract_all(t, '[A-Za-z][A-Za-z''’\-]*'))"


SYLLABLES = """CASE WHEN length(l) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(
    CASE WHEN l LIKE '%es' OR l LIKE '%ed' THEN left(l, length(l) - 2) WHEN l LIKE '%e' AND l NOT LIKE '%le' THEN left(l, length(l) - 1) ELSE l END, '[aeiouy]+'))) END"""


@query(rf"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE lang = 'en'),
    w AS (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z''’\-]*'))), '[^a-z]', '', 'g') AS l FROM x) GROUP BY 1, 2),
    y AS (SELECT doc_id, sum(n) AS words, sum(n * ({SYLLABLES})) AS vowels FROM w GROUP BY 1),
    c AS (SELECT doc_id, CAST(coalesce(words, 0) AS BIGINT) AS words, coalesce(vowels, 0) AS vowels, CASE WHEN trim(t) = '' THEN 0 ELSE greatest(1, len(list_filter(string_split_regex(regexp_replace(t, '[.!?]+(\s|$)', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_matches(p, '[A-Za-z]')))) END AS sentences FROM x LEFT JOIN y USING (doc_id))
    SELECT doc_id, words, sentences, CAST(vowels AS BIGINT) AS syllables, round(CASE WHEN words > 0 THEN 206.835e0 - 1.015e0 * words / sentences - 84.6e0 * vowels / words ELSE 0 END, 4) AS ease,
           round(CASE WHEN words > 0 THEN 0.39e0 * words / sentences + 11.8e0 * vowels / words - 15.59e0 ELSE 0 END, 4) AS grade FROM c""")
def readability_docs(spark, d):
    """Each distinct word of a document is split into syllables once."""
    t = F.coalesce("text", F.lit(""))
    docs = read(spark, d, "documents").where("lang = 'en'")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(t, F.lit(text.WORD), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    counted = words.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum(F.col("n") * text.count_syllables(F.col("w"))).alias("syllables"))
    c = docs.select("doc_id", text.count_sentences(t).cast("long").alias("sentences")).join(counted, "doc_id", "left").fillna(0, ["words", "syllables"])
    w, s, v = F.col("words"), F.col("sentences"), F.col("syllables")
    return c.select("doc_id", "words", "sentences", "syllables", F.round(text.reading_ease(w, s, v), 4).alias("ease"), F.round(text.grade_level(w, s, v), 4).alias("grade"))


def known_words(docs: DataFrame, dictionary: DataFrame, key: str, body: str) -> DataFrame:
    """``(key, known)``: the share of alphabetic tokens that ``dictionary (w)`` has, also without common endings. Each distinct token is looked up once."""
    tokens = docs.select(key, F.explode(text.alphabetic_tokens(F.col(body))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    stems = tokens.select("token").distinct().select("token", F.explode(text.word_stems(F.col("token"))).alias("w"))
    found = stems.join(dictionary.select("w").distinct(), "w", "left_semi").select("token").distinct().withColumn("hit", F.lit(1))
    return tokens.join(found, "token", "left").groupBy(key).agg((F.sum(F.col("n") * F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("known"))


@query(r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark),
    tk AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z][a-z''’\-]+')) AS k FROM x) GROUP BY 1, 2),
    nt AS (SELECT k, regexp_replace(regexp_replace(regexp_replace(k, '^[^a-z]+', ''), '[^a-z''’]+$', ''), '[''’]s$', '') AS w FROM (SELECT DISTINCT k FROM tk)),
    f AS (SELECT k, unnest([w, CASE WHEN w LIKE '%s' THEN left(w, length(w) - 1) END, CASE WHEN w LIKE '%es' OR w LIKE '%ed' OR w LIKE '%ly' THEN left(w, length(w) - 2) END, CASE WHEN w LIKE '%ing' THEN left(w, length(w) - 3) END]) AS w FROM nt WHERE length(w) >= 2),
    h AS (SELECT DISTINCT k FROM f SEMI JOIN v USING (w)), r AS (SELECT doc_id, sum(CASE WHEN h.k IS NULL THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE) AS known FROM tk LEFT JOIN h USING (k) GROUP BY 1),
    m AS (SELECT doc_id, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS chars, list_max(list_transform(string_split_regex(t, '\s+'), lambda w: length(w))) AS unbroken, CASE WHEN t = '' THEN 1e0 ELSE len(regexp_extract_all(t, '\s')) / CAST(length(t) AS DOUBLE) END AS whitespace,
        CASE WHEN t = '' THEN 1e0 ELSE len(regexp_extract_all(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x{25A0}-\x{25FF}]')) / CAST(length(t) AS DOUBLE) END AS garbage, regexp_extract_all(t, '[A-Za-z]{3,}') AS ws FROM x),
    c AS (SELECT m.doc_id, chars, unbroken, whitespace, garbage, coalesce(known, 0) AS known, CASE WHEN len(ws) = 0 THEN 1e0 ELSE len(list_filter(ws, lambda w: len(regexp_extract_all(w, '[aeiouAEIOU]')) / CAST(length(w) AS DOUBLE) < 0.15 OR regexp_matches(w, '(?i)[bcdfghjklmnpqrstvwxz]{6,}'))) / CAST(len(ws) AS DOUBLE) END AS nonsense FROM m LEFT JOIN r ON m.doc_id = r.doc_id),
    z AS (SELECT *, concat_ws(',', CASE WHEN chars <= 150 THEN 'too_short' END, CASE WHEN known < 0.6 THEN 'unknown_words' END, CASE WHEN whitespace > 0.5 THEN 'whitespace' END, CASE WHEN unbroken > 200 THEN 'unbroken_run' END, CASE WHEN garbage > 0.02 THEN 'garbage' END, CASE WHEN nonsense > 0.35 THEN 'nonsense' END) AS reasons FROM c)
    SELECT doc_id, chars, unbroken, round(known, 6) AS known, round(whitespace, 6) AS whitespace, round(garbage, 6) AS garbage, round(nonsense, 6) AS nonsense, reasons, reasons = '' AS passed FROM z""")
def extraction_quality_docs(spark, d):
    """All six limits over every text; the dictionary is a parameter, here the words of ``benchmark``."""
    docs, t = read(spark, d, "documents"), F.coalesce("text", F.lit(""))
    dictionary = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w"))
    measured = docs.select(
        "doc_id", F.length(F.regexp_replace(t, r"^\s+|\s+$", "")).cast("long").alias("chars"), text.whitespace_ratio(t).alias("whitespace"), text.longest_unbroken(t).cast("long").alias("unbroken"),
        text.garbage_ratio(t).alias("garbage"), text.nonsense_ratio(t).alias("nonsense"),
    )
    c = measured.join(known_words(docs, dictionary, "doc_id", "text"), "doc_id", "left").fillna(0.0, ["known"])
    reasons = text.quality_reasons(*[F.col(n) for n in ("chars", "known", "whitespace", "unbroken", "garbage", "nonsense")])
    rounded = [F.round(n, 6).alias(n) for n in ("known", "whitespace", "garbage", "nonsense")]
    return c.select("doc_id", "chars", "unbroken", *rounded, F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


@query(r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark), x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM documents)
    SELECT doc_id, count(*) AS tokens, round(count(v.w) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM x LEFT JOIN v USING (w) GROUP BY 1""")
def dictionary_ratio(spark, d):
    words = lambda df, *keep: df.select(*keep, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w"))
    known = words(read(spark, d, "benchmark")).distinct().withColumn("known", F.lit(1))
    counted = words(read(spark, d, "documents"), "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n"))  # a word of a document is joined once
    return counted.join(known, "w", "left").groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.round(F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("ratio"))


@query(r"""WITH x AS (SELECT doc_id, text AS t FROM documents)
    SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b')) AS INTEGER) AS emails FROM x WHERE contains(t, '@')""")
def email_counts(spark, d):
    docs = read(spark, d, "documents").where(F.contains("text", F.lit("@")))
    return docs.select("doc_id", F.regexp_count("text", F.lit("(?i)(?<![A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}(?![A-Za-z0-9_])")).alias("emails"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _masking() -> str:
    """SQL that replaces one kind after the other and counts each ahead of its own replacement."""
    steps = [("n_social_url", (privacy.SOCIAL_URL,), "[REDACTED_PROFILE_URL]"), ("n_address", (privacy.ADDRESS,), "[REDACTED_ADDRESS]"), ("n_phone", privacy.PHONES, privacy.REDACTED), ("n_email", (privacy.EMAIL,), privacy.REDACTED)]
    sql, names = "SELECT doc_id, coalesce(text, '') AS t FROM documents", ""
    for name, patterns, put in steps:
        count, text_ = " + ".join(f"len(regexp_extract_all(t, {_sql(p)}))" for p in patterns), "t"
        for p in patterns:
            text_ = f"regexp_replace({text_}, {_sql(p)}, '{put}', 'g')"
        sql = f"SELECT doc_id, {text_} AS t{names}, {count} AS {name} FROM ({sql})"
        names += f", {name}"
    return f"SELECT doc_id, sha256(t) AS sha256{names} FROM ({sql})"


def _neutralising() -> str:
    control = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
    sql, names = f"SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '[\u200b-\u200d\u2060\ufeff]', '', 'g'), '{control}', ' ', 'g') AS t FROM conversations", ""
    for name, p in privacy.INJECTIONS.items():
        sql = f"SELECT conv_id, turn, regexp_replace(t, {_sql(p)}, '{privacy.MARK}', 'g') AS t{names}, CASE WHEN regexp_matches(t, {_sql(p)}) THEN '{name}' END AS {name} FROM ({sql})"
        names += f", {name}"
    shorter = r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t]{3,}', '  ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    return f"SELECT conv_id, turn, sha256({shorter}) AS sha256, concat_ws(','{names}) AS families FROM ({sql})"


@query(_masking())
def pii_mask_docs(spark, d):
    clean, counts = privacy.masked(F.coalesce("text", F.lit("")), emails=True)
    return read(spark, d, "documents").select("doc_id", F.sha2(clean, 256).alias("sha256"), *[c.alias(f"n_{k}") for k, c in counts.items()])


@query(_neutralising())
def injection_scan(spark, d):
    clean, found = privacy.neutralised(F.coalesce("text", F.lit("")))
    return read(spark, d, "conversations").select("conv_id", "turn", F.sha2(clean, 256).alias("sha256"), F.array_join(found, ",").alias("families"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)href="(https?://[^"]*)"', 1))), ' ') AS links, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages""")
def html_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(F.array_sort(text.html_links(F.col("html"))), " ").alias("links"), F.length(text.strip_tags(F.col("html"))).cast("long").alias("chars"))


def _html_sql() -> str:
    rules = [
        (text.ANCHOR, r"\2 (\1)"), (r"(?i)<tr\b[^>]*>", "\n| "), (r"(?i)</tr>", " |"), (r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | "), (r"(?i)</?t(?:able|head|body|foot)\b[^>]*>", "\n"),
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|li|section|article)>", "\n"), (r"(?i)<li\b[^>]*>", "\n- "), ("<[^>]*>", ""),
        *[(f"(?i)&{n};", c) for n, c in text.ENTITIES.items() if n != "amp"], ("(?i)&amp;", "&"), ("\u00a0", " "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ]
    out = "html"
    for p, put in rules:
        out = f"regexp_replace({out}, {_sql(p)}, {_sql(put)}, 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


@query(_html_sql())  # the tables' anchors hold no tags, and their entities have names
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(r"""WITH x AS (SELECT doc_id, sha256(lower(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS h FROM documents)
    SELECT h AS hash, min(doc_id) AS first_id, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1""")
def content_hash_dedupe(spark, d):
    hashed = read(spark, d, "documents").select("doc_id", F.sha2(text.normal_for_hash(F.col("text")), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(l), '[0-9]+', '#', 'g'), '[^a-z#\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM x)
    SELECT key, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= 3 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2""")
def repeated_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    keyed = lines.select("doc_id", text.normal_for_repeats(F.col("line")).alias("key")).where(F.length("key") >= 3).distinct()
    return keyed.groupBy("key").agg(F.count("*").alias("docs")).where("docs >= 2")


@query()
def grounded_benchmark(spark, d):
    """Which whole items are grounded in which documents.

    A document that holds 92 % of an item's words holds one of its rarest
    words that make up over 8 %; one that quotes an item whole holds all its
    words but the first and the last, which may go on. These words are the
    keys; only items that have none (two words or fewer) meet all documents.
    """
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"), F.split(privacy.normal_for_grounding(F.col("text")), " ").alias("w"))
    docs = read(spark, d, "documents").select("doc_id", "text")
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.split(privacy.normal_for_grounding(F.col("text")), " "))).alias("key"))
    places = items.select("item_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "key"))
    rare = seen.join(places.select("key").distinct(), "key").groupBy("key").agg(F.count("*").alias("docs"))
    places = places.join(rare, "key", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    inner = places.where("at > 0 and at < n - 1").groupBy("item_id").agg(F.min_by("key", F.struct("docs", "key")).alias("key"))
    counted = places.where(F.length("key") > 1).groupBy("item_id", "key", "docs").agg(F.count("*").alias("times"))
    order = Window.partitionBy("item_id").orderBy("docs", "key")
    before = F.coalesce(F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rarest = counted.withColumn("before", before).withColumn("all", F.sum("times").over(Window.partitionBy("item_id"))).where("all >= 6 and before * 100 <= all * 8").select("item_id", "key")
    pairs = seen.join(inner.unionByName(rarest).distinct(), "key").select("doc_id", "item_id").distinct()
    near = docs.join(pairs, "doc_id").join(items.select("item_id", "quote"), "item_id")
    short = docs.crossJoin(items.where(F.size("w") < 3).select("item_id", "quote"))
    every = near.select("doc_id", "item_id", "quote", "text").unionByName(short.select("doc_id", "item_id", "quote", "text"))
    return every.where(privacy.grounded(F.col("quote"), F.col("text"))).select("doc_id", "item_id").distinct()


HEADING = r"""(len(string_split_regex(u, '\s+')) <= 8 AND NOT regexp_matches(u, '[.!?]$') AND length(regexp_replace(u, '[^A-Za-z]', '', 'g')) >= 3 AND
    (length(regexp_replace(u, '[^A-Z]', '', 'g')) / CAST(greatest(1, length(regexp_replace(u, '[^A-Za-z]', '', 'g'))) AS DOUBLE) > 0.6 OR regexp_matches(u, '^[A-Z][\w\s&/,''-]{2,60}:?$')))"""


@query(rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM s), h AS (SELECT *, trim(t) AS u FROM l), k AS (SELECT *, {HEADING} AS heading FROM h),
    a AS (SELECT *, last_value(CASE WHEN heading THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM k)
    SELECT doc_id, CAST(min(line) AS INTEGER) AS line, arg_min(coalesce(section, ''), line) AS section, arg_min(left(t, 400), line) AS excerpt FROM a WHERE NOT heading AND regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}])the([^\p{{L}}\p{{N}}]|$)') GROUP BY 1""")
def excerpt_with_section(spark, d):
    """The first line of each document that holds ``the``, with the nearest heading above it."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    heading = text.looks_like_heading(F.col("text"))
    above = F.last(F.when(heading, F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    hits = lines.withColumn("section", above).where(~heading & text.contains_term(F.col("text"), F.lit("the")))
    return hits.groupBy("doc_id").agg(F.min("line").alias("line"), F.min_by(F.coalesce("section", F.lit("")), "line").alias("section"), F.min_by(F.substring("text", 1, 400), "line").alias("excerpt"))


def either(patterns: tuple[str, ...]) -> str:
    """Patterns as one SQL condition on ``l``."""
    return "(" + " OR ".join("regexp_matches(l, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


@query(rf"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)
    SELECT doc_id, count(*) AS lines, count(*) FILTER ({either(text.QUANTIFIED)}) AS quantified FROM s GROUP BY 1""")
def quantified_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(text.is_quantified(F.col("line"))).alias("quantified"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda l: trim(l)), lambda l: length(l) BETWEEN 1 AND 60) AS ls FROM documents)
    SELECT doc_id, concat_ws(',', """ + ", ".join("CASE WHEN len(list_filter(ls, lambda l: " + " OR ".join(f"regexp_matches(l, '(?i){p}')" for p in ps) + f")) > 0 THEN '{n}' END" for n, ps in text.SECTIONS.items()) + ") AS sections FROM s")
def section_headers(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(text.sections(F.coalesce("text", F.lit(""))), ",").alias("sections"))


# vectors --------------------------------------------------------------------------------------

UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
    p AS (SELECT q.vec_id, r.vec_id AS other, r.label, greatest(0, least(1, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])))) AS c FROM u q JOIN u r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)"""


def _by_label(spark: SparkSession, d: str) -> DataFrame:
    return similarity.label_similarity(read(spark, d, "embeddings").select("vec_id", "label", "embedding"), every=100)


@query(f"WITH {UNIT} SELECT vec_id, arg_max(other, c) AS best, round(max(c), 5) AS similarity FROM p GROUP BY 1")
def cosine_best_match(spark, d):
    return _by_label(spark, d).groupBy("vec_id").agg(F.max_by("best", F.struct(F.col("similarity"), -F.col("best"))).alias("best"), F.round(F.max("similarity"), 5).alias("similarity"))


@query(f"WITH {UNIT}, b AS (SELECT CASE WHEN c >= 0.82 THEN 1.0 WHEN c >= 0.72 THEN 0.65 WHEN c >= 0.60 THEN 0.25 ELSE 0.0 END::DOUBLE AS credit FROM p) SELECT credit, count(*) AS n FROM b GROUP BY 1")
def semantic_bands(spark, d):
    credits = [c for _, c in numeric.SIMILARITY_BANDS] + [0.0]
    rows = F.array(*[F.struct(F.lit(c).alias("credit"), F.col(f"n_{k}").alias("n")) for k, c in enumerate(credits)])
    return _by_label(spark, d).select(F.inline(rows)).groupBy("credit").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"""WITH {UNIT}, b AS (SELECT vec_id, label, max(c) AS m FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM b WHERE m > 0)
    SELECT vec_id, round(avg(m), 5) AS relevance FROM r WHERE k <= ceil(n / 2.0) GROUP BY 1""")
def topk_mean_relevance(spark, d):
    best = _by_label(spark, d)
    return best.groupBy("vec_id").agg(F.round(numeric.top_k_mean(F.collect_list("similarity")), 5).alias("relevance"))  # one value for each label


@query(f"""WITH {UNIT}, b AS (SELECT vec_id, label, max(c) AS m FROM p GROUP BY 1, 2)
    SELECT vec_id, round(avg(CASE WHEN m >= 0.82 THEN 100 WHEN m >= 0.72 THEN 65 WHEN m >= 0.60 THEN 25 ELSE 0 END), 4) AS alignment FROM b GROUP BY 1""")
def semantic_alignment_by_label(spark, d):
    return _by_label(spark, d).groupBy("vec_id").agg(F.round(F.avg(numeric.relevance(F.col("similarity"))), 4).alias("alignment"))


# scores and matches ---------------------------------------------------------------------------

PARTS = """SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_discount * 1000 AS b, l_tax * 1250 AS c, (l_partkey % 101) * 1e0 AS d, (l_suppkey % 101) * 1e0 AS e, (l_orderkey % 101) * 1e0 AS f, l_linenumber * 14e0 AS g FROM lineitem"""
CLEAN = ", ".join(f"floor((least(100e0, greatest(0e0, {c})) * {w}e0 + sign({c}) * 2.220446049250313e-16) * 10000e0 + 0.5e0) / 10000e0 AS {c}" for c, w in zip("abcdefg", scoring.WEIGHTS["software_engineer"], strict=True))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    cols = {"a": F.col("l_quantity") * 2, "b": F.col("l_discount") * 1000, "c": F.col("l_tax") * 1250, "d": (F.col("l_partkey") % 101) * 1.0, "e": (F.col("l_suppkey") % 101) * 1.0, "f": (F.col("l_orderkey") % 101) * 1.0, "g": F.col("l_linenumber") * 14.0}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in cols.items()])


@query(f"""WITH x AS ({PARTS}), y AS (SELECT l_orderkey, l_linenumber, {CLEAN} FROM x), z AS (SELECT l_orderkey, l_linenumber, floor((a + b + c + d + e + f + g + 2.220446049250313e-16) * 100e0 + 0.5e0) / 100e0 AS s FROM y)
    SELECT l_orderkey, l_linenumber, s AS score, CASE WHEN s >= 85 THEN 'excellent' WHEN s >= 70 THEN 'strong' WHEN s >= 50 THEN 'moderate' ELSE 'developing' END AS band FROM z""")
def weighted_score_bands(spark, d):
    scored = scoring.weighted_score(_parts(spark, d), list("abcdefg"), scoring.WEIGHTS["software_engineer"])
    return scored.select("l_orderkey", "l_linenumber", "score").withColumn("band", numeric.score_band(F.col("score")))


HALF_UP = "floor(({0} + sign({0}) * 2.220446049250313e-16) * {1}e0 + 0.5e0) / {1}e0"


@query(f"""WITH x AS ({PARTS}), y AS (SELECT *, least(100e0, a) * (0.35e0 / 0.45e0) AS u, least(100e0, b) * (0.10e0 / 0.45e0) AS v FROM x),
    z AS (SELECT l_orderkey, l_linenumber, least(100e0, {HALF_UP.format("u", 10000)} + {HALF_UP.format("v", 10000)}) AS s FROM y) SELECT l_orderkey, l_linenumber, {HALF_UP.format("s", 100)} AS skill FROM z""")
def renormalised_scores(spark, d):
    return scoring.renormalised(_parts(spark, d), ["a", "b"], scoring.WEIGHTS["software_engineer"][:2], "skill").select("l_orderkey", "l_linenumber", "skill")


@query(f"""WITH x AS ({PARTS}) SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN least(a, 70.0) ELSE a END AS required FROM x""")
def capped_required(spark, d):
    return _parts(spark, d).select("l_orderkey", "l_linenumber", scoring.capped(F.col("a"), F.col("l_orderkey") % 3 == 0).alias("required"))


PROFILES = {"metal": ("steel", "copper", "tin"), "jewel": ("ring", "gold"), "small": ("small", "tiny"), "large": ("large", "big")}


@query("WITH k(profile, pos, word) AS (VALUES " + ", ".join(f"('{p}', {i}, '{w}')" for i, (p, w) in enumerate((p, w) for p, ws in PROFILES.items() for w in ws)) + """)
    SELECT p_partkey, arg_max(profile, (CASE WHEN contains(lower(p_name), word) THEN 100 ELSE 0 END + length(word)) * 100 - pos) AS profile FROM part, k WHERE contains(lower(p_name), word) OR contains(lower(p_type), word) GROUP BY 1""")
def profile_suggestion(spark, d):
    words = [(p, i, w) for i, (p, w) in enumerate((p, w) for p, ws in PROFILES.items() for w in ws)]
    hits = F.array(*[F.struct((F.when(F.lower("p_name").contains(w), 100).otherwise(0) + len(w)).alias("score"), F.lit(-i).alias("pos"), F.lit(p).alias("profile"), (F.lower("p_name").contains(w) | F.lower("p_type").contains(w)).alias("hit")) for p, i, w in words])
    best = F.array_max(F.filter(hits, lambda h: h["hit"]))
    return read(spark, d, "part").select("p_partkey", best["profile"].alias("profile")).where("profile is not null")


def _index(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    entries = part.groupBy("p_brand").agg(F.min("p_partkey").alias("pos"), F.collect_set("p_type").alias("aliases"))
    return matching.alias_index(entries, "p_brand", "aliases", "pos")


def _norm_sql(column: str) -> str:
    out = f"lower(trim({column}))"
    for pattern, put in text.SKILL_RULES:
        put = put.replace("$", chr(92))
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''").replace(text.ZERO_WIDTH, "\u200b"), put)
    return f"trim({out})"


@query(f"""WITH e AS (SELECT p_brand, min(p_partkey) AS pos FROM part GROUP BY 1), n AS (SELECT DISTINCT p_brand AS c, {_norm_sql('p_type')} AS norm FROM part UNION SELECT p_brand, {_norm_sql('p_brand')} FROM part),
    i AS (SELECT norm, arg_min(c, pos) AS canonical FROM n JOIN e ON c = p_brand WHERE norm <> '' GROUP BY 1)
    SELECT p_partkey, coalesce(canonical, trim(p_type)) AS canonical FROM part LEFT JOIN i ON norm = {_norm_sql('p_type')}""")
def canonicalise_entities(spark, d):
    return matching.canonicalise(read(spark, d, "part").select("p_partkey", "p_type"), _index(spark, d), "p_type").select("p_partkey", "canonical")


@query("""WITH e AS (SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region)
    SELECT child AS a, parent AS b FROM e UNION SELECT parent, child FROM e UNION SELECT x.child, y.child FROM e x JOIN e y ON x.parent = y.parent AND x.child <> y.child AND x.parent IN (SELECT child FROM e)""")
def related_entities(spark, d):
    return matching.related(_edges(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return own.unionByName(region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))).distinct()


STAGED = """h AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS item FROM orders), r AS (SELECT c_custkey AS k, item, source FROM customer, (VALUES ('1-URGENT', 'required'), ('2-HIGH', 'required'), ('5-LOW', 'preferred'), ('9-NONE', 'required')) v(item, source)),
    p(a, b) AS (VALUES ('1-URGENT', '2-HIGH'), ('2-HIGH', '1-URGENT')), m AS (SELECT k, r.item, source, CASE WHEN h.item IS NOT NULL THEN 'EXACT' WHEN EXISTS (SELECT 1 FROM p JOIN h g ON g.item = p.a WHERE p.b = r.item AND g.k = r.k) THEN 'STRONG_RELATED'
    WHEN r.item = '9-NONE' AND k % 5 = 0 THEN 'PARTIAL' WHEN source = 'preferred' THEN 'MISSING_PREF' ELSE 'MISSING_REQ' END AS category FROM r LEFT JOIN h USING (k, item)),
    s AS (SELECT *, CASE category WHEN 'EXACT' THEN 1.0 WHEN 'STRONG_RELATED' THEN 0.85 WHEN 'PARTIAL' THEN 0.25 ELSE 0.0 END::DOUBLE AS credit FROM m)"""


def _staged(spark: SparkSession, d: str) -> DataFrame:
    held = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("item"))
    wanted = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(s).alias("source")) for i, s in (("1-URGENT", "required"), ("2-HIGH", "required"), ("5-LOW", "preferred"), ("9-NONE", "required"))])
    required = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.inline(wanted))
    pairs = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("2-HIGH", "1-URGENT")], "a string, b string")
    similar = read(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit("9-NONE").alias("item"), F.lit(0.65).alias("similarity"))
    return matching.staged_match(required, held, pairs, similar, "k")


@query(f"WITH {STAGED} SELECT k, item, source, category, credit FROM s")
def staged_match(spark, d):
    return _staged(spark, d)


@query(f"WITH {STAGED} SELECT k, source, round(avg(credit) * 100, 2) AS coverage FROM s GROUP BY 1, 2")
def match_coverage(spark, d):
    return _staged(spark, d).groupBy("k", "source").agg(F.round(numeric.coverage(F.avg(numeric.clamp(F.col("credit"), 0, 1)), 0), 2).alias("coverage"))


@query(f"""WITH {STAGED} SELECT k, item, category, CASE WHEN category = 'MISSING_REQ' OR source = 'required' THEN 'high' ELSE 'medium' END AS priority
    FROM s WHERE category IN ('MISSING_REQ', 'MISSING_PREF') OR (category = 'PARTIAL' AND credit < 0.5)""")
def gap_priorities(spark, d):
    return matching.gaps(_staged(spark, d)).select("k", "item", "category", "priority")


def _stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


# layout and state -----------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_type, CAST(least(255, greatest(0, floor(value))) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT event_type, bin, sum(n) OVER o AS w, sum(n * bin) OVER o AS m, sum(n) OVER (PARTITION BY event_type) AS tw, sum(n * bin) OVER (PARTITION BY event_type) AS tm FROM b WINDOW o AS (PARTITION BY event_type ORDER BY bin)),
    v AS (SELECT event_type, bin, round(CAST(w AS DOUBLE) * (tw - w) * (m / CAST(w AS DOUBLE) - (tm - m) / CAST(tw - w AS DOUBLE)) ** 2, 4) AS s FROM c WHERE tw > w)
    SELECT event_type, arg_max(bin, s * 1000 - bin / 1e6) AS threshold FROM v GROUP BY 1""")
def otsu_threshold(spark, d):
    bins = F.least(F.lit(255), F.greatest(F.lit(0), F.floor("value"))).cast("int")
    return layout.otsu(read(spark, d, "events").groupBy("event_type", bins.alias("bin")).agg(F.count("*").alias("n")), "event_type")


@query()
def column_lines(spark, d):
    items = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 5).alias("page"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_partkey") % 500).cast("double").alias("x"), (700 - (F.col("l_orderkey") % 50) * 12).cast("double").alias("y"), F.lit(20.0).alias("width"))
    return layout.group_lines(items)


@query()
def rate_limit_admission(spark, d):
    return stateful.admission_batch(_stamped(read(spark, d, "events")), "user_id", "ts", "event_id", 3600.0, 2)


@query()
def circuit_breaker_states(spark, d):
    events = _stamped(read(spark, d, "events")).withColumn("ok", F.col("event_type") != "error")
    return stateful.breaker_states(events, "user_id", "ts", "event_id", "ok", 2, 86400.0)


from . import assessments, dossiers, reports, stores  # noqa: E402, F401  registers their queries
