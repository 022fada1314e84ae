"""Queries on tables that grow: stored vectors, upserts and children, streamed counts and sketches; and texts in their compatibility form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, unicode, vectors
from ..operators import relational
from ..sources import sinks, vector_store
from ..sources.shared import new_folder
from ..streaming import rolling
from .registry import query, read

DIMS = 512
MODEL = f"hashed-{DIMS}"


def key_sql(column: str) -> str:
    """The key of a stored vector; null for null and blank texts."""
    out = f"trim({column})"
    for pattern, put in ((r"\r\n?", "chr(10)"), (f"{text.ZERO_WIDTH}", "''"), (r"[ \t]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^[\s\v]+|[\s\v]+$", "''")):
        out = f"regexp_replace({out}, '{pattern}', {put}, 'g')"
    return f"CASE WHEN trim({column}) <> '' THEN sha256('emb:{MODEL}:' || lower({out})) END"


def _embedded(spark: SparkSession, d: str) -> str:
    """Three runs: items, documents, both again; the last finds nothing to embed."""
    path = new_folder(spark, "vectors")
    items, docs = read(spark, d, "benchmark").select("text"), read(spark, d, "documents").select("text")
    for run, texts in (("items", items), ("documents", docs), ("again", docs.unionByName(items))):
        vector_store.add_missing(texts, path, run, MODEL, vectors.hashed_vectors, DIMS)
    return path


@query(rf"""WITH k AS (SELECT doc_id, text, {key_sql('text')} AS key FROM documents), i AS (SELECT DISTINCT {key_sql('text')} AS key FROM benchmark)
    SELECT doc_id, k.key, CASE WHEN k.key IS NULL THEN NULL WHEN i.key IS NULL THEN 'documents' ELSE 'items' END AS run, CASE WHEN k.key IS NOT NULL THEN {DIMS} END AS dims,
        CASE WHEN k.key IS NULL THEN NULL WHEN regexp_matches(lower(text), '[a-z0-9+#.]{{2}}') THEN 1e0 ELSE 0e0 END AS norm FROM k LEFT JOIN i ON i.key = k.key""")
def stored_embeddings(spark, d):
    """Every document with the vector that is stored for its text, and the run that put it there."""
    path = _embedded(spark, d)
    docs = vector_store.with_vectors(read(spark, d, "documents").select("doc_id", "text"), path, "again", MODEL)
    norm = F.round(F.sqrt(vectors.dot(F.col("vector"), F.col("vector"))), 3)
    return docs.select("doc_id", "key", "run", F.size("vector").alias("dims"), norm.alias("norm"))


@query(f"""WITH i AS (SELECT DISTINCT {key_sql('text')} AS key FROM benchmark), k AS (SELECT DISTINCT {key_sql('text')} AS key FROM documents),
    r AS (SELECT 'items' AS run, key FROM i UNION ALL SELECT 'documents', key FROM k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.key = k.key))
    SELECT run, count(*) AS texts, true AS ok FROM r WHERE key IS NOT NULL GROUP BY 1""")
def embedding_runs(spark, d):
    """How many texts each run embedded; runs without any are not there."""
    return vector_store.call_stats(spark, _embedded(spark, d)).select("run", "texts", "ok")


# upserts and children ----------------------------------------------------------------------------


@query("""WITH u AS (SELECT o_custkey AS k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1), s AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer)
    SELECT k, coalesce(u.v, s.v) AS last, coalesce(s.v, u.v) AS first, CAST((u.v IS NOT NULL)::INT + (s.v IS NOT NULL)::INT AS BIGINT) AS versions FROM s FULL JOIN u USING (k)""")
def repeated_upserts(spark, d):
    """Customers' segments as a seed, the priorities of their last orders as an upsert that comes twice."""
    path = new_folder(spark, "upserts")
    seed = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    changes = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    for number, rows in ((0, seed), (1, changes), (1, changes)):
        sinks.append_once(rows, number, path)
    log = sinks.batches(spark, path, seed.schema)
    last, first = (sinks.current(log, ["k"], update=u).withColumnRenamed("v", n) for u, n in ((True, "last"), (False, "first")))
    return last.join(first, "k").join(log.groupBy("k").agg(F.count("*").alias("versions")), "k")


@query("""SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS place, l_linenumber, l_partkey
    FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def inserted_children(spark, d):
    """Lines of orders, nested, then inserted as rows of their own; the insert comes twice."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey"]
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *fields)
    orders = relational.nested(read(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", fields, "lines", newest=False)
    path = new_folder(spark, "children")
    for _ in range(2):
        sinks.children_once(orders, "o_orderkey", "lines", 0, path)
    schema = orders.select("o_orderkey", F.posexplode("lines").alias("place", "item")).select("o_orderkey", "place", "item.*").schema
    return sinks.batches(spark, path, schema).select("o_orderkey", "place", "l_linenumber", "l_partkey")


# streams -----------------------------------------------------------------------------------------

WINDOWS = {"day_1": 1, "days_7": 7, "days_30": 30}


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark: SparkSession, d: str, files: int = 1000) -> DataFrame:
    """The files of ``events``, which may be one file or a folder, as a stream."""
    schema = read(spark, d, "events").schema
    only = f"{d}/events.parque[t]"  # a pattern of one name: a stream's path must be one, and no other table's may meet it
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(only).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """A file stream of ``events``: each micro-batch leaves its counts, which are summed up."""
    folder = new_folder(spark, "daily")
    day = F.to_date("ts").alias("day")
    sinks.fold_stream(_event_stream(spark, d), lambda rows: rows.groupBy(day, "event_type").agg(F.count("*").alias("n")), f"{folder}/counts", f"{folder}/state")
    schema = _events(spark, d).select(day, "event_type", F.lit(0).cast("long").alias("n")).schema
    return sinks.batches(spark, f"{folder}/counts", schema).groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def _rolling_sql(columns: str) -> str:
    counts = ", ".join(f"count(DISTINCT u) FILTER (d > day - {days}) AS {n}" for n, days in WINDOWS.items())
    return f"""WITH e AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS day FROM e),
        r AS (SELECT day, {counts} FROM s LEFT JOIN e ON d <= day AND d > day - 30 GROUP BY 1) SELECT {columns} FROM r"""


@query(_rolling_sql("*"))
def rolling_actives(spark, d):
    return rolling.rolling_exact(_events(spark, d), "user_id", "ts", WINDOWS)


@query(_rolling_sql("*, true AS estimates_hold"))
def rolling_actives_stream(spark, d):
    """Sketches that a stream of ``events`` leaves, merged over windows, beside the exact counts: each within four standard errors."""
    folder = new_folder(spark, "actives")
    sinks.fold_stream(_event_stream(spark, d), lambda rows: rolling.daily_sketches(rows, "user_id", "ts"), f"{folder}/sketches", f"{folder}/state")
    schema = _events(spark, d).select(F.to_date("ts").alias("day"), F.lit(b"").alias("sketch")).schema
    estimates = rolling.rolling_estimates(sinks.batches(spark, f"{folder}/sketches", schema), WINDOWS).select("day", *[F.col(n).alias(f"about_{n}") for n in WINDOWS])
    both = rolling_actives(spark, d).join(estimates, "day", "full")
    holds = F.lit(True)
    for n in WINDOWS:
        holds = holds & F.coalesce(F.abs(F.col(n) - F.col(f"about_{n}")) <= 1 + 4 * 1.04 / 2 ** (rolling.LG_K / 2) * F.col(n), F.lit(False))
    return both.select("day", *WINDOWS, holds.alias("estimates_hold"))


# texts -------------------------------------------------------------------------------------------


@query()
def compatibility_forms(spark, d):
    """Every document's text in its compatibility form: whether that differs, and digests of what is hashed and of what is grounded."""
    docs = unicode.with_nfkc(read(spark, d, "documents").select("doc_id", "text"), "text", "form")
    return docs.select("doc_id", (F.col("form") != F.col("text")).alias("changed"), F.sha2(text.normal_for_hash(F.col("form")), 256).alias("hashed"), F.sha2(text.normal_for_grounding(F.col("form")), 256).alias("grounded"))
