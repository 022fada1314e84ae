"""One query for each corpus operator, over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, langid, language_model, license_scan, packing, pii, ranked, sharding, simhash, topk, warc
from .common import materialise, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as the plan finds."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts, digest, spans and scores."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, written and read back."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along the curve."""
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=24)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text's ids and of what they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), digests=True)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), hash_all=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence wordings in every whole text."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that two bits link."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, most=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from what is not held out.

    Predictions are written here, where batches of texts to Python are bounded in bytes.
    """
    docs = table(spark, sf_dir, "documents")
    said = langid.identify(docs, langid.fit(docs))
    return materialise(said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"), "languages")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every whole text, learnt from what is not held out."""
    return language_model.score_corpus(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every text, with corpus-wide counts of the linked ids."""
    return alignment.align(table(spark, sf_dir, "documents"))[0]


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of the benchmark."""
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_pii, op3_warc, op4_exact_topk, op5_hilbert_sharding, op6_bpe, op7_exact_dedup, op8_license_scan, op9_simhash_dedup, op10_language_id, op11_lm_scoring, op12_token_alignment, op13_ranked_search)}

ORACLE_SQL = {
    "op4_exact_topk": """
        WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM rows q JOIN rows r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.x) = len(r.x)),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_exact_dedup": r"""
        WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM rows JOIN groups USING (t)""",
    "op13_ranked_search": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        sizes AS (SELECT doc_id, len(t) AS n, t FROM words WHERE len(t) > 0),
        total AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM sizes),
        postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sizes) GROUP BY ALL),
        freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
        asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        scored AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * total.N + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * total.N) // L)))) AS BIGINT) AS score
                   FROM asked JOIN postings p USING (term) JOIN freq USING (term), total GROUP BY ALL),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
