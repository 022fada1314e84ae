"""Five stages that clean ``documents`` and pack what is left for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dossierflow.llm.common import bounded_batches, materialise, table
from dossierflow.llm.exact_dedup import drop_exact_duplicates
from dossierflow.llm.langid import drop_unidentified
from dossierflow.llm.packing import pack
from dossierflow.llm.pii import redact
from dossierflow.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null texts, texts without letters) go.

    As the predictions run when the caller writes them, batches to Python are
    bounded in bytes for the whole session, unless the session bounds them itself.
    """
    bounded_batches(spark)
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: SimHash fingerprints by Golay keys retrieve them, MinHash bands those further apart, and the similarity of five-word shingles decides."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequence that each lies in."""
    return pack(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash_dedup), ("PII", pii), ("best-fit packing", packing)]

#: SQL has no tokenizers, machines or fingerprints; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
