"""A table of vectors that grows by the texts it lacks: key, anti join, embedding in batches, append, read back by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from ..functions.text import normal_for_hash
from .sinks import append_once, batches

CALL = 96  # texts that are embedded together
SCHEMA = StructType().add("key", "string").add("vector", ArrayType(FloatType())).add("held", "boolean").add("call", "string").add("tokens", "long")
Embed = Callable[[list[str]], Sequence[Sequence[float] | None]]


def keyed(texts: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``texts`` with ``key``: a hash of the model's name and the text's normal form; null for null and blank texts, which have no vector."""
    t = F.trim(F.col(text_col))
    return texts.withColumn("key", F.when(t != "", F.sha2(F.concat(F.lit(f"emb:{model}:"), normal_for_hash(t)), 256)))


def add_missing(texts: DataFrame, path: str, run: str, model: str, embed: Embed, dims: int, text_col: str = "text", call: int = CALL) -> None:
    """Embed the texts whose key the table at ``path`` does not hold, and append them as ``run``.

    Each key is embedded once, by its smallest text. Vectors of another
    length, and texts that ``embed`` gives None for, are written as not held:
    this run's readers see them, later runs embed them again. A run that is
    repeated replaces its own rows; one run writes at a time. Texts are
    shuffled once, by key, and meet the keys of the table there; hashes spread
    evenly, and copies are folded ahead of the shuffle.
    """

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, task = 0, TaskContext.get().partitionId()
        for frame in frames:
            for at in range(0, len(frame), call):
                some = frame.iloc[at : at + call]
                found = [None if v is None else [float(x) for x in v] for v in embed(some["text"].tolist())]
                yield pd.DataFrame({"key": some["key"].to_numpy(), "vector": found, "held": [v is not None and len(v) == dims for v in found], "call": f"{task}-{number}", "tokens": some["text"].str.split().map(len).to_numpy()})
                number += 1

    wanted = keyed(texts, model, text_col).where("key is not null").groupBy("key").agg(F.min(F.trim(F.col(text_col))).alias("text"))
    held = batches(texts.sparkSession, path, SCHEMA, "run").where((F.col("run") != run) & F.col("held")).select("key")
    append_once(wanted.join(held, "key", "left_anti").mapInPandas(vectors, SCHEMA), run, path, "run")


def with_vectors(texts: DataFrame, path: str, run: str, model: str, text_col: str = "text") -> DataFrame:
    """``texts`` with ``key``, ``vector`` and the ``run`` that it comes from, as of ``run``; rows without a vector stay, with nulls."""
    store = batches(texts.sparkSession, path, SCHEMA, "run").where(F.col("held") | (F.col("run") == run))
    return keyed(texts, model, text_col).join(store.select("key", "vector", "run"), "key", "left")


def call_stats(spark: SparkSession, path: str) -> DataFrame:
    """``(run, calls, texts, tokens, ok)``: sums over the calls of each run; ``ok`` where every text got a vector of the right length."""
    store = batches(spark, path, SCHEMA, "run")
    calls = store.groupBy("run", "call").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), F.bool_and("held").alias("ok"))
    return calls.groupBy("run").agg(F.count("*").alias("calls"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), F.bool_and("ok").alias("ok"))
