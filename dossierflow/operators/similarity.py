"""Cosines of a stated query set with all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numeric import SIMILARITY_BANDS

ROW_BLOCK, QUERY_BLOCK = 8192, 512


def label_similarity(rows: DataFrame, every: int, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(vec_id, label, similarity, best, n_0, ...)`` for rows ``(vec_id, label, embedding)`` and queries, the ids divisible by ``every``.

    Of each label's rows but the query itself: the greatest cosine (0 to 1),
    the smallest id that has it, and how many lie in each band and below all.
    Both sides are dealt in blocks that meet by an equi-join; each pair of
    blocks is one product of matrices, aggregated where it is made.
    """
    bands = [least for least, _ in SIMILARITY_BANDS]
    unit = rows.select("vec_id", "label", vectors.unit(F.col("embedding")).alias("v"))
    asked = unit.where(F.col("vec_id") % every == 0)
    n, nq = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    blocks, query_blocks = max(1, -(-n // row_block)), max(1, -(-nq // query_block))
    block = lambda b: F.pmod(F.xxhash64("vec_id"), F.lit(b)).cast("int")
    each = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    dealt = unit.select("vec_id", "label", "v", block(blocks).alias("row_block"), each(query_blocks).alias("query_block"))
    asked = asked.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), block(query_blocks).alias("query_block"), each(blocks).alias("row_block"))
    names = ["vec_id", "label", "similarity", "best", *(f"n_{k}" for k in range(len(bands) + 1))]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("vec_id")
            q, qid = np.array(left["v"].tolist(), dtype=np.float64), left["vec_id"].to_numpy()
            for label, part in right.groupby("label"):
                x, ids = np.array(part["v"].tolist(), dtype=np.float64), part["vec_id"].to_numpy()
                c = np.clip(q @ x.T, 0, 1)
                other = qid[:, None] != ids[None, :]
                c = np.where(other, c, -1)
                top = c.argmax(axis=1)
                low = [np.inf, *bands, 0.0]
                counts = [((c >= low[k + 1]) & (c < low[k])).sum(axis=1) for k in range(len(bands) + 1)]
                held = other.any(axis=1)
                out.append(pd.DataFrame({"vec_id": qid, "label": label, "similarity": c[np.arange(len(qid)), top], "best": ids[top]} | {f"n_{k}": n for k, n in enumerate(counts)})[held])
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="float64" if c == "similarity" else "int64") for c in names})

    key = ["row_block", "query_block"]
    kinds = "vec_id long, label int, similarity double, best long, " + ", ".join(f"{n} long" for n in names[4:])
    found = asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(score, kinds)
    best = F.max(F.struct("similarity", (-F.col("best")).alias("best"))).alias("top")
    out = found.groupBy("vec_id", "label").agg(best, *[F.sum(n).alias(n) for n in names[4:]])
    return out.select("vec_id", "label", F.col("top.similarity").alias("similarity"), (-F.col("top.best")).alias("best"), *names[4:])
