"""Exact top-k inner-product search by a three-phase uniform threshold.

A score is the sum of ``LISTS`` local scores, one for each run of components.
Phase 1: every list gives each query its best entries by local score; their
whole scores give a cutoff that the k-th best score cannot lie below. Phase 2:
the cutoff goes back with the queries, and each list gives every entry whose
local score reaches its uniform share of it; a row in no list stays below the
cutoff. Phase 3: what the lists gave is summed up over all lists, and the best
k of those that reach the cutoff stay.

Queries and rows are dealt in blocks. All lists of a block of rows lie in one
task, so what a list lacks is resolved there, and at most k rows leave it for
each query: no pairs are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise

LISTS = 4
DEPTH = 4  # phase 1 gathers DEPTH * k entries of each list: the more, the higher the cutoff
ROW_BLOCK = 8192
QUERY_BLOCK = 1024
AT_ONCE = 256  # queries
EXACT, LONG = float(1 << 53), float(1 << 63)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, x array<bigint>)``: floor(scale * component); rows that hold null, NaN or infinite components, or no vector or id, go.

    A component that no long holds is an error.
    """
    whole = col(vector_col).isNotNull() & F.forall(col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(col(id_col).isNotNull() & F.coalesce(whole, F.lit(False)))
    return rows.select(col(id_col).cast("long").alias("id"), F.transform(col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


def _local(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; through floating point where that is exact."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(q.shape[1], 1)
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most * LISTS < LONG:
        return q @ x.T
    raise OverflowError("scores may exceed a long")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.int64).reshape(len(vectors), -1)


def _cells(queries: DataFrame, rows: DataFrame, k: int, with_cutoff: bool) -> DataFrame:
    """``(query_id, vec_id, score)``: at most k for each query of each pair of blocks."""

    def entries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})]
        if len(left) and len(right):
            # vectors of other lengths have no score with each other
            lengths = left["x"].map(len)
            for dims, part in right.groupby(right["x"].map(len)):
                own, x, ids = left[lengths == dims], _matrix(part["x"]), part["id"].to_numpy()
                lists = np.array_split(np.arange(dims), LISTS)
                for at in range(0, len(own), AT_ONCE):
                    some = own.iloc[at : at + AT_ONCE]
                    q, qid = _matrix(some["x"]), some["id"].to_numpy()
                    local = [_local(q[:, cut], x[:, cut]) for cut in lists]
                    score, other = sum(local), qid[:, None] != ids[None, :]
                    given = np.zeros(score.shape, dtype=bool)
                    if with_cutoff:
                        low = some["cutoff"].to_numpy()[:, None]
                        for part_score in local:
                            given |= LISTS * part_score >= low
                        given &= score >= low
                        given |= some["without"].to_numpy()[:, None]
                    else:
                        deep = min(DEPTH * k, len(ids))
                        for part_score in local:
                            ranked = np.where(other, part_score, np.iinfo(np.int64).min)
                            np.put_along_axis(given, np.argpartition(ranked, len(ids) - deep, axis=1)[:, len(ids) - deep :], True, axis=1)
                    i, j = np.nonzero(given & other)
                    order = np.lexsort((ids[j], -score[i, j], i))
                    i, j = i[order], j[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[best], j[best]
                    out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[j], "score": score[i, j]}))
        return pd.concat(out)

    key = ["row_block", "query_block"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(entries, "query_id long, vec_id long, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows but those with the query's own id. Rows without a usable vector
    or id take no part; vectors of different lengths have no score. Rows that
    repeat an id are candidates each for itself; a query id that repeats ranks
    the scores of all its rows together. Scores or components that a long
    cannot be sure to hold are an error. Queries without candidates give no
    rows, an empty table gives none; other columns are not read.
    """
    rows = materialise(scaled(vectors, id_col, vector_col, scale), "vectors")
    queries = rows.where(F.col("id") % every == 0).select(F.col("id").alias("id"), F.col("x").alias("x"))  # columns of its own, to join with rows
    n, nq = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    block = lambda b: F.pmod(F.xxhash64("id", "x"), F.lit(b)).cast("int")
    every_block = lambda b: F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    dealt = rows.select("id", "x", block(row_blocks).alias("row_block"), every_block(query_blocks).alias("query_block"))
    asked = queries.select("id", "x", block(query_blocks).alias("query_block"), every_block(row_blocks).alias("row_block"))

    ranked = _best(_cells(asked, dealt, k, False), k)
    cutoff = ranked.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    # with fewer than k rows a query goes without a cutoff: every row counts
    cutoff = cutoff.select(F.col("query_id").alias("id"), F.col("low").alias("cutoff"), (F.col("n") < k).alias("without"))
    wanting = asked.join(materialise(cutoff, "cutoffs"), "id")
    best = _best(_cells(wanting, dealt, k, True), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
