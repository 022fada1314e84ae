"""Ranked lexical search over document-sharded postings.

A task deals its documents into shards of bounded size and writes the postings
of each in compressed sparse rows: a shard's terms, where each one's postings
start, the documents in them and the integer impact of the term there. Items
are answered in blocks: in each shard every item adds the weighted impacts of
its terms, one term after another, to a dense row of sums, and leaves its best
documents, ties included; Spark keeps the best of all shards.

No posting is shuffled. What moves is, for each shard and item, at most the
number of documents asked for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, scratch

SHARD_TERMS = 1_000_000  # with repeats, but for a single longer text
SHARD_DOCS = 1 << 16
BLOCK_BYTES = 4 << 20  # of the items' terms
IMPACT = 1_000_000_000
#: Fixed values of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SHARD = "terms binary, starts binary, docs binary, counts binary, ids array<long>, sizes binary, n_docs long, n_terms long"


def split_terms(text: str | None) -> list[bytes]:
    """UTF-8 terms of a text; bytes of characters beyond ASCII belong to terms."""
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


@dataclass
class Index:
    """``shards`` has a row for each shard, with impacts; ``docs`` documents hold ``terms`` terms, with repeats."""

    shards: DataFrame
    docs: int
    terms: int


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def shard() -> pd.DataFrame:
        n_docs, flat = len(ids), np.concatenate([np.empty(0, dtype=np.int64), *held])
        key, counts = np.unique(flat, return_counts=True)  # by term, then by document
        term = key // SHARD_DOCS
        starts = np.searchsorted(term, np.arange(len(vocab) + 1)).astype("<u4")
        row = (b"\n".join(vocab), starts.tobytes(), (key % SHARD_DOCS).astype("<u2").tobytes(), counts.astype("<u4").tobytes(), ids, np.array(sizes, dtype="<i8").tobytes(), n_docs - sizes.count(0), len(flat))
        return pd.DataFrame([row], columns=[c.split()[0] for c in _SHARD.split(", ")])

    def fresh() -> tuple[dict, list, list, list]:
        numbers: dict = defaultdict()
        numbers.default_factory = numbers.__len__
        return numbers, [], [], []

    vocab, ids, sizes, held = fresh()
    n = 0
    for batch in batches:
        for doc, text in zip(batch["id"], batch["text"], strict=True):
            words = split_terms(text)
            held.append(np.fromiter(map(vocab.__getitem__, words), dtype=np.int64, count=len(words)) * SHARD_DOCS + len(ids))
            ids.append(None if doc is None else int(doc))
            sizes.append(len(words))
            n += len(words)
            if n >= SHARD_TERMS or len(ids) >= SHARD_DOCS:
                yield shard()
                vocab, ids, sizes, held = fresh()
                n = 0
    if ids:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Shards of all documents, in written tables. Null texts hold no terms; repeated rows are documents each; null ids stay.

    Impacts need the mean size of a document, so the counts are written first,
    summed up, and turned into impacts where they lie.
    """
    with scratch(docs.sparkSession) as write:
        base = docs.select(col(id_col).cast("long").cast("string").alias("id"), col(text_col).cast("string").alias("text"))  # pandas has no nullable longs
        shards = write(base.mapInPandas(_sharded, _SHARD), "counts")
        sums = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
        n_docs, n_terms = int(sums["docs"]), int(sums["terms"])

        def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for at, counts, sizes in zip(batch["docs"], batch["counts"], batch["sizes"], strict=True):
                    # whole numbers of any size until the quotient is taken
                    m = np.array([10 + 90 * n * n_docs // n_terms if n_terms else 0 for n in np.frombuffer(sizes, dtype="<i8").tolist()], dtype=np.int64)
                    tf = np.frombuffer(counts, dtype="<u4").astype(np.int64)
                    out.append((IMPACT * tf // (1000 * tf + 8 * m[np.frombuffer(at, dtype="<u2")])).astype("<u4").tobytes())
                yield batch.drop(columns=["counts", "sizes"]).assign(impacts=out)

        impacts = shards.drop("n_docs", "n_terms").mapInPandas(weighed, "terms binary, starts binary, docs binary, ids array<long>, impacts binary")
        return Index(materialise(impacts, "postings"), n_docs, n_terms)


def _asked(items: DataFrame, id_col: str, text_col: str, write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, int]:
    """``(item, id)``, ``(block, item, term)`` and the number of blocks."""
    named = items.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).distinct()
    named = write(named.withColumn("item", F.monotonically_increasing_id()), "items")
    words = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    terms = write(named.select("item", F.explode(words).alias("term")), "terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    return named.select("item", "id"), terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")), blocks


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, asked, terms, starts in zip(batch["block"], batch["asked"], batch["terms"], batch["starts"], strict=True):
            wanted, n = {t.encode() for t in asked}, np.diff(np.frombuffer(starts, dtype="<u4").astype(np.int64))
            found = [(t.decode(), int(n[i])) for i, t in enumerate(terms.split(b"\n")) if t in wanted]
            yield pd.DataFrame({"block": block, "term": [t for t, _ in found], "df": [c for _, c in found]}).astype({"block": "int32", "term": object, "df": "int64"})


def _best(sums: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest sums above 0; of equal ones those with smaller ids, null ids last."""
    at = np.flatnonzero(sums > 0)
    if len(at) > k:
        least = sums[at[np.argpartition(sums[at], len(at) - k)[len(at) - k :]]].min()
        at = at[sums[at] >= least]
    return at[np.lexsort((ids[at], nulls[at], -sums[at]))[:k]]


def _scored(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asked, terms, starts, docs, impacts, ids in zip(batch["asked"], batch["terms"], batch["starts"], batch["docs"], batch["impacts"], batch["ids"], strict=True):
                starts, docs, impacts = np.frombuffer(starts, dtype="<u4"), np.frombuffer(docs, dtype="<u2"), np.frombuffer(impacts, dtype="<u4").astype(np.int64)
                nulls = np.array([i is None or i != i for i in ids], dtype=bool)
                numbers = np.array([0 if no else int(i) for i, no in zip(ids, nulls, strict=True)], dtype=np.int64)
                wanted = {x["term"].encode() for x in asked}
                place = {t: i for i, t in enumerate(terms.split(b"\n")) if t in wanted}
                sums_of: dict[int, np.ndarray] = {}
                for x in asked:  # a block's terms come item by item
                    if (i := place.get(x["term"].encode())) is not None:
                        if x["item"] not in sums_of:
                            sums_of[x["item"]] = np.zeros(len(numbers), dtype=np.int64)
                        own = slice(starts[i], starts[i + 1])
                        sums_of[x["item"]][docs[own]] += x["w"] * impacts[own]
                out = []
                for item, sums in sums_of.items():
                    out += [(item, None if nulls[i] else str(numbers[i]), int(sums[i])) for i in _best(sums, numbers, nulls, k)]
                yield pd.DataFrame(out, columns=["item", "doc", "score"]).astype({"item": "int64", "doc": object, "score": "int64"})

    return scored


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k documents with the highest scores above 0, all if there are fewer; written already.

    Equal scores are ordered by ascending id, null ids last. Items that are
    null or hold no term have no rows; of items with equal ids and texts one is
    answered, with equal ids and other texts each. Blocks of items hold some
    ``BLOCK_BYTES`` of terms and are broadcast one after another.
    """
    with scratch(items.sparkSession) as write:
        named, terms, blocks = _asked(items, item_col, text_col, write)
        parts = []
        for b in range(blocks):
            asked = terms.where(F.col("block") == b).groupBy("block").agg(F.collect_set("term").alias("asked"))
            parts.append(write(index.shards.select("terms", "starts").crossJoin(F.broadcast(asked)).mapInPandas(_document_counts, "block int, term string, df long"), "df"))  # one row, of a block's size
        df = _union(parts).groupBy("block", "term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln((F.lit(2 * index.docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
        weighed = write(terms.join(df, ["block", "term"]).select("block", "item", "term", weight.alias("w")), "weights")
        parts = []
        for b in range(blocks):
            asked = weighed.where(F.col("block") == b).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "term", "w"))).alias("asked"))
            parts.append(write(index.shards.crossJoin(F.broadcast(asked.drop("block"))).mapInPandas(_scored(k), "item long, doc string, score long"), "scores"))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = _union(parts).select("item", F.col("doc").cast("long").alias("doc_id"), "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return materialise(best.join(named, "item").select(F.col("id").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score"), "ranked")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
