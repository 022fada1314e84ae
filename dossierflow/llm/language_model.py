"""Log-probabilities of whole texts under a gated recurrent language model that learns from the corpus itself.

A task splits its texts into words and deals them into blocks of bounded size,
each with the list of its distinct words. The lists are joined with the
corpus-wide counts, and a block's documents become sequences of codes: the
most frequent words have codes of their own, the others one by the size of
their count and by how they are spelt.

The model learns from every document that is not held out, in ``ROUNDS``
passes over disjoint shares of them. In each, every task trains on its own
rows from common weights, and the weights are averaged by the tokens that they
saw. A document is then scored in one go, with the state carried through it.
The driver holds counts of counts and weights, whose sizes depend on the
model alone.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import col, materialise, scratch

BLOCK_WORDS = 250_000  # distinct ones, but for a single longer text
BLOCK_TOKENS = 3_000_000
TRAIN_TOKENS, SCORE_TOKENS = 1_000_000, 3_000_000  # at once
ROUNDS = 4
PIECE = 1 << 14  # weights that travel together
FAN_IN = 32  # tasks whose weights meet in a group
END = b"\n"  # no word holds white space
_LISTS = "block long, place int, word string, seen long, id string, held boolean, places binary"


def held_out(id_col: str = "doc_id", of: int = 7, remainder: int = 2) -> Column:
    """Whether a row is not learnt from; null ids are not."""
    return F.coalesce(F.crc32(col(id_col).cast("long").cast("string")) % of == remainder, F.lit(True))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end of the text."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed, bytes of one weight beside each other."""
    return zlib.compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes(), 1)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number = TaskContext.get().partitionId() << 32

    def frames() -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(held, columns=["id", "held", "places"]).assign(block=number, place=-1, word=None, seen=0)[order]
        words, seen = list(places), np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *learnt]), minlength=len(places))
        for at in range(0, len(words), 1 << 16):
            some = words[at : at + (1 << 16)]
            yield pd.DataFrame({"block": number, "place": np.arange(at, at + len(some), dtype=np.int32), "word": [w.decode() for w in some], "seen": seen[at : at + len(some)], "id": None, "held": False, "places": None})[order]

    order = [c.split()[0] for c in _LISTS.split(", ")]
    def fresh() -> tuple[dict[bytes, int], list, list, int]:
        numbers: dict = defaultdict()
        numbers.default_factory = numbers.__len__
        return numbers, [], [], 0

    places, held, learnt, tokens = fresh()
    for batch in batches:
        for doc, text, out in zip(batch["id"], batch["text"], batch["held"], strict=True):
            words = split_words(text)
            at = np.fromiter(map(places.__getitem__, words), dtype="<u4", count=len(words))
            if not out:
                learnt.append(at)
            held.append((doc, bool(out), _pack(at)))
            tokens += len(words)
            if len(places) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                yield from frames()
                places, held, learnt, tokens = fresh()
                number += 1
    if held:
        yield from frames()


@dataclass
class Counts:
    """Of training tokens: all, distinct, words of their own with their counts, sums of the others' counts by tail class, and how many others occur once and twice."""

    tokens: int
    distinct: int
    words: list[tuple[str, int]]
    tails: np.ndarray
    once: int
    twice: int

    def in_class(self, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Natural log-probability of words within their tail class, 0 for words of their own.

        Counts decide, but that words without one share the class of words
        that occur once, by Good and Turing's estimate.
        """
        unknown = (self.once + 1) / (self.once + 2 * self.twice + 2)
        tail = np.maximum(np.frexp(counts.astype(np.float64))[1] - 1, 0).clip(max=gru.TAILS - 1)
        with np.errstate(divide="ignore"):
            found = np.log(counts / np.maximum(self.tails[tail], 1))
        found = np.where(counts == 1, math.log((1 - unknown) / max(self.once, 1)), np.where(counts == 0, math.log(unknown), found))
        return np.where(own, 0.0, found)


def _tail(count: Column) -> Column:
    return F.when(count < 2, 0).otherwise(F.least(F.lit(gru.TAILS - 1), F.length(F.bin(count)) - 1)).cast("int")


def _counted(counts: DataFrame) -> Counts:
    top = [(r["word"], int(r["n"])) for r in counts.orderBy(F.desc("n"), "word").limit(gru.WORDS).collect()]
    rows = counts.groupBy(_tail(F.col("n")).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()  # a row for each tail class
    tails = np.zeros(gru.TAILS)
    for r in rows:
        tails[r["tail"]] = r["n"]
    for _, n in top:
        tails[min(gru.TAILS, n.bit_length()) - 1] -= n
    left = lambda name, n: sum(int(r[name]) for r in rows) - sum(c == n for _, c in top)
    return Counts(sum(int(r["n"]) for r in rows), sum(int(r["words"]) for r in rows), top, tails, left("once", 1), left("twice", 2))


def _encoded(counts: Counts) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    tokens, distinct = counts.tokens, counts.distinct

    def encoded(held: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        n, code = (np.zeros(len(lists), dtype=np.int64) for _ in range(2))
        n[lists["place"]], code[lists["place"]] = lists["n"], lists["code"]
        base, own = np.log10(n + 1.0), counts.in_class(n, code < gru.WORDS)
        out = []
        for packed in held["places"]:
            at = _unpack(packed, "<u4")
            out.append((len(at), int((n[at] > 0).sum()), float(base[at].sum() - len(at) * math.log10(tokens + distinct + 1)), float(own[at].sum()), _pack(code[at].astype("<u2"))))
        done = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "in_class", "codes"])
        return pd.concat([held[["id", "held"]].reset_index(drop=True), done], axis=1)

    return encoded


def _trained(weights: gru.Weights, rate: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, seen = weights, 0
        for texts in _texts(batches, TRAIN_TOKENS):
            w, n = gru.train(w, [t for _, t in texts], rate)
            seen += n
        if seen:
            flat = w.flat()
            parts = [flat[at : at + PIECE].astype("<f4").tobytes() for at in range(0, len(flat), PIECE)]
            yield pd.DataFrame({"task": TaskContext.get().partitionId(), "piece": range(len(parts)), "tokens": seen, "weights": parts}).astype({"task": "int64", "piece": "int32"})

    return trained


def _texts(batches: Iterator[pd.DataFrame], tokens: int) -> Iterator[list]:
    """Rows with their codes, some ``tokens`` at once."""
    held, n = [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            held.append((row, _unpack(row.codes, "<u2")))
            n += len(held[-1][1])
            if n >= tokens:
                yield held
                held, n = [], 0
    if held:
        yield held


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    """Of one piece, weighed by tokens."""
    tokens = group["tokens"].to_numpy(dtype=np.float64)
    flat = sum(np.frombuffer(w, dtype="<f4") * t for w, t in zip(group["weights"], tokens, strict=True)) / tokens.sum()
    return pd.DataFrame({"task": [group["to"].iloc[0]], "piece": [group["piece"].iloc[0]], "tokens": [int(tokens.sum())], "weights": [flat.astype("<f4").tobytes()]})


def _averaged(parts: DataFrame, tasks: int, weights: gru.Weights) -> gru.Weights:
    """Weights meet in groups of ``FAN_IN`` tasks, the results again, until one is left; what comes to the driver is one set."""
    while True:
        parts = parts.withColumn("to", F.floor(F.col("task") / FAN_IN)).groupBy("piece", "to").applyInPandas(_mean, "task long, piece int, tokens long, weights binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    rows = parts.select("piece", "weights").collect()
    flat = [np.frombuffer(r["weights"], dtype="<f4") for r in sorted(rows, key=lambda r: r["piece"])]
    return weights.filled(np.concatenate(flat)) if flat else weights


@dataclass
class Corpus:
    """``documents`` as codes, in a written table, and the counts that the codes rest on."""

    documents: DataFrame
    counts: Counts


def encode_corpus(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", write: Callable[[DataFrame, str], DataFrame] = materialise) -> Corpus:
    """``(id, held, n_tokens, n_known, base_score, in_class, codes)`` for each row; counts cover every row that is not ``held``.

    A word costs one row for each block that holds it, in the count and in
    the join. The most frequent words, at most ``gru.WORDS``, are broadcast.
    """
    with scratch(docs.sparkSession) as own:
        base = docs.select(col(id_col).cast("long").cast("string").alias("id"), col(text_col).cast("string").alias("text"), held.alias("held"))  # pandas has no nullable longs
        blocks = own(base.mapInPandas(_blocks, _LISTS), "blocks")
        lists = blocks.where("place >= 0").select(F.col("block").alias("of"), "place", "word", "seen")
        known = own(lists.where("seen > 0").groupBy("word").agg(F.sum("seen").alias("n")), "counts")
        counts = _counted(known)
        top = docs.sparkSession.createDataFrame([(w, i) for i, (w, _) in enumerate(counts.words)], "word string, rank int")
        n = F.coalesce("n", F.lit(0))
        bucket = F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(gru.BUCKETS))  # by the last two characters
        code = F.coalesce("rank", (gru.WORDS + _tail(n) * gru.BUCKETS + bucket).cast("int"))
        answers = lists.join(known, "word", "left").join(F.broadcast(top), "word", "left").select("of", "place", n.alias("n"), code.alias("code"))
        texts = blocks.where("place < 0").select("block", "id", "held", "places")
        done = texts.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(_encoded(counts), "id string, held boolean, n_tokens long, n_known long, base_score double, in_class double, codes binary")
        return Corpus(write(done.withColumn("id", F.col("id").cast("long")), "codes"), counts)


def fit(corpus: Corpus, hidden: int = gru.HIDDEN, rounds: int = ROUNDS, rate: float = gru.RATE) -> gru.Weights:
    """Weights from all rows that are not held out, each seen once; without such rows every outcome is as likely as the counts have it."""
    counts = corpus.counts
    weights = gru.begin(np.array([n for _, n in counts.words]), counts.tails, hidden)
    rows = corpus.documents.where("not held").select("codes", F.pmod(F.xxhash64("id", "n_tokens", "in_class"), F.lit(rounds)).alias("share"))
    tasks = rows.rdd.getNumPartitions()
    for r in range(rounds):
        parts = rows.where(F.col("share") == r).select("codes").mapInPandas(_trained(weights, rate / (1 + r / 2)), "task long, piece int, tokens long, weights binary")
        weights = _averaged(parts, tasks, weights)
    return weights


def log_probabilities(corpus: Corpus, weights: gru.Weights, id_col: str = "doc_id") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, logarithms to base ten."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in _texts(batches, SCORE_TOKENS):
            rows, found = [r for r, _ in texts], gru.scores(weights, [t for _, t in texts])
            yield pd.DataFrame({"id": [r.id for r in rows], "held_out": [r.held for r in rows], "n_tokens": [r.n_tokens for r in rows], "n_known": [r.n_known for r in rows], "base_score": [r.base_score for r in rows], "score": (found + np.array([r.in_class for r in rows])) / math.log(10)})

    rows = corpus.documents.withColumn("id", F.col("id").cast("string")).mapInPandas(scored, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select(F.col("id").cast("long").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(corpus.counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_corpus(docs: DataFrame, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", hidden: int = gru.HIDDEN, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of ``docs``, in a written table: learns from rows that are not ``held``, scores all.

    A null or empty text is its end alone. Words that no training document
    has are one event, as they are in ``base_score``, which adds one to every
    count; so the probabilities of all words and of that event sum up to one.
    Null ids are held out and stay; repeated rows count and are scored each
    for itself; an empty table gives an empty one; other columns are not read.
    """
    with scratch(docs.sparkSession) as write:
        corpus = encode_corpus(docs, held_out(id_col) if held is None else held, id_col, text_col, write)
        return materialise(log_probabilities(corpus, fit(corpus, hidden, rounds), id_col), "log-probabilities")
