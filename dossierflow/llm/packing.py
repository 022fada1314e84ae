"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) comes to
the driver. A configuration is a multiset of lengths that fits a sequence;
the covering program over configurations is solved by multiplicative weights,
each round priced by a knapsack dynamic program, and rounded down; what
rounding leaves is packed best fit, longest first. The plan's size depends on
the capacity, not on the corpus. Spark ranks the pieces of each length and
joins ranks to the plan's slots.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CAPACITY = 2048
END_ID = 0
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """``text -> uint32 ids`` for a byte-level BPE file of the tokenizers library.

    The vocabulary is run by tiktoken, which gives the same ids several times
    faster; where it refuses a text, the tokenizers library itself encodes it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the library's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    return slow


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each text's ids and an end id, cut only where longer than ``capacity``.

    The first piece takes the remainder. A null or empty text is its end id
    alone; repeated rows are packed each; an empty table has no pieces.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : start + (capacity if piece else first)]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    base = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas has no nullable longs
    pieces = base.mapInPandas(cut, "id string, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return pieces.withColumn("id", F.col("id").cast("long"))


def _price(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: the greatest worth for each capacity, and the length taken last."""
    value, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        sums = worth[1 : c + 1] + value[c - 1 :: -1] if c > 1 else worth[1:2] + value[:1]
        took[c] = best = sums.argmax() + 1
        value[c] = sums[best - 1]
    return value, took


def _fractional(counts: np.ndarray, capacity: int, rounds: int, batch: int = 96, near: float = 0.02) -> dict[tuple, float]:
    """Multiplicative weights over the lengths: ``{configuration: times}`` that covers the counts about evenly."""
    active = np.flatnonzero(counts)
    need = counts[active].astype(float)
    at = {int(n): i for i, n in enumerate(active)}
    covered, times = np.zeros(len(active)), defaultdict(float)
    rate = np.log(len(active) + 1) * 4
    for _ in range(rounds):
        worth = np.zeros(capacity + 1)
        worth[active] = np.exp(-rate * np.minimum(covered - covered.min(), 50 / rate)) / need
        value, took = _price(worth, capacity)
        seeds = worth[active] + value[capacity - active]
        order = np.argsort(-seeds)[:batch]
        for i in order[seeds[order] >= (1 - near) * value[capacity]]:
            room, items = capacity, defaultdict(int)
            n = int(active[i])
            while True:
                if worth[n] > 0 and items[n] < counts[n]:
                    items[n] += 1
                room -= n
                if room <= 0 or value[room] <= 0:
                    break
                n = int(took[room])
            items = {n: a for n, a in items.items() if a}
            step = min(need[at[n]] / a for n, a in items.items())
            for n, a in items.items():
                covered[at[n]] += step * a / need[at[n]]
            times[tuple(sorted(items.items(), reverse=True))] += step
        if covered.min() >= 1:
            break
    scale = max(float(np.average(covered, weights=need * active)), 1e-9)
    return {p: t / scale for p, t in times.items()}


def _best_fit(left: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Best fit, longest first; sequences in the same state are handled together."""
    open_: dict[int, dict[tuple, int]] = defaultdict(dict)  # room left -> contents -> how many
    rooms: set[int] = set()
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                room, held, have = capacity, (), todo
            else:
                held, have = open_[room].popitem()
                if not open_[room]:
                    rooms.discard(room)
            each = min(room // n, todo)
            used = min(have, todo // each)
            if held and have > used:
                open_[room][held] = have - used
                rooms.add(room)
            new = (*held, (n, each))
            rest = room - n * each
            open_[rest][new] = open_[rest].get(new, 0) + used
            rooms.add(rest)
            todo -= used * each
    out: dict[tuple, int] = defaultdict(int)
    for contents in open_.values():
        for held, k in contents.items():
            out[held] += k
    return out


def configurations(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 160) -> list[tuple[tuple, int]]:
    """``[(((length, copies), ...), sequences), ...]`` that holds exactly ``counts[length]`` pieces of each length."""
    counts = counts.astype(np.int64).copy()
    fixed: dict[tuple, int] = defaultdict(int)
    if counts[capacity]:
        fixed[((capacity, 1),)] = int(counts[capacity])
        counts[capacity] = 0
    if not counts.any():
        return list(fixed.items())
    best = None
    shares = sorted(_fractional(counts, capacity, rounds).items(), key=lambda x: (-x[1], x[0]))
    full = lambda p: sum(n * a for n, a in p) >= 0.995 * capacity
    for up in (0.0, 0.5, 1.0):  # how far a configuration's times are rounded up at most, where it fills its sequence
        left, taken = counts.copy(), defaultdict(int)
        for p, t in shares:
            k = min(int(t + (up if full(p) else 0)), *(int(left[n]) // a for n, a in p))
            if k:
                taken[p] += k
                for n, a in p:
                    left[n] -= k * a
        for p, k in _best_fit(left, capacity).items():
            taken[p] += k
        if best is None or sum(taken.values()) < sum(best.values()):
            best = taken
    return [*fixed.items(), *best.items()]


def _plan(shapes: list[tuple[tuple, int]]) -> pd.DataFrame:
    """A row for each run of ranks of a length that goes to the same configuration."""
    rows, used, sequence = [], defaultdict(int), 0
    for shape, k in shapes:
        offset = 0
        for n, a in shape:
            rows.append((n, used[n], used[n] + k * a, a, sequence, offset))
            used[n] += k * a
            offset += n * a
        sequence += k
    return pd.DataFrame(rows, columns=["n", "low", "high", "copies", "first_sequence", "first_offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see :func:`token_pieces` for the other columns and for nulls."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity, tokenizer, id_col, text_col, with_ids), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    plan = spark.createDataFrame(_plan(configurations(histogram, capacity)), "n long, low long, high long, copies long, first_sequence long, first_offset long")
    # ranks within a length: the pieces of a frequent length are dealt to many salts
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("k"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("n2"), F.col("salt").alias("salt2"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("i", F.row_number().over(within) - 1)
    ranked = ranked.join(sums, (F.col("length") == F.col("n2")) & (F.col("salt") == F.col("salt2"))).withColumn("rank", F.col("before") + F.col("i"))
    # the plan has a few rows for each length, whatever the corpus
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("n")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.expr("(rank - low) div copies")).alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("copies")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
