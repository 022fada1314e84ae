"""Alignment of two tokenizers over the same bytes.

A task encodes whole texts with both tokenizers. Cumulated byte lengths give
the ends of their tokens, the ends that both have cut a text into groups, and
each group links its A tokens with its B tokens. How many documents link a pair
of ids is counted in two shuffles, the first salted; the counts then go back to
the documents.

A task deals its documents into blocks of bounded size. A document keeps its
pairs as places in the list of its block's distinct pairs, and only these lists
are counted and joined: a pair costs one row for each block that holds it,
however many documents link it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch
from .packing import SPLIT_PATTERN

BLOCK_PAIRS = 500_000  # distinct ones, but for a single longer text
BLOCK_BYTES = 4 << 20  # of packed documents
AT_ONCE = 400_000  # links expanded at once
SALTS = 8
_LOW = np.int64(0xFFFFFFFF)
_COLUMNS = "block long, place int, pair long, docs long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=4)
def _byte_level(path: str):
    """``(text -> ids, bytes of each id)`` for a byte-level BPE file of the tokenizers library; special tokens in a text are plain text.

    The vocabulary is run by tiktoken, which gives the same ids several times
    faster; where it refuses a text, the tokenizers library itself encodes it.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
    fast = tiktoken.Encoding("plain", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    slow.encode_special_tokens = True

    def encode(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.int64)  # does not look for special tokens, of which there are none
        except BaseException as e:  # the library's panics are no Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.int64)

    known = {i: b for b, i in ranks.items()} | special
    return encode, [known.get(i, b"") for i in range(max(known) + 1)]


@functools.lru_cache(maxsize=4)
def _pieces(path: str):
    """The same for a sentencepiece model: U+2581 is a space, ``<0xHH>`` a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    of = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    return (lambda text: np.array(model.encode(text, num_threads=1), dtype=np.int64)), [of(i) for i in range(model.get_piece_size())]


class Aligner:
    """Encodes texts with both tokenizers and aligns them."""

    def __init__(self, a: str, b: str) -> None:
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = _byte_level(a), _pieces(b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        most = len(str(max(len(self.bytes_a), len(self.bytes_b))))
        shown = [str(i).encode().ljust(most, b"\0") + b"," for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.digits = np.frombuffer(b"".join(shown), dtype=np.uint8).reshape(len(shown), most + 1)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where the text is null or empty or one of them does not give its bytes back."""
        if not text:
            return None
        raw = b" " + text.encode("utf-8", "replace")
        a, b = self.encode_a(" " + text), self.encode_b(text)
        same = all(b"".join(map(table.__getitem__, ids.tolist())) == raw for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))
        return (a, b) if same else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The group of each token, and how many there are: both tokenizers end a token where a group ends."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.zeros(end_a[-1] + 1, dtype=np.int8)
        ends[end_a] = 1
        shared = ends[end_b] == 1
        ends[end_a] = 0
        ends[end_b[shared]] = 1
        number = np.cumsum(ends, dtype=np.int64) - ends  # of a place: how many groups end ahead of it
        return number[end_a], number[end_b], int(np.count_nonzero(shared))

    def shown(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: tokens take their places group by group, A ahead of B."""
        out = np.empty((len(a) + len(b), self.digits.shape[1]), dtype=np.uint8)
        size_b = np.bincount(of_b, minlength=n)
        sum_a, sum_b = np.cumsum(np.bincount(of_a, minlength=n)), np.cumsum(size_b)
        at_a = np.arange(len(a)) + (sum_b - size_b)[of_a]
        at_b = np.arange(len(b)) + sum_a[of_b]
        out[at_a], out[at_b] = self.digits[a], self.digits[b]
        out[at_a[sum_a - 1], -1], out[at_b[sum_b - 1], -1] = ord("|"), ord(";")
        flat = out.ravel()
        return flat[flat != 0].tobytes()[:-1]


def links(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, n: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """``(pairs, links)``: the distinct pairs ``a << 32 | b`` and how often tokens of a group make them.

    A long stretch in which the tokenizers share no end would make as many
    links as the product of its tokens: beyond ``at_once`` links equal ids of a
    group are counted first, and what is left is expanded part by part.
    """
    size_b = np.bincount(of_b, minlength=n)
    first_b, times = np.cumsum(size_b) - size_b, size_b[of_a]
    if int(times.sum()) <= at_once:  # each link counts once
        t = np.repeat(np.arange(len(a)), times)
        at = np.arange(len(t)) + (first_b[of_a] - np.cumsum(times) + times)[t]
        return _runs(np.sort(a[t] << 32 | b[at]))
    (a, of_a, wa), (b, of_b, wb) = _counted(a, of_a), _counted(b, of_b)
    size_b = np.bincount(of_b, minlength=n)
    first_b, times = np.cumsum(size_b) - size_b, size_b[of_a]
    part = (np.cumsum(times) - 1) // at_once
    keys, sums = [], []
    for start, end in zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(part, np.arange(part[-1] + 2))), strict=True):
        if start == end:
            continue
        t = times[start:end]
        before = np.repeat(np.cumsum(t) - t, t)
        at = np.repeat(first_b[of_a[start:end]], t) + np.arange(len(before)) - before
        k, w = _summed(np.repeat(a[start:end] << 32, t) | b[at], np.repeat(wa[start:end], t) * wb[at])
        keys.append(k)
        sums.append(w)
    return (keys[0], sums[0]) if len(keys) == 1 else _summed(np.concatenate(keys), np.concatenate(sums))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of what is in order, and how often each occurs."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.diff(first, append=len(ordered))


def _counted(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique(of << 32 | ids, return_counts=True)
    return key & _LOW, key >> 32, count


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights[order], first)


class _Block:
    """Distinct pairs in order of first occurrence, with the documents that hold them."""

    def __init__(self, key: int) -> None:
        self.key, self.rows, self.size = key, [], 0
        self.known: dict[int, int] = defaultdict()  # the place of each pair
        self.docs = np.zeros(1024, dtype=np.int64)  # by place, with room for more

    def add(self, pairs: np.ndarray) -> np.ndarray:
        self.known.default_factory = self.known.__len__  # a new pair takes the next place
        places = np.fromiter(map(self.known.__getitem__, pairs.tolist()), dtype=np.int64, count=len(pairs))
        self.known.default_factory = None
        if len(self.known) > len(self.docs):
            self.docs = np.append(self.docs, np.zeros(len(self.known), dtype=np.int64))
        self.docs[places] += 1
        return places

    def frame(self) -> pd.DataFrame:
        n = len(self.known)
        lists = pd.DataFrame({"place": np.arange(n), "pair": np.fromiter(self.known, dtype=np.int64, count=n), "docs": self.docs[:n]})
        docs = pd.DataFrame(self.rows, columns=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed"]).assign(place=-1, pair=0, docs=0)
        lists = lists.assign(id=None, n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", packed=None) if n else docs[:0]
        return pd.concat([docs, lists]).assign(block=self.key)[[c.split()[0] for c in _COLUMNS.split(", ")]]


def _pack(places: np.ndarray, times: np.ndarray) -> bytes:
    """Places in order, as differences, with how often each occurs; bytes of one weight beside each other."""
    order = np.argsort(places)
    both = np.concatenate([np.diff(places[order], prepend=0), times[order]]).astype("<i8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``, both written already.

    ``documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256)``: a row for each row of ``docs``. Texts that are null or
    empty, or that one tokenizer does not give back, have zeros and an empty
    digest. ``pairs (a, b, docs, best)``: how many documents link the ids, and
    whether no other B id is linked with the A id in more; ties are all best.
    Repeated rows count each for itself, null ids stay, other columns are not
    read, and an empty table gives two empty ones.
    """
    a, b = tokenizers or default_tokenizers()

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_both, number = Aligner(a, b), TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                found = with_both.tokens(text)
                if found is None:
                    block.rows.append((doc, 0, 0, 0, 0, "", None))
                    continue
                of_a, of_b, n = with_both.groups(*found)
                pairs, times = links(*found, of_a, of_b, n)
                packed = _pack(block.add(pairs), times)
                block.size += len(packed) + 128
                block.rows.append((doc, len(found[0]), len(found[1]), n, int(times.sum()), hashlib.sha256(with_both.shown(*found, of_a, of_b, n)).hexdigest(), packed))
                if block.size >= BLOCK_BYTES or len(block.known) >= BLOCK_PAIRS:
                    yield block.frame()
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield block.frame()

    def counted(held: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        docs_, best = (np.zeros(int(lists["place"].max()) + 1 if len(lists) else 0, dtype=np.int64) for _ in range(2))
        docs_[lists["place"]], best[lists["place"]] = lists["docs"], lists["best"]
        sums = []
        for packed in held["packed"]:
            places, times = _unpack(packed) if packed is not None else (np.empty(0, dtype=np.int64),) * 2
            sums.append((int((times * best[places]).sum()), int((times * docs_[places]).sum())))
        return held.assign(n_best=[x for x, _ in sums], count_sum=[y for _, y in sums])[["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    with scratch(docs.sparkSession) as write:
        base = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas has no nullable longs
        blocks = write(base.mapInPandas(aligned, _COLUMNS), "blocks")
        lists, held = blocks.where("place >= 0").select(F.col("block").alias("of"), "place", "pair", "docs"), blocks.where("place < 0").drop("place", "pair", "docs")
        parts = lists.groupBy("pair", F.pmod(F.xxhash64("of"), F.lit(SALTS)).alias("salt")).agg(F.sum("docs").alias("docs"))
        pairs = write(parts.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)), "pairs")
        top = F.broadcast(pairs.groupBy("a").agg(F.max("docs").alias("top")))  # a row for each id of A's vocabulary at most
        pairs = materialise(pairs.join(top, "a").select("a", F.col("pair").bitwiseAND(F.lit(int(_LOW))).alias("b"), "docs", (F.col("docs") == F.col("top")).alias("best")), "pairs")
        known = pairs.select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), "docs", F.col("best").cast("int").alias("best"))
        answers = lists.drop("docs").join(known, "pair").select("of", "place", "docs", "best")
        done = held.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(counted, "id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        return materialise(done.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col), "aligned"), pairs
