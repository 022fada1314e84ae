"""BPE over distinct words.

Texts are split at white space into words. A task deals its texts into blocks
of bounded size, each with a list of its distinct words. The lists meet by
bucket of words, where every distinct word is encoded once; its ids go back
to the blocks that asked, by place in their lists, and from there to each
document by position. Lists, places and ids travel compressed. Ids are
decoded through the table of id and piece.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 400_000  # distinct ones
BLOCK_PLACES = 8_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_words(raw: bytes) -> list[bytes]:
    """Words of a text in UTF-8, between ASCII white space.

    No pre-token spans white space, so the ids of a text are those of its
    words in order. A-Z may be lower-cased ahead of the normaliser, which does
    so itself, but for a text that could then spell a special token.
    """
    return (raw if b"<|" in raw else raw.lower()).split()


def encode_words(words: list[bytes], tokenizer: str) -> list[list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    t, out = _tokenizer(tokenizer), []
    for at in range(0, len(words), 4096):
        out += [e.ids for e in t.encode_batch_fast([w.decode("utf-8") for w in words[at : at + 4096]], add_special_tokens=False)]
    return out


@functools.lru_cache(maxsize=4)
def pieces(tokenizer: str) -> list[str]:
    """The piece of each id."""
    t = _tokenizer(tokenizer)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode_ids(ids: list[int], tokenizer: str) -> str:
    """The file has no decoder, so pieces are joined by spaces; unknown ids give nothing."""
    table = pieces(tokenizer)
    return " ".join(table[i] for i in ids if 0 <= i < len(table))


class _Blocks:
    """Deals texts into blocks; the same rows in the same order give the same blocks and keys."""

    def __init__(self, block_words: int) -> None:
        self.most, self.vocab, self.n, self.hash, self.held = block_words, defaultdict(), 0, hashlib.blake2b(digest_size=8), []

    def add(self, doc: str | None, text: str | None, with_places: bool) -> bool:
        """Whether the block is full now."""
        raw = (text or "").encode("utf-8", "replace")
        words, vocab = split_words(raw), self.vocab
        vocab.default_factory = vocab.__len__  # a new word takes the next place
        places = map(vocab.__getitem__, words)
        self.n += len(words)
        self.hash.update(f"{doc}:{len(text or '')}:".encode())
        self.hash.update(raw)
        if with_places:
            at = np.fromiter(places, dtype="<u4", count=len(words))
            # the lower and the upper bytes apart, which compresses better
            self.held.append((doc, zlib.compress(at.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)))
        else:
            deque(places, maxlen=0)
        vocab.default_factory = None
        return len(vocab) >= self.most or self.n >= BLOCK_PLACES

    def key(self) -> int:
        return int.from_bytes(self.hash.digest(), "little", signed=True)


def _dealt(batches: Iterator[pd.DataFrame], block_words: int, with_places: bool) -> Iterator[_Blocks]:
    block = None
    for batch in batches:
        for doc, text in zip(batch["id"], batch["text"], strict=True):
            block = block or _Blocks(block_words)
            if block.add(doc, text, with_places):
                yield block
                block = None
    if block:
        yield block


def encode(docs: DataFrame, tokenizer: str | None = None, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(id, n_tokens, ids, decoded)``, or with ``digests`` the SHA-256 of either instead; one row per row of ``docs``.

    A null text is empty and has no ids. Repeated rows, ids among them, are
    handled each for itself. An empty table gives an empty result; other
    columns are not read. Blocks hold up to ``block_words`` distinct words,
    but for a single longer text. The rows are read twice and have to come in
    the same order within a file split, as Spark's file readers give them;
    else an error tells that a block's words are missing.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def bucket_of(vocab: dict[bytes, int]) -> np.ndarray:
        return (np.fromiter(map(zlib.crc32, vocab), dtype="<u4", count=len(vocab)) % np.uint32(buckets)).astype("<u2" if buckets < 1 << 16 else "<u4")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _dealt(batches, block_words, False):
            words, of = list(block.vocab), bucket_of(block.vocab)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            rows = [(block.key(), b, zlib.compress(b"\n".join([words[i] for i in order[cuts[b] : cuts[b + 1]]]), 3)) for b in range(buckets) if cuts[b] < cuts[b + 1]]
            yield pd.DataFrame(rows, columns=["block", "bucket", "words"]).astype({"block": "int64", "bucket": "int32"})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        lists = [zlib.decompress(w).split(b"\n") for w in group["words"]]
        words = list(dict.fromkeys(itertools.chain.from_iterable(lists)))
        ids = dict(zip(words, encode_words(words, path), strict=True))
        out = []
        for ws in lists:
            own = list(map(ids.__getitem__, ws))
            lengths, flat = np.fromiter(map(len, own), dtype="<u4", count=len(own)), np.fromiter(itertools.chain.from_iterable(own), dtype="<u4")
            out.append(tuple(zlib.compress(a.view(np.uint8).reshape(-1, 4).T.tobytes(), 3) for a in (lengths, flat)))
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "lengths": [a for a, _ in out], "ids": [b for _, b in out]})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _dealt(batches, block_words, True):
            key = block.key()
            rows = [(key, 0, None, zlib.compress(bucket_of(block.vocab).tobytes(), 3)), *((key, 1, doc, at) for doc, at in block.held)]
            yield pd.DataFrame(rows, columns=["block", "kind", "id", "data"])

    def numbers(packed: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()

    def join_up(placed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        table = pieces(path)
        of = np.frombuffer(zlib.decompress(placed["data"][placed["kind"] == 0].iloc[0]), dtype="<u2" if buckets < 1 << 16 else "<u4")
        known: list = [None] * len(of)
        for b, lengths, flat in zip(answers["bucket"], answers["lengths"], answers["ids"], strict=True):
            flat, ends = numbers(flat).tolist(), np.cumsum(numbers(lengths)).tolist()
            for at, start, end in zip(np.flatnonzero(of == b).tolist(), [0, *ends], ends, strict=False):
                known[at] = flat[start:end]
        if None in known:
            raise RuntimeError("a block's words are missing: its rows came in another order")
        if digests:
            shown = list(map(str, range(len(table))))
            counts = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
            text, piece = (np.array([t[x[0]] if len(x) == 1 else " ".join([t[i] for i in x]) for x in known], dtype=object) for t in (shown, table))
            gaps = not counts.all()
        out = []
        docs_ = placed[placed["kind"] == 1]
        for doc, packed in zip(docs_["id"], docs_["data"], strict=True):
            at = numbers(packed)
            if not digests:
                ids = [i for k in at.tolist() for i in known[k]]
                out.append((doc, len(ids), ids, " ".join([table[i] for i in ids])))
                continue
            if gaps:  # a word without ids leaves no gap
                at = at[counts[at] > 0]
            parts = text[at].tolist(), piece[at].tolist()
            out.append((doc, int(counts[at].sum()), *(hashlib.sha256(" ".join(p).encode()).hexdigest() for p in parts)))
        return pd.DataFrame(out, columns=["id", "n_tokens", "a", "b"])

    base = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))  # pandas has no nullable longs
    answers = base.mapInPandas(ask, "block long, bucket int, words binary").groupBy("bucket").applyInPandas(answer, "block long, bucket int, lengths binary, ids binary")
    placed = base.mapInPandas(place, "block long, kind int, id string, data binary")
    kind = "string" if digests else "array<int>"
    done = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(join_up, f"id string, n_tokens long, a {kind}, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return done.select(F.col("id").cast("long").alias(id_col), "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]))
