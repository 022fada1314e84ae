"""Near duplicates by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each
padded to 23. The perfect Golay code (23, 12) puts every segment within three
bits of one codeword; the keys of a segment are all codewords within four
bits, one or six of them, so two segments that differ in two bits or fewer
share a key. If two fingerprints differ in two bits or fewer, some segment is
equal and the next one shares a key: they meet under the two together. If
they differ in five bits or fewer, at most one segment holds more than two of
them: they share the keys of some two segments. What meets is compared.

Whole texts with a Jaccard similarity of 0.8 differ in some ten bits, beyond
what such keys guarantee, so ``drop_near_duplicates`` retrieves by the keys and,
for what they cannot reach, by bands of MinHashes of the same shingles.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_rows, materialise, rows_with, scratch, text_hash

SEGMENTS = ((0, 22), (22, 21), (43, 21))
EQUAL_BITS, MOST_BITS = 2, 5
GENERATOR = 0b101011100011  # fixed value: a generator polynomial of the binary Golay code
SMALL_RUN = 24
BLOCK = 16384  # rows of a key that are compared in one task
SET_ROWS, SET_ITEMS = 2048, 1 << 21  # the same for rows with their shingle sets, by rows and by shingles
HUB = 4096  # pairs of one row that are judged in one task
TILE = 256
BANDS, BAND_ROWS = 30, 5  # sets with a similarity of 0.8 share no band with a probability of (1 - 0.8**5)**30 < 0.00001


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where(r >> bit & 1, GENERATOR << (bit - 11), 0)
    return r


@functools.lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """For each syndrome, the error patterns of up to four bits that have it: one or six, padded with -1."""
    table, used = np.full((2048, 6), -1, dtype=np.int64), np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)], dtype=np.int64)
        for s, e in zip(_syndrome(errors).tolist(), errors.tolist(), strict=True):
            table[s, used[s]] = e
            used[s] += 1
    return table


def golay_keys(segments: np.ndarray) -> np.ndarray:
    """Indices (the upper 12 bits) of all codewords within four bits of each segment; -1 pads."""
    errors = golay_table()[_syndrome(segments)]
    return np.where(errors >= 0, (segments.astype(np.int64)[:, None] ^ errors) >> 11, -1)


def _words(text: str) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words (A-Z only) joined by single spaces in UTF-8, with the places where each starts and ends."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: just A-Z, and just the six white-space bytes
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    return line, [0, *ends[:-1]], [e - 1 for e in ends]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64, repeats counted."""
    from xxhash import xxh64_intdigest

    line, starts, ends = _words(text or "")
    if not starts:
        return 0
    last = ends[shingle - 1 :] or ends[-1:]
    total, sums = len(last), np.zeros(64, dtype=np.int64)
    hashes = (xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, last, strict=False))
    while len(part := np.fromiter(itertools.islice(hashes, 65536), dtype=np.uint64)):
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > total, bitorder="little").tobytes(), "little")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, text)``: ids as strings, since pandas has no nullable longs."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").cast("string").alias("id"), text_hash(text).alias("h"), text.alias("text"))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed long; 0 for null texts and texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps})

    return _texts(docs, id_col, text_col).select("id", "text").mapInPandas(run, "id string, fp long").select(F.col("id").cast("long").alias("id"), "fp")


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


# what links by fingerprints ---------------------------------------------------------------------


def _keyed(distinct: DataFrame, most: int) -> DataFrame:
    """The rows of ``distinct (fp, node)`` with every ``key`` under which fingerprints that differ in ``most`` bits or fewer meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp, node = batch["fp"].to_numpy(), batch["node"].to_numpy()
            cut = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            keys = [golay_keys(c) for c in cut]
            for n, (a, b) in enumerate(((0, 1), (1, 2), (2, 0))):
                left = cut[a][:, None] if most <= EQUAL_BITS else keys[a]  # a segment as it is, or its keys
                both = (left[:, :, None] << 12 | keys[b][:, None, :]).reshape(len(fp), -1)
                held = ((left >= 0)[:, :, None] & (keys[b] >= 0)[:, None, :]).reshape(len(fp), -1)
                i, j = np.nonzero(held)
                yield pd.DataFrame({"key": both[i, j] * 3 + n, "fp": fp[i], "node": node[i]})

    return distinct.select("fp", "node").mapInPandas(run, "key long, fp long, node long")


def _close(fp: np.ndarray, node: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what is close in one run of equal keys: a forest, with each member compared to all not yet reached."""
    links, rest = [], np.arange(len(fp))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _bits(fp[rest], fp[x]) <= most
            links += [(node[x], node[y]) for y in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return links


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Whole runs of equal cells with the runs' starts and sizes; input sorted by cell."""
    held: list[pd.DataFrame] = []
    for batch in itertools.chain(batches, [None]):
        whole = None
        if batch is None:
            whole = pd.concat(held) if held else None
        elif len(batch):
            cell = batch["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last run may go on; its rows are bounded
            if cut or (held and held[-1]["cell"].iloc[-1] != cell[-1]):
                whole, held = pd.concat([*held, batch.iloc[:cut]]), []
            held.append(batch.iloc[cut:])
        if whole is not None and len(whole):
            cell = whole["cell"].to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            yield whole, starts, np.diff(np.r_[starts, len(cell)])


def _compare(most: int):
    """Compares within runs of equal cells; input sorted by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for whole, starts, sizes in _runs(batches):
            cell, fp, node = (whole[c].to_numpy() for c in ("cell", "fp", "node"))
            links = []
            for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
                links += _close(fp[s : s + n], node[s : s + n], most)
            size_of = np.repeat(sizes, sizes)
            at = np.flatnonzero((size_of > 1) & (size_of <= SMALL_RUN))
            for step in range(1, SMALL_RUN):  # all pairs of the small runs
                at = at[at + step < len(cell)]
                at = at[cell[at] == cell[at + step]]
                near = at[_bits(fp[at], fp[at + step]) <= most]
                links += zip(node[near].tolist(), node[near + step].tolist(), strict=True)
            links = {(min(x), max(x)) for x in links} - seen
            seen = (seen | links) if len(seen) < 200_000 else links  # repeats are dropped later in any case
            if links:
                yield pd.DataFrame(sorted(links), columns=["src", "dst"])

    return run


def _dealt(rows: DataFrame, blocks: DataFrame, on: str) -> DataFrame:
    """``rows`` by ``cell``: one for each value of ``on``, or where ``blocks (on, blocks)`` gives several, one for each pair of its blocks.

    ``own`` is a row's block. Two rows meet in one cell, but for those of one
    block, which meet in a cell of their own (``cross`` false) and beside
    others. Cells are hashes: rows of two values may meet, which costs
    comparisons only.
    """
    rest = [c for c in rows.columns if c != on]
    dealt = rows.join(blocks.withColumnRenamed(on, "__of").where("blocks > 1"), F.col(on) == F.col("__of"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))
    cells = dealt.select(on, *rest, own.alias("own"), F.explode(others).alias("pair"))
    return cells.select(F.xxhash64(on, "pair.low", "pair.high").alias("cell"), (F.col("pair.low") != F.col("pair.high")).alias("cross"), "own", on, *rest)


def links(distinct: DataFrame, most: int) -> DataFrame:
    """``(src, dst)`` that connect exactly the rows of ``distinct (fp, node)`` that chains of close fingerprints connect."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"the keys guarantee up to {MOST_BITS} differing bits")
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as write:
        keyed = write(_keyed(distinct.repartition(parts, "fp"), most), "keys")  # a given number is not coalesced: each row becomes many
        counts = write(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-keys")
        cells = _dealt(keyed, counts, "key").select("cell", "fp", "node").repartition(parts, "cell").sortWithinPartitions("cell", "fp")
        return materialise(cells.mapInPandas(_compare(most), "src long, dst long").distinct(), "links")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints link at ``most`` or fewer differing bits; ``component_id`` is
    the smallest id that chains of links reach. Texts that are null or have no
    words share fingerprint zero. Equal fingerprints are one node, whatever
    their number, so repeated rows and ids are fine. Rows with a null id keep
    their fingerprint and their group's id, null if all the group's ids are.
    An empty table gives an empty result; other columns are not read.
    """
    fps = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # nodes are numbered when written, so each is unique, whatever the ids
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = connected_components(links(distinct, most)).withColumnRenamed("node", "member")
    labelled = distinct.join(groups, F.col("node") == F.col("member"), "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = materialise(labelled.select(F.col("fp").alias("of"), "component").join(least, "component"), "labels")
    out = fps.join(labelled, fps["fp"] == labelled["of"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# what links by the similarity of whole texts ------------------------------------------------------


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same values (the splitmix64 finaliser)."""
    x = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    sums = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        sums += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes), bitorder="little").tobytes(), "little")


@functools.lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240917)
    n = BANDS * BAND_ROWS
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def band_tags(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band's MinHashes."""
    a, b = _factors()
    least = np.full(len(a), ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * a[None, :] + b[None, :]).min(axis=0))
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in _mixed(least).reshape(BANDS, BAND_ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words are one shingle, no words none."""
    from xxhash import xxh64_intdigest

    line, starts, ends = _words(text or "")
    last = ends[shingle - 1 :] or ends[-1:]
    return np.unique(np.fromiter((xxh64_intdigest(line[s:e]) for s, e in zip(starts, last, strict=False)), dtype=np.uint64))


def banded(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, size, fp, same, tags)``: of the set of a text's shingles its size, a fingerprint, a hash of the whole set and the bands' tags."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch["text"]]
            fps, same = (np.array(x, dtype=np.uint64).view(np.int64) for x in ([_majority(x) for x in sets], [xxh64_intdigest(x.tobytes()) for x in sets]))
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "size": np.array([len(x) for x in sets], dtype=np.int64), "fp": fps, "same": same, "tags": [band_tags(x).view(np.int64) for x in sets]})

    out = _texts(docs, id_col, text_col).mapInPandas(run, "id string, h long, size long, fp long, same long, tags array<long>")
    return out.withColumn("id", F.col("id").cast("long"))


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes can have a Jaccard similarity of ``least``."""
    return np.minimum(a, b) >= least * np.maximum(a, b)


def _forest(fp: np.ndarray, size: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """The pairs, shortest by fingerprint, that connect what sizes allow to be similar in a run."""
    far = 65
    best, near, rest = np.full(len(fp), far), np.zeros(len(fp), dtype=np.int64), np.arange(len(fp))
    while len(rest):
        i = int(np.argmin(best[rest]))
        x = rest[i]
        if best[x] < far:
            yield int(near[x]), int(x)
        rest = np.delete(rest, i)
        bits = np.where(_alike(size[rest], size[x], least), _bits(fp[rest], fp[x]).astype(np.int64), far)
        closer = bits < best[rest]
        best[rest[closer]], near[rest[closer]] = bits[closer], x


def _first_turn(least: float):
    """Pairs that connect each run: one fewer than its rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(batches):
            fp, node, size = (rows[c].to_numpy() for c in ("fp", "node", "size"))
            two = starts[sizes == 2]
            two = two[_alike(size[two], size[two + 1], least)]
            found = set(zip(node[two].tolist(), node[two + 1].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found |= {(int(node[s + x]), int(node[s + y])) for x, y in _forest(fp[s : s + n], size[s : s + n], least)}
            if found:
                yield pd.DataFrame(sorted({(min(x), max(x)) for x in found}), columns=["src", "dst"])

    return run


def _pending(least: float):
    """Of each run, the rows with a pair that is still to be judged there: of different groups, of sizes that allow it, not judged in the first turn, and in no earlier band together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(batches):
            fp, size, group, band, own, cross = (rows[c].to_numpy() for c in ("fp", "size", "grp", "band", "own", "cross"))
            tags = np.array(rows["tags"].tolist(), dtype=np.int64).reshape(len(rows), BANDS)
            wanted = np.zeros(len(rows), dtype=bool)
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if (group[s : s + n] == group[s]).all():
                    continue
                judged = [set() for _ in range(n)]
                for x, y in _forest(fp[s : s + n], size[s : s + n], least):
                    judged[min(x, y)].add(max(x, y))
                for i in range(s, s + n - 1):
                    j = np.arange(i + 1, s + n)
                    j = j[_open(i, j, group, size, own, cross, least) & _first_shared(tags[i], tags[j], band[i])]
                    j = j[[int(x) - s not in judged[i - s] for x in j]] if judged[i - s] and len(j) else j
                    wanted[i] |= bool(len(j))
                    wanted[j] = True
            yield rows.loc[wanted, ["cell", "cross", "own", "band", "node", "grp", "size", "tags"]]

    return run


def _open(i: int | np.ndarray, j: np.ndarray, group: np.ndarray, size: np.ndarray, own: np.ndarray, cross: np.ndarray, least: float) -> np.ndarray:
    return (group[i] != group[j]) & _alike(size[i], size[j], least) & (~cross[j] | (own[i] != own[j]))


def _first_shared(a: np.ndarray, b: np.ndarray, band: int | np.ndarray) -> np.ndarray:
    same = a == b
    return same.any(axis=-1) & (same.argmax(axis=-1) == band)


class _Groups:
    """Which rows of a run are known to be in one group."""

    def __init__(self, names: np.ndarray) -> None:
        _, self.of = np.unique(names, return_inverse=True)

    def join(self, x: int, y: int) -> bool:
        """Whether that was news."""
        a, b = self.of[x], self.of[y]
        if a != b:
            self.of[self.of == b] = a
        return bool(a != b)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    items, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    lengths = [len(x) for x in (*left, *right)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    often = np.bincount(at, minlength=len(items)) > 1
    place = np.cumsum(often) - 1
    keep = often[at]
    row, at = row[keep], place[at[keep]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, int(often.sum()), 8192):
        some = (at >= low) & (at < low + 8192)
        held = np.zeros((len(lengths), 8192), dtype=np.float32)
        held[row[some], at[some] - low] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out.astype(np.int64)


def _second_turn(least: float):
    """Judges all pending pairs of each run by their sets; gives the pairs that connect its groups, one fewer than its rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts, sizes in _runs(batches):
            found = []
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                part = rows.iloc[s : s + n]
                node, size, band, own, cross, own2, cross2 = (part[c].to_numpy() for c in ("node", "size", "band", "own1", "cross1", "own", "cross"))
                tags = np.array(part["tags"].tolist(), dtype=np.int64).reshape(n, BANDS)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in part["items"]]
                groups = _Groups(part["grp"].to_numpy())
                for a, b in itertools.combinations_with_replacement(range(0, n, TILE), 2):
                    i, j = np.arange(a, min(a + TILE, n))[:, None], np.arange(b, min(b + TILE, n))[None, :]
                    ask = (i < j) & _open(i, j, groups.of, size, own, cross, least) & (~cross2[j] | (own2[i] != own2[j])) & _first_shared(tags[i], tags[j], band[i])
                    if not ask.any():
                        continue
                    left, right = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
                    both = _common([sets[a + x] for x in left], [sets[b + y] for y in right])
                    total = size[a + left][:, None] + size[b + right][None, :] - both
                    hit = ask[np.ix_(left, right)] & (both >= least * total)
                    for x, y in zip(*np.nonzero(hit), strict=True):
                        x, y = a + left[x], b + right[y]
                        if groups.join(x, y):
                            found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
            if found:
                yield pd.DataFrame(found, columns=["src", "dst"])

    return run


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``(node, items)``: the shingle sets of the rows that ``nodes (node, id, h)`` names."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "items": [shingle_set(t, shingle).tobytes() for t in batch["text"]]})

    asked = nodes.select("node", F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("none"), "h")
    rows = _texts(rows_with(docs, nodes.select("id"), id_col), id_col, text_col)
    rows = rows.select(F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("i"), F.col("id").isNull().alias("none"), "h", "text")
    one = rows.groupBy("i", "none", "h").agg(F.first("text").alias("text"))  # repeated rows have one set
    return asked.join(one, ["i", "none", "h"]).select("node", "text").mapInPandas(sets, "node long, items binary")


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs (src, dst)`` whose ``sets (node, items)`` have a Jaccard similarity of ``least`` or more.

    Pairs are dealt by ``src``, whose set comes first and is held while those
    of its partners pass; what has over ``HUB`` partners is dealt to several tasks.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = None
        for batch in batches:
            found = []
            for src, dst, items in zip(batch["src"], batch["dst"], batch["items"], strict=True):
                own = np.frombuffer(items, dtype=np.uint64)
                if dst < 0:
                    hub = own
                elif _similar(hub, own, least):
                    found.append((src, dst))
            yield pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    hubs = pairs.groupBy("src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts"))
    dealt = pairs.join(hubs.where("salts > 1"), "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    first = hubs.select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    first = first.join(sets.withColumnRenamed("node", "src"), "src").select("src", F.lit(-1).cast("long").alias("dst"), "salt", "items")
    later = dealt.join(sets.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "salt", "items")
    met = first.unionByName(later).repartition("src", "salt").sortWithinPartitions("src", "salt", "dst")
    return met.mapInPandas(judge, "src long, dst long")


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, least: float, id_col: str, text_col: str, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``(src, dst)`` that connect exactly the rows of ``nodes (node, id, h, size, fp, tags)`` that chains of similar pairs connect, of those pairs that share a band, and whatever close fingerprints add to them.

    A first turn judges the pairs that connect what fingerprints link and
    those that connect each band's rows, a second one all pairs of a band
    whose ends are still in different groups. Rows travel by band; their sets
    only to bands in which they have a pair left to judge.
    """
    near = links(nodes.select("fp", "node"), MOST_BITS)
    keyed = nodes.select("node", F.posexplode("tags").alias("band", "tag"))
    shared = write(keyed.groupBy("band", "tag").count().where(F.col("count") > 1), "shared")
    cells = keyed.join(shared, ["band", "tag"]).join(nodes.select("node", "fp", "size"), "node")
    cells = write(cells.select(F.xxhash64("band", "tag").alias("key"), "band", "node", "fp", "size"), "cells")
    hot = write(shared.where(F.col("count") > BLOCK).groupBy(F.xxhash64("band", "tag").alias("key")).agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks")), "hot")
    asked = cells.select("node").unionByName(near.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    sets = write(shingle_sets(docs, asked.join(nodes.select("node", "id", "h"), "node"), shingle, id_col, text_col), "sets")

    dealt = lambda rows: _dealt(rows, hot, "key").drop("key").repartition("cell").sortWithinPartitions("cell", "fp", "node")
    banded_pairs = dealt(cells).select("cell", "fp", "node", "size").mapInPandas(_first_turn(least), "src long, dst long")
    pairs = write(near.unionByName(banded_pairs).distinct(), "pairs")
    similar = write(similar_pairs(pairs, sets, least), "similar")

    groups = connected_components(similar).withColumnRenamed("node", "member")
    named = cells.join(groups, F.col("node") == F.col("member"), "left").drop("member").withColumn("grp", F.coalesce("component", "node")).drop("component")
    named = write(named, "named")
    mixed = named.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select("key")  # the one pair of two rows is judged
    still = named.join(mixed, "key", "left_semi").join(nodes.select("node", "tags"), "node")
    kinds = "cell long, cross boolean, own int, band int, node long, grp long, size long, tags array<long>"
    pending = write(dealt(still).mapInPandas(_pending(least), kinds), "pending")
    # sets are larger than rows: cells are cut again by what fits in a task
    blocks = pending.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / SET_ROWS, F.sum("size") / SET_ITEMS)).cast("int").alias("blocks"))
    with_sets = pending.withColumnsRenamed({"cell": "key", "own": "own1", "cross": "cross1"}).join(sets, "node")
    met = _dealt(with_sets, blocks.withColumnRenamed("cell", "key"), "key").drop("key").repartition("cell").sortWithinPartitions("cell", "node")
    more = write(met.mapInPandas(_second_turn(least), "src long, dst long").distinct(), "more")
    return similar.unionByName(more)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that with the smallest id; all columns stay.

    Pairs are retrieved whose fingerprints are linked by Golay keys (up to
    ``MOST_BITS`` bits), and pairs whose sets of shingles share one of
    ``BANDS`` bands of ``BAND_ROWS`` MinHashes; the exact Jaccard similarity
    of the sets decides, and chains of similar pairs are a group. Of the pairs at 0.8 fewer than
    one in 100,000 shares no band, whatever the sets' sizes and whatever the
    size of a band; every other pair of different groups is judged. Equal sets
    are one node; texts without words, null ones among them, are one group.
    Of rows that repeat an id and a text one stays; rows with a null id stay
    only where all of their group have none, and then one. Rows that repeat
    an id with other texts are rows of their own. An empty table gives an empty result.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("the bands hold from a similarity of 0.8")
    spark = docs.sparkSession
    of = ["same", "size", "fp"]
    with scratch(spark) as write:
        sets = write(banded(docs, shingle, id_col, text_col), "banded")
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
        nodes = sets.groupBy(*of).agg(first, F.first("tags").alias("tags"), F.count("*").alias("n"))
        nodes = write(nodes.select(F.monotonically_increasing_id().alias("node"), *of, F.col("first.id").alias("id"), F.col("first.h").alias("h"), "first", "tags", "n"), "nodes")
        linked = similar_links(docs, nodes.where("size > 0"), shingle, least, id_col, text_col, write)
        groups = connected_components(linked)
        heads = groups.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("head"))
        heads = groups.join(heads, "component").select(F.col("node").alias("member"), "head")
        # alone and unique rows are not looked at again
        known = nodes.join(heads, F.col("node") == F.col("member"), "left").where("n > 1 or member is not null")
        known = known.select(*[F.col(c).alias(f"of_{c}") for c in of], F.coalesce("head", "first").alias("head"))
        rows = sets.select("id", "h", *of).join(known, [F.col(c) == F.col(f"of_{c}") for c in of])
        stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("h") == F.col("head.h"))
        decided = rows.groupBy("id", "h").agg(F.bool_or(stays).alias("keep"), F.count("*").alias("n")).where("not keep or n > 1")
        decided = materialise(decided.select("id", "h", "keep"), "decided")
    return drop_rows(docs, decided, id_col, text_col)
