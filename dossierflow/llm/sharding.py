"""Shards along a Hilbert curve over quantised metadata. Native operations only.

Three dimensions (source, language, size) are quantised to ``BITS`` bits:
names by their rank among the sorted distinct names, sizes by their logarithm,
so neighbouring cells hold neighbouring values. Rows are sorted by the
curve's index and cut into runs whose row counts differ by one at most;
neighbours on the curve are close in all three dimensions, so each run covers
a small box and files prune on any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, scratch

BITS = 8
DIMS = 3


def _gray_inverse(n: int) -> int:
    out = 0
    while n:
        out ^= n
        n >>= 1
    return out


def _entry(w: int) -> int:
    half = 2 * ((w - 1) // 2)
    return 0 if w == 0 else half ^ (half >> 1)


def _direction(w: int) -> int:
    if w == 0:
        return 0
    n, ones = (w - 1 if w % 2 == 0 else w), 0
    while n & 1:
        n, ones = n >> 1, ones + 1
    return ones % DIMS


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The curve's index of a cell; each of the three columns holds 0 to 2**bits - 1."""
    cells = range(1 << DIMS)
    gray, entry, direction = (F.array(*[F.lit(f(w)) for w in cells]) for f in (_gray_inverse, _entry, _direction))
    mask = (1 << DIMS) - 1

    def step(state: Column, level: Column) -> Column:
        digit = sum((F.call_function("shiftright", d.cast("int"), level).bitwiseAND(F.lit(1)) * F.lit(1 << k) for k, d in enumerate(dims)), F.lit(0))
        turn = (state["d"] + 1) % DIMS
        x = digit.bitwiseXOR(state["e"])
        rotated = F.call_function("shiftright", x, turn).bitwiseOR(F.call_function("shiftleft", x, F.lit(DIMS) - turn)).bitwiseAND(F.lit(mask))
        w = F.get(gray, rotated)
        e = F.get(entry, w)
        e = F.call_function("shiftleft", e, turn).bitwiseOR(F.call_function("shiftright", e, F.lit(DIMS) - turn)).bitwiseAND(F.lit(mask))
        return F.struct(
            (state["h"] * F.lit(1 << DIMS) + w).cast("long").alias("h"),
            state["e"].bitwiseXOR(e).cast("int").alias("e"),
            ((state["d"] + F.get(direction, w) + 1) % DIMS).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda s: s["h"])


def _ordered(rows: DataFrame, order: list[str], write) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order``) and ``total``, without a task that sees all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = write(placed, "ordered")  # freezes the places
    placed = placed.withColumn("part", F.expr("shiftright(at, 33)")).withColumn("i", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sums = placed.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = placed.join(F.broadcast(sums), "part").withColumn("rank", F.col("before") + F.col("i"))  # a row for each range partition
    return ranked.drop("at", "part", "i", "before")


def _name_cells(rows: DataFrame, name: str, write) -> DataFrame:
    """``(name, cell)``: each distinct name's share of the way through all of them, in ``BITS`` bits."""
    ranked = _ordered(rows.select(name).where(F.col(name).isNotNull()).distinct(), [name], write)
    return write(ranked.select(F.col(name).alias(f"{name}_name"), F.expr(f"cast((rank * {1 << BITS}) div total as int)").alias(f"{name}_cell")), "names")


def _logarithm(size: Column, bits: int = BITS) -> Column:
    """A size's cell: eight steps to each doubling, the last cell for all beyond."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1))) * 8), F.lit((1 << bits) - 1)).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", whole: str | None = None) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard, hilbert)``, one row per row of ``docs``.

    Law ``rows``: counts differ by one at most. ``size``: UTF-8 bytes of the
    text plus 8, so 8 for a null text. Null names lie in cell 0. Ties on the
    curve are ordered by id, size and checksum; rows equal in all of these
    are interchangeable. Fewer rows than shards leave shards empty; an empty
    table gives an empty result; other columns are not read, unless ``whole``
    names a column that is to hold the row as a struct.
    """
    size = (F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8"))
    carried = [F.struct(*[col(c) for c in docs.columns]).alias("carried")] if whole else []
    names = {"a": source_col, "b": lang_col}
    rows = docs.select(col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), *[col(c).cast("string").alias(n) for n, c in names.items()], *carried)
    with scratch(docs.sparkSession) as write:
        celled = rows
        for n in names:  # few names are broadcast by Spark, many are shuffled
            cells = _name_cells(rows, n, write)
            celled = celled.join(cells, F.col(n) == F.col(f"{n}_name"), "left").drop(n, f"{n}_name")
        h = hilbert_index([F.coalesce("a_cell", F.lit(0)), F.coalesce("b_cell", F.lit(0)), F.col("c")])
        celled = celled.withColumn("c", _logarithm(F.col("size"))).select("id", "size", "crc", h.alias("h"), *(["carried"] if whole else []))
        ranked = materialise(_ordered(celled, ["h", "id", "size", "crc"], write), "ranked")
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total"))
    return ranked.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - ((shard * total + {shards - 1}) div {shards})").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("h").alias("hilbert"),
        *([F.col("carried").alias(whole)] if whole else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **columns: str) -> None:
    """Write ``docs`` to ``path/shard=N``, each shard's rows in the order of their slots; all columns stay."""
    placed = hilbert_shards(docs, shards, whole="row", **columns)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").select("shard", "row.*").write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Least and greatest value of each dimension in each ``shard``, for pruning."""
    return sharded.groupBy("shard").agg(*[f(col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
