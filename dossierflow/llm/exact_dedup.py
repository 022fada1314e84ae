"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Native DataFrame operations only. Each level keeps the rows whose group
still has two or more members; only those are hashed in full. Which rows
those are is told to the scan by a bit table of fixed size (``slots`` bits),
so it can be broadcast whatever the input; a false hit only costs one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, drop_rows, materialise, scratch, text_hash

PREFIX_CHARS = 256
SLOTS = 1 << 22


def normalised(text: Column) -> Column:
    """Null counts as empty; a run of space, tab, LF, VT, FF or CR counts as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _refined(docs: DataFrame, id_col: str, text_col: str, slots: int, hash_all: bool, write) -> DataFrame:
    """``(id, h, sha, g, keep_id, keep_row, row, size)`` of every row; ``g`` is null outside of groups."""
    base = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    norm = normalised(F.col("text"))
    sized = base.select(norm.alias("t")).select(F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("p"))
    keys = write(sized, "dedup-keys")
    # counted before the shuffle: a frequent length or text is a row for each task
    pairs = keys.groupBy("n", "p").agg(F.count("*").alias("k"))
    same_size = pairs.groupBy("n").agg(F.sum("k").alias("k")).where("k > 1").select("n")
    same_prefix = pairs.where("k > 1").join(same_size, "n", "left_semi").select("n", "p")
    slot = F.pmod(F.xxhash64("n", "p"), F.lit(slots))
    bits = same_prefix.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b"))
    table = F.broadcast(write(bits, "dedup-slots"))  # at most slots / 64 rows of 16 bytes

    rows = base.select("id", text_hash(F.col("text")).alias("h"), norm.alias("t"))
    rows = rows.select("id", "h", "t", F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("p")).withColumn("s", slot)
    rows = rows.withColumn("w", (F.col("s") / 64).cast("long")).join(table, "w", "left")
    hit = F.expr("b is not null and (shiftright(b, cast(s % 64 as int)) & 1L) = 1L")
    sha = F.sha2(F.col("t"), 256)
    rows = rows.select("id", "h", "n", hit.alias("again"), (sha if hash_all else F.when(hit, sha)).alias("sha"))
    rows = write(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")  # numbers tell repeated rows apart
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = rows.where("again").groupBy("n", "sha").agg(first, F.count("*").alias("size")).where("size > 1")
    groups = groups.select(F.col("sha").alias("g"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "size")
    return rows.join(groups, rows["sha"] == groups["g"], "left").select("id", "h", "sha", "g", "keep_id", "keep_row", "row", "size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, hash_all: bool = False) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    ``keep_id`` is the smallest id among equal texts. ``text_sha256`` is null
    for rows that no refinement level had to hash, unless ``hash_all``.
    Null texts are empty texts. Rows with a null id form groups but are never
    the one that stays unless all are null. Of rows that repeat the smallest
    id, one is kept. An empty table gives an empty result; other columns are
    not read.
    """
    out = _refined(docs, id_col, text_col, slots, hash_all, materialise)
    grouped = F.col("g").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies, see :func:`exact_duplicates`; all columns stay, also of rows that repeat an id."""
    with scratch(docs.sparkSession) as write:
        rows = _refined(docs, id_col, text_col, SLOTS, False, write).where("g is not null")
        named = rows.groupBy("id", "h").agg(F.bool_or(F.col("row") == F.col("keep_row")).alias("keep"), F.count("*").alias("n"))
        decided = materialise(named.where("not keep or n > 1").select(F.col("id").cast("long").alias("id"), "h", "keep"), "decided")
    return drop_rows(docs, decided, id_col, text_col)
