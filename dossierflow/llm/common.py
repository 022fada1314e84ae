"""What the corpus operators share: tables, shared storage, rows to drop, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"  # to Python workers at once: some 10,000 rows without texts, fewer with them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="dossierflow-")
    return _OWN_DIRS[app]


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: later steps survive lost executors."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    with _setting(df.sparkSession, BATCH_SETTING, BATCH_BYTES):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once, in bytes, where the session has no bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session has the setting while a table is written, then its own again."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A :func:`materialise` whose tables are deleted at the end; nothing that is read later may rest on them."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df, what: _written(df, f"{folder}/{what}-{uuid.uuid4().hex}")
    finally:
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def text_hash(text: Column) -> Column:
    """With its id, what tells a row from others; null texts differ from empty ones."""
    return F.xxhash64(text.cast("string"), text.isNull())


def _marked(docs: DataFrame, ids: DataFrame, id_col: str, slots: int) -> tuple[DataFrame, Column]:
    """``docs`` with further columns, and whether a row's id may be in ``ids (id)``.

    The ids, null among them, are hashed into a bit table of fixed size, which
    is broadcast. With far more ids than ``slots`` all rows are hit, which
    costs work, not rows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(slots))
    s, w, b = (fresh(n, docs) for n in ("slot", "word", "bits"))
    bits = ids.select(slot(F.col("id")).alias("s")).groupBy((F.col("s") / 64).cast("long").alias(w)).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias(b))
    bits = F.broadcast(materialise(bits, "slots"))  # at most slots / 64 rows of 16 bytes
    rows = docs.withColumn(s, slot(col(id_col))).withColumn(w, (F.col(s) / 64).cast("long")).join(bits, w, "left")
    return rows, F.expr(f"{b} is not null and (shiftright({b}, cast({s} % 64 as int)) & 1L) = 1L")


def rows_with(docs: DataFrame, ids: DataFrame, id_col: str, slots: int = 1 << 22) -> DataFrame:
    """All rows of ``docs`` whose id is in ``ids (id)``, and some others."""
    rows, hit = _marked(docs, ids, id_col, slots)
    return rows.where(hit).select(*[col(c) for c in docs.columns])


def drop_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str, slots: int = 1 << 22) -> DataFrame:
    """``docs`` without the rows that ``decided (id, h, keep)`` names; all columns stay.

    A row is named by its id, which may be null, and the :func:`text_hash` of
    its text; no pair is named twice, and ``decided`` is written already.
    Where ``keep`` is true, one of the rows of that name stays. Only rows that
    may be named are shuffled.
    """
    if decided.isEmpty():
        return docs
    rows, hit = _marked(docs, decided.select("id"), id_col, slots)
    own = [col(c) for c in docs.columns]
    sure, unsure = rows.where(~hit).select(*own), rows.where(hit).select(*own)
    i, h, k = (fresh(n, docs) for n in ("named_id", "named_hash", "keep_one"))
    named = decided.select(F.col("id").alias(i), F.col("h").alias(h), F.col("keep").alias(k))
    same = col(id_col).cast("long").eqNullSafe(F.col(i)) & (text_hash(col(text_col)) == F.col(h))
    left = unsure.join(named.where(~F.col(k)), same, "left_anti")
    if decided.where("keep").isEmpty():
        return sure.unionByName(left)
    named = named.where(F.col(k))
    one = left.join(named, same).dropDuplicates([i, h]).select(*own)
    return sure.unionByName(left.join(named, same, "left_anti")).unionByName(one)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component: the smallest node reachable.

    Alternating large-star and small-star steps, until nothing changes. Each
    round is written to shared storage, so its lineage stays short; nothing
    is collected but a count and a checksum. The minimum of a node's
    neighbours is aggregated before the shuffle, and joins on hub nodes can be
    split by AQE. Null ends are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    with scratch(spark) as write:
        edges = (
            edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
            .where("src is not null and dst is not null and src <> dst")
            .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
            .distinct()
        )
        edges = write(edges, "edges")
        state, before = _state(edges), None
        while state != before and state[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # large-star: larger neighbours point at the smallest node around
            least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
            large = edges.select(F.col("v").alias("k"), F.col("u").alias("far")).join(least, "k").select(F.col("far").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            # small-star: smaller neighbours and the node itself point at the smallest
            least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
            joined = large.select(F.col("u").alias("k"), "v").join(least, "k")
            small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
            edges = write(small, "edges")
            state, before = _state(edges), state
        stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        return materialise(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"])
