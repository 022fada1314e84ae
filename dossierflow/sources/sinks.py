"""Writes that may be repeated: every batch owns a partition, so a replay puts the same rows in the same place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_once(rows: DataFrame, batch_id: int | str, path: str, batch: str = "batch") -> None:
    """Add the rows of a batch to the table at ``path``; a repeated batch takes the place of its first run.

    A repeated batch that has no rows any more leaves those of its first run.
    """
    rows.withColumn(batch, F.lit(batch_id).cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def batches(spark: SparkSession, path: str, schema: StructType, batch: str = "batch") -> DataFrame:
    """What :func:`append_once` wrote, with its ``batch``; no rows where nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = StructType([*schema.fields]).add(batch, "string")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(path)


def children_once(parents: DataFrame, key: str, items: str, batch_id: int | str, path: str) -> None:
    """Insert each element of the array ``items`` of structs as a row of its own, with its parent's key and its ``place``; parents without elements add none."""
    append_once(parents.select(key, F.posexplode(items).alias("place", "item")).select(key, "place", "item.*"), batch_id, path)


def current(log: DataFrame, key: list[str], order: str = "batch", update: bool = True) -> DataFrame:
    """One row for each key of a log of upserts: that of the last batch, or with ``update`` false that of the first.

    A batch holds a key once. Rows are folded by key ahead of the shuffle, so
    a key that is in every batch costs a row for each task.
    """
    rest = [c for c in log.columns if c not in key and c != order]
    pick = F.max_by if update else F.min_by
    return log.groupBy(*key).agg(pick(F.struct(*rest), F.col(order)).alias("row")).select(*key, "row.*")


def fold_stream(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, state: str) -> None:
    """Fold every micro-batch of what is available, and append its rows once.

    What ``fold`` gives must be mergeable: readers merge the partial results
    of all batches. Rows count whenever they arrive, so none is too late, and
    a batch that is repeated after a failure changes nothing.
    """
    run = lambda rows, number: append_once(fold(rows), f"{number:012d}", path)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
