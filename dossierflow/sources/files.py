"""Uploaded files as rows: names made safe, contents told by their first bytes, refusals as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import mask_ip, safe_metadata

MOST_BYTES = 10 * 1024 * 1024
MOST_NAME = 120


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def file_type(content: Column) -> Column:
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.hex(F.substring(content, 1, 4)) == "504B0304", "zip")


def safe_name(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), "[\\x00-\\x1F\\x7F​-‍⁠﻿]", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"[^\w\s.\-()+&']", "_")), r"^\.+", "")
    extension = F.regexp_extract(bare, r"(\.[^.]*)$", 1)
    cut = F.concat(F.substring(bare, F.lit(1), F.lit(MOST_NAME) - F.length(extension)), extension)
    return F.when(bare == "", "resume").when(F.length(bare) > MOST_NAME, cut).otherwise(bare)


def validated(files: DataFrame, name: Column, content: str = "content") -> DataFrame:
    """``files`` with ``safe_name``, ``kind``, ``sha256`` and ``status`` (200, 413, 415 or 422)."""
    kind, extension = file_type(F.col(content)), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    expected = F.when(extension == "pdf", "pdf").when(extension == "docx", "zip")
    status = F.when(F.octet_length(content) > MOST_BYTES, 413).when(expected.isNull(), 415).when(kind.isNull() | (kind != expected), 422).otherwise(200)
    return files.withColumns({"safe_name": safe_name(name), "kind": kind, "sha256": F.sha2(content, 256), "status": status})


def append_events(events: DataFrame, path: str) -> None:
    """Append events with their metadata made safe."""
    events.withColumn("metadata", safe_metadata(F.col("metadata"))).write.mode("append").parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows: addresses masked, metadata made safe. There is no way to change what was written."""
    rows.withColumn("ip_address", mask_ip(F.col("ip_address"))).withColumn("metadata", safe_metadata(F.col("metadata"))).write.mode("append").parquet(path)
