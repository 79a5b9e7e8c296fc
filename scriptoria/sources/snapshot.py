"""Snapshots of tables in a folder, with a manifest that a later run can hold them to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.sources.bibliography import read_binary

#: Rows of a file at most, so that one file's bytes always fit a task that hashes them.
ROWS_OF_FILE = 1_000_000


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, rows in tables.items():
        rows.write.option("maxRecordsPerFile", ROWS_OF_FILE).parquet(f"{folder}/{name}")


def manifest(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """name, items, files, bytes, sha256 (of the files' hashes in order of their names): files are hashed where they lie, and
    one hash a file comes together."""

    def one(name: str) -> DataFrame:
        found = read_binary(spark, f"{folder}/{name}", "*.parquet")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "file_hash"))), lambda f: f["file_hash"])
        files = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(listed, ""), 256).alias("sha256"))
        items = spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("items"))
        return files.crossJoin(items).select(F.lit(name).alias("name"), "items", "files", "bytes", "sha256")  # a row each

    return reduce(DataFrame.unionByName, map(one, names))


def verify(kept: DataFrame, now: DataFrame) -> DataFrame:
    """name, items, intact: whether the folder still holds what the kept manifest says."""
    same = now.select("name", F.struct("items", "files", "bytes", "sha256").alias("now"))
    return kept.join(same, "name", "left").select("name", "items", F.struct("items", "files", "bytes", "sha256").eqNullSafe(F.col("now")).alias("intact"))
