"""Vectors by model: a table with a folder a model, so that a search reads one model's and a purge rewrites one model's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.session import checkpoint_folder


def put(vectors: DataFrame, path: str) -> None:
    """``vectors`` (id, vector, model, ...) replace all that is there of their models; other models stay as they are. Rows without a model are dropped."""
    rows = vectors.filter("model is not null")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def of_model(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of one model; the scan lists that folder only."""
    return spark.read.parquet(path).filter(F.col("model") == model)


def purge(spark: SparkSession, path: str, model: str, ids: DataFrame | None = None) -> None:
    """The vectors of ``model`` go, or those of ``ids`` (id) only. What stays is first set aside, then takes the folder's place, so
    a crash leaves the old folder or the new one. An unknown model changes nothing."""
    checkpoint_folder(spark)
    if ids is not None:
        left = of_model(spark, path, model).join(ids.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left_anti").checkpoint()
        if left.limit(1).count():
            put(left, path)
            return
    # a folder with nothing left is not overwritten by no rows
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for at in files.listStatus(folder):
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(model)
        if at.getPath().getName() == f"model={escaped}":
            files.delete(at.getPath(), True)
