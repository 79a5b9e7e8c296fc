"""Intake of new documents as a stream: steps in a fixed order, each of which a restart may repeat without harm.

A batch writes one folder a step (``<root>/<step>/batch=<number>``), always the whole of it, and then one row of the ledger
(``<root>/ledger/batch=<number>/step=<step>``). A batch that is replayed, after a crash between any two writes too, skips
what the ledger has and rewrites the rest, so nothing is added twice. A step that fails is written down with its
error and does not stop the steps behind it; ``repair`` runs it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A step makes rows from the batch's new documents and from the rows of the steps before it, by name.
Step = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """batch, step, rows, error (null: done)."""
    found = _table(spark, f"{root}/ledger")
    return found if found is not None else spark.createDataFrame([], "rows long, error string, batch long, step string")


def _done(spark: SparkSession, root: str, number: int) -> dict[str, str | None]:
    return {r["step"]: r["error"] for r in ledger(spark, root).filter(F.col("batch") == number).collect()}  # one row a step


def new_documents(batch: DataFrame, root: str, number: int) -> DataFrame:
    """Rows of the batch with file_hash, one a hash (the least id), without what earlier batches took in. Null texts are empty."""
    hashed = batch.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = hashed.groupBy("file_hash").agg(F.min_by(F.struct(*batch.columns), "id").alias("r")).select("r.*", "file_hash")
    known = _table(batch.sparkSession, f"{root}/papers")
    if known is None:
        return one
    return one.join(known.filter(F.col("batch") < number).select("file_hash"), "file_hash", "left_anti")


def take_in(batch: DataFrame, number: int, root: str, steps: dict[str, Step], only: set[str] | None = None) -> None:
    """One batch: its new documents, then ``steps`` in order; ``only``: those, even if the ledger has them as failed."""
    spark = batch.sparkSession
    done = _done(spark, root, number)
    rows: dict[str, DataFrame] = {}
    for name, step in {"papers": lambda docs, _: new_documents(docs, root, number), **steps}.items():
        path = f"{root}/{name}/batch={number}"
        if name not in done or (only and name in only and done[name] is not None):
            error = None
            try:
                step(batch if name == "papers" else rows["papers"], rows).write.mode("overwrite").parquet(path)
            except Exception as e:
                if name == "papers":  # without it there is no batch
                    raise
                error = str(e).split("\n")[0][:500]
            count = spark.read.parquet(path).count() if error is None else 0
            spark.createDataFrame([(count, error)], "rows long, error string").coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch={number}/step={name}")
        found = _table(spark, path)
        if found is not None:
            rows[name] = found


def run(stream: DataFrame, root: str, checkpoint: str, steps: dict[str, Step]) -> None:
    """All documents (id, text, ...) that are there now; the next call goes on where the checkpoint ends."""
    take = lambda batch, number: take_in(batch, number, root, steps)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def repair(spark: SparkSession, root: str, steps: dict[str, Step]) -> int:
    """Runs again what the ledger has as failed, from the documents taken in; gives how many steps that were."""
    failed = ledger(spark, root).filter("error is not null").collect()  # a row a failed step
    for r in sorted(failed, key=lambda r: (r["batch"], list(steps).index(r["step"]))):
        take_in(spark.read.parquet(f"{root}/papers/batch={r['batch']}"), r["batch"], root, steps, {r["step"]})
    return len(failed)


def split_late(batch: DataFrame, number: int, root: str, delay: str) -> None:
    """Rows of a batch (ts, ...) to ``<root>/in_time`` or ``<root>/late``: late is what lies more than ``delay`` before the latest
    time of the batches before. The latest times are a ledger by batch, so a replay parts the rows as the first run did."""
    spark = batch.sparkSession
    marks = _table(spark, f"{root}/marks")
    high = marks.filter(F.col("batch") < number).agg(F.max("high")).first()[0] if marks is not None else None
    late = F.col("ts") < F.lit(high).cast("timestamp") - F.expr(f"interval {delay}") if high is not None else F.lit(False)
    for name, rows in (("in_time", batch.filter(~late)), ("late", batch.filter(late))):
        rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
    batch.agg(F.max("ts").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
