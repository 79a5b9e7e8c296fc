"""Queries that stream a given table to its end, and calls to a service in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.operators import calls, chunks, vectors
from scriptoria.plans.registry import query
from scriptoria.session import checkpoint_folder, table
from scriptoria.streaming import feeds, intake, stateful


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def lengths(docs, _rows):
    return docs.select("id", F.length("text").cast("long").alias("n"))


STEPS = {
    "chunks": lambda docs, _rows: chunks.chunk(chunks.pages_of(docs.withColumnRenamed("id", "doc_id"))),
    "paper_vectors": lengths,
    "chunk_vectors": lambda docs, rows: rows["chunks"].select(F.col("paper_id").alias("id"), F.length("chunk_text").cast("long").alias("n")),
}


@query("stream_intake", "X1 X2 X4", """
WITH first AS (SELECT min(doc_id) AS id, any_value(coalesce(text, '')) AS text FROM documents GROUP BY coalesce(text, ''))
SELECT id, sha256(text) AS file_hash, length(text) AS n, 4 AS steps FROM first""")
def stream_intake(spark, sf_dir):
    """All documents as a stream of files: one paper a text, its chunks, and what is derived from either."""
    stream = feeds.table_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    root = folder(spark, "intake")
    intake.run(stream, root, f"{root}-checkpoint", STEPS)
    papers = spark.read.parquet(f"{root}/papers").select("id", "file_hash")
    steps = intake.ledger(spark, root).filter("error is null").groupBy("batch").agg(F.count(F.lit(1)).alias("steps"))
    vectors = spark.read.parquet(f"{root}/paper_vectors").select("id", "n", "batch").join(steps, "batch").drop("batch")
    return papers.join(vectors, "id")


@query("stream_user_runs", "X10", """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total FROM s GROUP BY user_id, k""")
def stream_user_runs(spark, sf_dir):
    """Runs of all users' events, kept in state from batch to batch; the last word on each run counts."""
    root = folder(spark, "runs")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
    runs = stateful.user_runs(feeds.events_stream(spark, sf_dir))
    runs.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(root).groupBy("user_id", "start").agg(F.max_by(F.struct("stop", "n", "total"), F.struct("batch", "n")).alias("r"))
    return last.select("user_id", "start", "r.stop", "r.n", F.round("r.total", 4).alias("total"))


def counted(texts: list[str]) -> list[int]:
    """A service that counts characters and refuses a batch with a text that holds an exclamation mark."""
    if any("!" in t for t in texts):
        raise ValueError("refused")
    return [len(t) for t in texts]


@query("batched_calls", "X7", """
SELECT doc_id AS id, CASE WHEN contains(coalesce(text, ''), '!') THEN NULL ELSE length(coalesce(text, '')) END AS answer, CASE WHEN contains(coalesce(text, ''), '!') THEN 'ValueError: refused' END AS error FROM documents""")
def batched_calls(spark, sf_dir):
    return calls.answered(table(spark, sf_dir, "documents"), counted, "long", "doc_id").select("id", "answer", "error")


@query("vectors_by_model", "S4 R14", """
WITH v AS (SELECT vec_id AS id, 'm' || (label % 4) AS model, len(embedding) AS n FROM embeddings)
SELECT id, model, n, model = 'm0' AS anew FROM v WHERE model IN ('m0', 'm3') OR model = 'm1' AND id % 2 = 1""")
def vectors_by_model(spark, sf_dir):
    """All vectors under four models: one written anew, one purged of every second id, one purged whole, one left alone."""
    path = folder(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), (F.col("label") % 4).cast("string")).alias("model"), "embedding", F.lit(False).alias("anew"))
    vectors.put(v, path)
    vectors.put(v.filter("model = 'm0'").withColumn("anew", F.lit(True)), path)
    vectors.purge(spark, path, "m1", v.filter("id % 2 = 0").select("id"))
    vectors.purge(spark, path, "m2")
    return spark.read.parquet(path).select("id", "model", F.size("embedding").cast("long").alias("n"), "anew")
