"""A corpus made ready for training: quality, near-dedup, substring dedup, mixing, piece encoding.

Every stage takes rows with nulls in any column, ids that are null or repeated, repeated rows and empty tables:
rows, not ids, are what is kept, copied or dropped. A null text is empty, so the quality stage drops it; a null
source is a source of its own, the last. Columns other than those of ``documents`` are not passed on.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import mixing, near_dedup, pieces, quality, substrings
from scriptoria.llm.queries import documents, tokenizer_path
from scriptoria.llm.text import shared_folder

#: The columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go."""
    return quality.cascade(docs).filter("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the least doc_id stays."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut; documents left without a word go.

    A text that loses nothing stays as it is; else its kept words are joined by one space.
    """
    cut = substrings.remove_repeats(docs.withColumn("_whole", F.col("text"))).filter("n_words > n_removed")
    text = F.when(F.col("n_removed") == 0, F.col("_whole")).otherwise(F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def queue_digest():
    """Of the whole row: ids may be null or stand over several texts, equal rows are interchangeable."""
    return F.sha2(F.to_json(F.struct(*COLUMNS)), 256)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is trained. The part files hold them in training order, which is the result of
    the curriculum; a column for it would not be one of ``documents``, so the last stage reads it off the files."""
    plan = mixing.plan_mix(docs, digest=queue_digest(), carry=tuple(COLUMNS))
    timed = plan.select("row.*", F.explode("positions").alias("position"))
    return timed.orderBy("position", "doc_id").select(*COLUMNS)


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with train_part, train_row (long): the number of the part file that holds a row, and its place in it.

    Spark reads files in any order and packs small ones together, so only what the files themselves say tells the
    order in which they were written. Of rows that come from no files, the partition and the place in it.
    """
    try:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
        return docs.select(*COLUMNS, number.alias("train_part"), F.col("_metadata.row_index").alias("train_row"))
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return docs.select(*COLUMNS, F.shiftright(at, 33).alias("train_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("train_row"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as sampled piece ids, with their place in the training order (by train_part, then train_row); only what decodes
    to the very text is passed on, which is every text."""
    coded = pieces.encode_checked(with_place(docs), tokenizer_path())
    return coded.filter("lossless").select(*COLUMNS, "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), "train_part", "train_row")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Sampling and iteration are beyond SQL; the tests hold each stage's result to what it promises, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written to the shared folder and read again."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
