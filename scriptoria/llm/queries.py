"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import brown, fingerprint, lexical, licences, merkle, mixing, near_dedup, pieces, quality, simhash, substrings, token_count, toxicity
from scriptoria.llm.sql import ORACLES

#: Name of the piece model that the queries use; ``public_tokenizers.path`` gives its place.
PIECE_MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(documents(spark, sf_dir))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), "text")
    model, counts = brown.train(docs.filter(~F.col("held_out")).select("text"))
    scored = brown.score(docs, model, counts)
    return scored.withColumn("perplexity", brown.perplexity(F.col("score"), F.col("n_tokens")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0))
    return plan.orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the verdict comes from the cascade over the texts; the measures of every row are the contract's
    judged = quality.features(quality.cascade(documents(spark, sf_dir).select("doc_id", "text")))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    fitted = toxicity.train(toxicity.labelled_rows(docs, labels))
    scored = toxicity.score(docs, fitted)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_checked(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "lossless")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_count.count_tokens(docs, tokenizer_path())
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    values = [F.col(c) for c in merkle.COLUMNS[:-1]]
    tampered = F.when(crc_mod("doc_id", 5) == 0, merkle.leaf(*values, lowered))
    leaves = documents(spark, sf_dir).select("doc_id", "source", merkle.leaf(*values, F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proven = merkle.prove(leaves).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("positions"), F.col("siblings")))
    proof = F.sha2(F.array_join("siblings", ""), 256)
    return proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(documents(spark, sf_dir))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_brown": op2_brown,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_substrings": op5_substrings,
        "op6_toxicity": op6_toxicity,
        "op7_licences": op7_licences,
        "op8_fingerprints": op8_fingerprints,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_counts": op10_token_counts,
        "op11_lexical_search": op11_lexical_search,
        "op12_merkle": op12_merkle,
        "op13_simhash": op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in queries()}
