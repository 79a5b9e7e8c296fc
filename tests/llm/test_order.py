"""The order of the quality rules, and the training order through the pipeline's last stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from scriptoria.llm import mixing, quality
from tests.llm.test_pipeline import WORD, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rule_order_is_stable_and_by_rejections_per_cost(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality.default_rules()
    orders = {tuple(r.name for r in quality.order_rules(d, rules)) for d in [docs, docs.select("doc_id", "text"), docs.repartition(7), *[docs] * 7]}
    assert len(orders) == 1
    # the same from plain counts
    texts = [r["text"] for r in quality.sample_of(docs).collect()]
    assert len(texts) == min(quality.SAMPLE_DOCS, docs.count())
    fails, cost = Counter(), Counter()
    for t in texts:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        fails.update(
            too_short=len(w) < 10, repeats=100 * repeats(w) > 20 * len(w), symbols=4 * sum(c in "#*$%&|<>" for c in t) > len(w), word_length=chars > 20 * len(w) or chars < 2 * len(w), dup_lines=10 * (len(lines) - len(set(lines))) > len(w)
        )
        cost.update(too_short=25, repeats=25 + 1100 * len(w), symbols=25 + 14 * len(t), word_length=25 + 65 * len(w), dup_lines=25 + 6 * len(t))
    assert orders.pop() == tuple(sorted((r.name for r in rules), key=lambda n: -(fails[n] + 0.5) / cost[n]))
    assert quality.order_rules(docs.limit(0), rules) == rules


def test_sample_is_of_files_all_over_the_table(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "s", 6) for i in range(2000)]
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(100, "doc_id").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = [int(r["text"].split()[1]) for r in quality.sample_of(docs.select("doc_id", "text")).collect()]
    assert len(got) == 500 and min(got) < 200 and max(got) > 1800
    few = [int(r["text"].split()[1]) for r in quality.sample_of(docs, sample_docs=2000).collect()]
    assert len(few) < 1000  # 32 of 100 files


def test_a_cheap_rule_that_rejects_spares_the_dear_one(spark):
    """The dear rule fails the job wherever it is evaluated on what the cheap one rejects."""
    trap = F.raise_error(F.lit("evaluated")).cast("boolean")
    cheap = quality.Rule("cheap", lambda t, w: F.contains(t, F.lit("bad")), lambda t, w: F.lit(1.0))
    dear = quality.Rule("dear", lambda t, w: F.when(F.contains(t, F.lit("bad")), trap).otherwise(F.lit(False)), lambda t, w: F.lit(1000.0))
    docs = spark.createDataFrame([(i, "bad text" if i % 2 else "good text") for i in range(40)], "doc_id long, text string")
    ordered = [cheap, dear]
    # the order itself is of the costs given, which a sample that may evaluate the trap must not be asked for
    assert [r.name for r in quality.order_rules(docs, [quality.Rule("dear", lambda t, w: F.contains(t, F.lit("good")), dear.cost), cheap])] == ["cheap", "dear"]
    judged = docs.withColumn("failed_rule", quality._failing("text", lambda t, w: F.when(ordered[0].fails(t, w), "cheap").when(ordered[1].fails(t, w), "dear")))
    assert judged.filter("failed_rule = 'cheap'").count() == 20


def test_training_order_survives_part_files_of_unequal_size(spark, tmp_path):
    """16 files, of which Spark reads the large ones first and packs the small ones together."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + (i * 37) % 400)), "en", "abc"[i % 3], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan_mix(docs, digest=corpus_pipeline.queue_digest(), carry=tuple(corpus_pipeline.COLUMNS))
    want = [(r["doc_id"], r["position"]) for r in plan.select("doc_id", F.explode("positions").alias("position")).orderBy("position", "doc_id").collect()]
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(str(tmp_path / "mixed"))
        out = corpus_pipeline.pieces_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), "")
        out.repartition(5).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("train_part").distinct().count() > 8 and got.select("train_part", "train_row").distinct().count() == len(want)
    assert [r["doc_id"] for r in got.orderBy("train_part", "train_row").collect()] == [k for k, _ in want]


def test_rows_that_come_from_no_files_have_a_place(spark):
    rows = [(i, f"text number {i}", "en", "a", 1) for i in range(50)]
    placed = corpus_pipeline.with_place(spark.createDataFrame(rows, SCHEMA))
    assert [r["doc_id"] for r in placed.orderBy("train_part", "train_row").collect()] == list(range(50))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_empty_tables_and_clashing_columns(spark, stage):
    extra = "chunk string, size string, kept boolean, bucket string, id string, label string, position double, score string, digest string, row string, train_row string, piece_ids string, n_words string"
    rows = [(i, " ".join(f"word{i * 7 + k} and{k}" for k in range(20)), None if i == 2 else "en", None if i == 1 else "a", None, *("x", "y", False, "z", "i", "l", 0.5, "s", "d", "r", "t", "p", "w")) for i in range(4)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    out = stage(spark, docs, "")
    assert out.columns[:5] == corpus_pipeline.COLUMNS and {r["doc_id"] for r in out.collect()} <= set(range(4)) and out.count() > 0
    assert stage(spark, docs.limit(0), "").collect() == []
