"""The pipeline on rows with null and repeated ids against its brute-force result."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from scriptoria.llm import mixing


def brute_mix(rows):
    """(doc_id, text) -> how often it is trained; rows: (digest, doc_id, text, source)."""
    size = Counter()
    for _, _, text, source in rows:
        size[source] += len(text.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = mixing.SHARE * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if mixing.PASSES * size[s] < level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = mixing.PASSES * size[s]
            left -= target[s]
            open_.remove(s)
    copies, start = Counter(), Counter()
    for _, k, text, source in sorted(rows, key=lambda r: r[0]):
        n = len(text.split())
        middle = start[source] + n / 2
        start[source] += n
        copies[k, text] += sum(p * size[source] + middle <= target[source] for p in (0, 1))
    return +copies


def test_run_with_null_and_repeated_ids(spark, tmp_path):
    draw = random.Random(11)
    known = ["".join(draw.choice("aeiou" if i % 2 else "bdfgklmnprst") for i in range(draw.randint(4, 8))) for _ in range(4000)]
    rows = []
    for i in range(90):
        text = " ".join(draw.sample(known, draw.randint(40, 80)))
        rows.append(([None, 6, 100 + i][i % 3], text, "en", ["a", "b", None][i // 30], len(text)))
    good = list(rows)
    rows += [(7, "too short", "en", "a", 9), (None, None, None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    digests = {(r["doc_id"], r["text"]): r["d"] for r in docs.select("doc_id", "text", corpus_pipeline.queue_digest().alias("d")).collect()}
    want = brute_mix([(digests[k, t], k, t, s) for k, t, _, s, _ in good])
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", F.col("text")).collect())
    assert max(want.values()) == 2 and {k for k, _ in want} >= {None, 6}
    assert got == want
