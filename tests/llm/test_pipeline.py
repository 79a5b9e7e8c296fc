"""The pipeline on the smallest tables against what its stages promise, checked in plain Python."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from scriptoria.llm import pieces, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(w):
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return len({i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)})


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    kept = {r["doc_id"] for r in good.collect()}
    for k, t in texts.items():
        w = WORD.findall(t or "")
        if len(w) < 10 or 100 * repeats(w) > 20 * len(w):
            assert k not in kept
    assert len(kept) > len(texts) / 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS, name


def test_run(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= set(docs) and max(times.values()) <= 2
    seen: dict = {}
    for r in sorted(out, key=lambda r: r["doc_id"]):
        w = WORD.findall(r["text"])
        assert len(w) and len(r["piece_ids"]) == r["n_pieces"] > 0
        # only what stands in an earlier document goes: the rest is in the source text, in order
        left = iter(WORD.findall(docs[r["doc_id"]]["text"]))
        assert all(any(x == y for y in left) for x in w)
        seen.setdefault(r["text"], r["doc_id"])
        assert seen[r["text"]] == r["doc_id"]
    known = pieces.lattices(queries.tokenizer_path(), 1.0).pieces.bytes_of
    assert all(b"".join(known[i] for i in r["piece_ids"])[1:].decode() == r["text"] for r in out)
