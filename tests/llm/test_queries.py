"""The queries of the subpackage against their SQL, or against a plain brute-force version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from scriptoria.llm import fingerprint, queries, toxicity
from tests.compare import same_rows

SQL = queries.oracle_sql()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, sf_dir, duck):
    assert same_rows(queries.queries()[name](spark, sf_dir), duck, SQL[name]) > 0


def test_op1_links_and_classes(spark, sf_dir, docs):
    """Every pair whose plain 5-word Jaccard is well above the threshold shares a class; unlike pairs don't."""
    got = {r["doc_id"]: r["class_id"] for r in queries.op1_near_dedup(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    sets = {}
    for k, t in docs.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(docs)
    best: dict = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small < 0.5 * large:
                continue
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.85:
                assert got[a] == got[b], (a, b, j)
            best[a], best[b] = max(j, best.get(a, 0)), max(j, best.get(b, 0))
    for k in ids:
        assert got[k] == min(x for x in ids if got[x] == got[k])
        if best.get(k, 0) < 0.7:
            assert got[k] == k


def test_op2_against_plain_counts(spark, sf_dir, docs):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*(w.encode().translate(lower) for w in words(t)), b" "] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op2_brown(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    gain = 0.0
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        gain += (r["score"] - base) if r["held_out"] else 0
    assert gain > 0


def test_op3_is_close_and_repeats(spark, sf_dir):
    rows = queries.op3_mixing(spark, sf_dir).collect()
    again = queries.op3_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    by = Counter()
    largest = Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by[r["target"], r["source_size"]] += r["taken"]
        largest[r["target"], r["source_size"]] = max(largest[r["target"], r["source_size"]], r["size"])
    for key, taken in by.items():
        assert abs(taken - key[0]) <= largest[key]


def test_op5_against_all_windows(spark, sf_dir, docs):
    first: dict = {}
    for k in sorted(docs):
        w = words(docs[k])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), k)
    rows = {r["doc_id"]: r for r in queries.op5_substrings(spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    for k, t in docs.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (rows[k]["n_words"], rows[k]["n_removed"]) == (len(w), len(gone))
        assert rows[k]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_op6_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op6_toxicity(spark, folder).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 0], [s for s, y in held if y == 1]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert wins / (len(good) * len(bad)) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_op8_edits_and_likeness(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    likes = []
    for k, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = docs[k] or "", docs[after] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + u[:n]
        a, b, c = fingerprint.sketches([t, edited, u])
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.to_text(a[None])[0]
        assert r["edited_fingerprint"] == fingerprint.to_text(b[None])[0]
        assert r["near_edited"] == pytest.approx(float(fingerprint.likeness(a[None], b[None])[0]))
        assert r["near_next"] == pytest.approx(float(fingerprint.likeness(a[None], c[None])[0]))
        likes.append((r["near_edited"], r["near_next"]))
    assert sum(x for x, _ in likes) > 2 * sum(y for _, y in likes)


def test_op9_is_lossless_and_sampled(spark, sf_dir, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    rows = queries.op9_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r["lossless"] for r in rows)
    more = 0
    for r in rows:
        text = docs[r["doc_id"]] or ""
        if text and "▁" not in text:
            assert sp.decode(list(r["piece_ids"])) == text
            more += list(r["piece_ids"]) != sp.encode(text)
    assert more > len(rows) / 2
    again = {r["doc_id"]: list(r["piece_ids"]) for r in queries.op9_sentencepiece(spark.newSession(), sf_dir).repartition(3).collect()}
    assert again == {r["doc_id"]: list(r["piece_ids"]) for r in rows}


def test_op10_is_the_librarys_count(spark, sf_dir, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    rows = {r["doc_id"]: r for r in queries.op10_token_counts(spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    for k, t in docs.items():
        n = len(sp.encode(t or ""))
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len((t or "").encode()), n, n > 4096)


def test_op6_factorization_against_a_double_loop():
    import numpy as np

    rng = np.random.default_rng(5)
    model = {"w0": np.array([0.3]), "w": rng.normal(size=40), "v": rng.normal(size=(40, 8))}
    for found in ([], [3], [1, 7, 30], list(range(0, 40, 3))):
        z = model["w0"][0] + sum(model["w"][i] for i in found)
        z += sum(float(model["v"][i] @ model["v"][j]) for i in found for j in found if i < j)
        assert toxicity.value(model, found) == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))))
