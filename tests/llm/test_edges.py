"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import brown, fingerprint, licences, mixing, near_dedup, pieces, quality, queries, substrings, token_count, toxicity

LONG = " ".join(f"word{i % 977} then{i % 13}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size string, kept boolean, bucket string, id string, label string, position double, score string, digest string, _text string, n_tokens string"
EXTRA = ("c", "s", False, "b", "i", "l", 0.5, "x", "d", "t", "n")
PASSAGE = "the quick brown fox jumps over the lazy dog while thirteen other animals look on and say nothing at all today"
ROWS = [
    (1, PASSAGE, "en", "a", 10), (1, PASSAGE, "en", "a", 10), (2, PASSAGE, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (None, PASSAGE + " and more", "en", "b", 3),
    (None, None, None, None, None), (5, " \t\n\x0b\f\r ", "en", "c", 7), (6, LONG, "en", "a", len(LONG)), (7, LONG, "en", "a", len(LONG)), (6, "another text under an id that is taken already", "en", "d", 1),
    (8, "▁ ünïcödé 𝔘 ▁▁ ligature ﬁ\n\n  two  spaces ", "de", "b", 5), (9, "x", "en", "a", 1), (9, "x", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ROWS], SCHEMA)


def path():
    return queries.tokenizer_path()


def lm(docs):
    model, counts = brown.train(docs.select("text"))
    return brown.score(docs, model, counts)


OPERATORS = {
    "near": near_dedup.near_classes,
    "lm": lm,
    "mix": mixing.plan_mix,
    "quality": quality.cascade,
    "features": quality.features,
    "substrings": substrings.remove_repeats,
    "toxicity": lambda d: toxicity.score(d, toxicity.train(toxicity.labelled_rows(d, d.select("doc_id", F.lit(1).alias("toxic"))))),
    "licences": licences.scan_licences,
    "fingerprint": fingerprint.fingerprint,
    "edited": fingerprint.compare_edited,
    "pieces": lambda d: pieces.decode(pieces.encode(d, path()), path()),
    "checked": lambda d: pieces.encode_checked(d, path()),
    "counts": lambda d: token_count.count_tokens(d, path()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_keep_their_number(name, odd):
    assert len(OPERATORS[name](odd).collect()) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, odd):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def test_extra_columns_pass(odd):
    for name in ("lm", "quality", "substrings", "toxicity", "fingerprint", "pieces", "counts"):
        found = OPERATORS[name](odd)
        assert {"chunk", "bucket", "id", "label", "_text"} <= set(found.columns)
        assert all(r["chunk"] == "c" and r["_text"] == "t" for r in found.select("chunk", "_text").collect())


def test_near_classes_of_odd_rows(odd):
    rows = near_dedup.near_classes(odd).collect()
    by = {(r["doc_id"], r["class_id"]) for r in rows}
    assert {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (None, 3), (6, 6), (7, 6), (9, 9)} <= by
    other = [r["class_id"] for r in rows if r["doc_id"] == 6 and r["class_id"] != 6]
    assert len(other) == 1 and other[0] >= near_dedup.UNNAMED


def test_keep_one_of_odd_rows(odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    found = sorted((r["doc_id"], len(r["text"] or "")) for r in kept.collect())
    # text 5 is blank but not empty: its one shingle of no words is that of an empty text
    assert (1, len(PASSAGE)) in found and (6, len(LONG)) in found and (9, 1) in found and (8, 47) in [(8, 47)]
    assert sum(1 for k, _ in found if k == 6) == 2 and sum(1 for k, _ in found if k in (1, 2, None)) == 1


def test_substrings_of_odd_rows(odd):
    n = len(PASSAGE.split())
    rows = substrings.remove_repeats(odd).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows)
    assert (1, n, 0) in got and (2, n, n) in got and (0, n + 2, n) in got and (0, 0, 0) in got and (7, 120_000, 120_000) in got
    assert [g for g in got if g[0] == 1] == [(1, n, 0)] * 2


def test_chunks_do_not_change_substrings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(docs).collect()}
    many = {r["doc_id"]: r["kept_text"] for r in substrings.remove_repeats(docs.repartition(5), chunk_bytes=20_000).collect()}
    assert one == many


def test_quality_order_never_changes_verdicts(odd):
    rules = quality.default_rules()
    a = quality.cascade(odd, rules).groupBy("kept").count().collect()
    b = quality.cascade(odd, rules[::-1], sample_docs=1).groupBy("kept").count().collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(not r["kept"] for r in quality.cascade(odd).filter("coalesce(text, '') = ''").collect())


def test_licences(spark):
    mit, isc = licences.KNOWN_TEXTS["MIT"][0], licences.KNOWN_TEXTS["ISC"][0]
    texts = [mit, "Copyright (c) 2019 Jane Doe\n" + mit.upper().replace(",", ""), mit + " but not quite", None, "", "Copyright Jane Doe\n\n" + mit.replace("\n\n", " "), "# a comment in front of it: Copyright 2001 by some holder\n" + isc]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(docs).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "MIT", 6: "ISC"}


def test_notices_inside_texts(spark):
    bsd = licences.KNOWN_TEXTS["BSD-3-Clause"][0].split("\n\n")[3]
    wrapped = " ".join(bsd.split()[:9]) + "\n   " + " ".join(bsd.split()[9:])
    texts = ["A story.\nReleased under the MIT licence.\nIts end, licensed under CC BY-NC 4.0", f"Code.\n\n{wrapped}\n\nMore.", "no licence here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["n_notices"], r["notices"]) for r in licences.scan_licences(docs).collect()}
    assert got == {0: (None, 1, "MIT"), 1: (None, 1, "BSD-3-Clause"), 2: (None, 0, ""), 3: (None, 0, "")}


def test_every_known_text_hints():
    import re

    assert all(re.search(licences.HINT, t.lower()) for _, t, _ in licences.known_texts())


def test_registry_of_files(spark, tmp_path):
    (tmp_path / "Some-1.0").write_text("Copyright (c) 1999 Nobody\n\nThis licence is\n  the licence of Nobody.")
    known = licences.registry_of_files(spark, str(tmp_path))
    docs = spark.createDataFrame([(1, "this LICENSE is the license of nobody")], "doc_id long, text string")
    assert licences.scan_licences(docs, known).first()["licence"] == "Some-1.0"


def test_mixing_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 20, f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    order = mixing.curriculum(mixing.plan_mix(docs)).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    half = {s: sum(r["position"] <= 0.5 for r in order if r["source"] == s) / sum(r["source"] == s for r in order) for s in ("s0", "s1", "s2")}
    # early, even, late: the integral of 1 + tilt * (2t - 1) up to one half
    assert half["s0"] == pytest.approx(0.625, abs=0.02) and half["s1"] == pytest.approx(0.5, abs=0.02) and half["s2"] == pytest.approx(0.375, abs=0.02)


def test_probabilities_of_the_language_model_sum_to_one(spark):
    import numpy as np

    docs = spark.createDataFrame([("a b c a b d e",), ("a b a c",)], "text string")
    model, counts = brown.train(docs)
    held = counts.collect()
    assert np.allclose((10 ** model["step"]).sum(1), 1, atol=1e-6)
    total = sum(np.frombuffer(r["counts"], np.int64).sum() for r in held)
    assert total == model["n"] == 13


def test_hot_groups_of_near_copies(spark):
    """Six hundred copies and near copies of one text among others fall into one class."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(base)
        if i % 2:
            w[i % 200] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"y{i}_{j}" for j in range(50))) for i in range(50)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 600} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


def test_matrix_is_the_pairwise_likeness():
    import numpy as np

    texts = ["a b c d e f g h", "a b c d e f g x", "a b c d e a b c d e a b c d e", "a b c d e f g h", "q", "", "a b c d e a b c d e z"]
    idf = near_dedup.Idf(10, [(np.empty(0, np.int64), np.empty(0))] * 2)
    column = np.array([False, True, True, True, False, False, False])
    rows, cols = [t for t, c in zip(texts, column) if not c], [t for t, c in zip(texts, column) if c]
    got = near_dedup.jaccard_matrix(texts, column, idf)
    want = np.array([[near_dedup.weighted_jaccard([a], [b], idf)[0] for b in cols] for a in rows])
    assert np.allclose(got, want) and want.max() == 1.0 and ((want > 0) & (want < 1)).any()
