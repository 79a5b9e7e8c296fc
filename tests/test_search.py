"""Fusion of whole rankings against sorting them; the steps of both search ladders."""

from __future__ import annotations

import random

import pytest

from scriptoria.operators import retrieval as R
from scriptoria.operators import search as S


def plain_fusion(rankings: list[dict], k: int) -> list[tuple]:
    points, seen = {}, {}
    for number, scores in enumerate(rankings):
        for place, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i)), 1):
            points[i] = points.get(i, 0.0) + 1.0 / (60 + place)
            seen.setdefault(i, (number, place))
    order = sorted(points, key=lambda i: (-round(points[i], 12), seen[i]))[:k]
    return [(i, round(points[i], 6), n) for n, i in enumerate(order, 1)]


def frame(spark, scores: dict):
    return spark.createDataFrame([(i, float(s)) for i, s in scores.items()], "id long, score double")


@pytest.mark.parametrize("seed, sizes, values", [(0, (900, 700), 5), (1, (900, 3), 1000), (2, (2, 800), 3), (3, (4, 4), 2), (4, (0, 50), 9), (5, (400, 400, 400), 7)])
def test_fusion_of_whole_rankings(spark, seed, sizes, values):
    """Heads of 60 + 2 k places and the places of what stands in the other's head give what whole sorts give, ties included."""
    rng = random.Random(seed)
    rankings = [{i: rng.randrange(values) for i in rng.sample(range(1000), n)} for n in sizes]
    for k in (1, 7):
        found = R.fuse_whole([frame(spark, r) for r in rankings], k).orderBy("rank").collect()
        assert [(r["id"], r["score"], r["rank"]) for r in found] == plain_fusion(rankings, k)


def test_opposite_rankings(spark):
    """The first of one ranking is the last of the other, far below its head."""
    a, b = {i: -i for i in range(500)}, {i: i for i in range(500)}
    found = R.fuse_whole([frame(spark, a), frame(spark, b)], 6).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["rank"]) for r in found] == plain_fusion([a, b], 6)


def test_places(spark):
    rng = random.Random(9)
    scores = {i: rng.randrange(6) for i in range(300)}
    order = sorted(scores, key=lambda i: (-scores[i], i))
    ids = [0, 17, 299, 5, 1000]
    found = R.places(frame(spark, scores), spark.createDataFrame([(i,) for i in ids], "id long")).collect()
    assert {r["id"]: r["rank"] for r in found} == {i: order.index(i) + 1 for i in ids if i in scores}


@pytest.fixture(scope="module")
def shelf(spark):
    papers = spark.createDataFrame([(1, "Rivers", "of sand"), (2, None, "lake water"), (3, "Stone", None), (4, None, None)], "id long, title string, abstract string")
    chunks = spark.createDataFrame([(1, 0, "sand and water"), (1, 1, "sand sand"), (2, 0, "a lake"), (3, 0, None), (None, 0, "sand"), (9, 0, "sand of a lost paper")], "paper_id long, chunk_id int, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 1.0])], "id long, vector array<double>")
    parts = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.5, 0.5]), (3, 0, [1.0, 0.1]), (9, 0, [1.0, 0.0]), (1, 7, [1.0, 0.0])], "paper_id long, chunk_id int, vector array<double>")
    return papers, chunks, vectors, parts, spark.createDataFrame([([1.0, 0.2],)], "vector array<double>")


def rows(found):
    return [(r["mode"], r["note"], r["id"]) for r in found.orderBy("rank").collect()]


def test_papers(shelf):
    papers, chunks, vectors, _, query = shelf
    ask = lambda q, v, x: rows(S.search_papers(papers, chunks, q, v, x))
    assert ask("sand", vectors, query) == [("hybrid", "", 1), ("hybrid", "", 2)]
    assert ask("lake", vectors, query) == [("hybrid", "", 2), ("hybrid", "", 1)]
    assert ask("absent", vectors, query) == [("semantic", "", 1), ("semantic", "", 2)]
    assert ask("stone", None, query) == [("bm25", "", 3)]
    assert ask("stone", vectors.filter("false"), query) == [("bm25", "no_vectors", 3)]
    assert ask("stone", vectors, None) == [("bm25", "not_embedded", 3)]
    assert ask("  ", vectors, query) == ask(None, vectors, query) == []
    assert rows(S.search_papers(papers, chunks, "sand", vectors, query, 0)) == [("hybrid", "", 1)]
    assert rows(S.search_papers(papers.filter("false"), chunks, "sand", vectors, query)) == []


def test_passages(shelf):
    papers, chunks, vectors, parts, query = shelf
    ask = lambda q, v, p, x, n=20: [(m, note, tuple(i)) for m, note, i in rows(S.search_passages(papers, chunks, q, v, p, x, n_papers=n))]
    # paper 3 has no vector, 9 is no paper, chunk 7 of 1 is not there; chunk 1 of paper 1 comes by its words alone
    assert ask("sand", vectors, parts, query) == [("hybrid", "", (1, 0)), ("hybrid", "", (1, 1)), ("hybrid", "", (2, 0))]
    assert ask("lake", vectors, parts, query, 1) == [("semantic", "", (1, 0))]
    assert ask("sand", None, parts, query)[0] == ("bm25", "", (1, 1))
    assert ask("sand", vectors, parts.filter("false"), query)[0] == ("bm25", "no_index", (1, 1))
    assert ask("sand", vectors.filter("false"), parts, query)[0] == ("bm25", "no_index", (1, 1))
    assert ask("sand", vectors, parts, None)[0] == ("bm25", "not_embedded", (1, 1))
    assert ask("sand", vectors, parts.filter("paper_id = 9"), query) == []
    assert ask("", vectors, parts, query) == []


def test_texts_are_read_for_near_papers_only(spark, tmp_path):
    """A blank text was ranked against all texts, and each step cut all chunks anew to find those of a few papers."""
    put = lambda name, rows, schema: (spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    papers = put("papers", [(i, f"title {i}", "words") for i in range(9)], "id long, title string, abstract string")
    chunks = put("chunks", [(i, c, f"common w{i} c{c}") for i in range(9) for c in range(3)], "paper_id long, chunk_id int, text string")
    vectors = put("vectors", [(i, [1.0, float(i)]) for i in range(9)], "id long, vector array<double>")
    parts = put("parts", [(i, c, [1.0, float(c)]) for i in range(9) for c in range(2)], "paper_id long, chunk_id int, vector array<double>")
    one = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    found = S.search_passages(papers, chunks, "w1 common", vectors, parts, one, 4, n_papers=2)
    assert {(r["id"]["paper_id"], r["mode"]) for r in found.collect()} == {(0, "hybrid"), (1, "hybrid")}
    assert found.inputFiles() == []  # what stands to be ranked has been taken out
    for blank in (S.search_passages(papers, chunks, " ", vectors, parts, one), S.search_papers(papers, chunks, "\n", vectors, one)):
        assert blank.inputFiles() == [] and blank.count() == 0
    assert S.search_papers(papers, chunks, "", None, None).schema == S.search_papers(papers, chunks, "title", None, None).schema
    ask = lambda v, p, x: S.search_passages(papers, chunks, "w1", v, p, x).select("mode", "note").distinct().collect()
    assert ask(vectors, parts, None) == [("bm25", "not_embedded")] and ask(vectors, parts.filter("paper_id > 100"), None) == [("bm25", "no_index")]
    assert ask(vectors.filter("false"), parts, None) == ask(vectors.filter("false"), parts, one) == ask(vectors, None, one) == [("bm25", "no_index")]
    far = spark.createDataFrame([(77, [1.0, 0.0])], "id long, vector array<double>")  # of no paper: there are vectors, but nothing is near
    assert ask(far, parts, None) == [("bm25", "not_embedded")] and ask(far, parts, one) == []
