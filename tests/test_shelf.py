"""Merges of chains, cascades and undoing of runs on small libraries; nothing is left that points to a missing paper."""

from __future__ import annotations

from scriptoria.operators import shelf as S
from scriptoria.plans import shelves as P


def small(spark, papers, categories=(), values=(), references=(), collections=(), members=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return S.Shelf(
        make(papers, "id long, doi string, title string, filename string"), make(categories, "paper_id long, category_id long, note string"), make(values, "paper_id long, field_id long, value string"),
        make(references, "id long, source_id long, matched_id long"), make(collections, "id long, deleted boolean"), make(members, "collection_id long, paper_id long, note string"),
    )


def table(d):
    return sorted(map(tuple, d.collect()), key=lambda r: tuple((v is not None, v) for v in r))


CHAIN = [(1, "10.1/A", "One", ""), (2, "10.1/a ", "Another long title", ""), (3, "", "Another  LONG títle!", "x"), (4, None, None, ""), (5, "", "short", ""), (6, "", "short", "")]


def test_chains_over_doi_and_title(spark):
    s = small(spark, CHAIN, [(3, 7, "three"), (2, 7, "two"), (3, 8, "own"), (5, 8, "five")], [(1, 1, ""), (3, 1, "late"), (2, 1, "first"), (2, 2, None)], [(1, 2, 3), (2, 5, 3), (3, 5, 2), (4, 5, None), (5, 1, 6)], [(1, False)], [(1, 3, "n3"), (1, 1, "n1"), (2, 3, None)])
    mapping = S.duplicates(s.papers)
    assert table(mapping) == [(2, 1), (3, 1)]
    m = S.merged(s, mapping)
    assert [r[0] for r in table(m.papers)] == [1, 4, 5, 6]
    assert table(m.categories) == [(1, 7, "two"), (1, 8, "own"), (5, 8, "five")]
    assert table(m.values) == [(1, 1, "first"), (1, 2, None)]
    assert table(m.references) == [(2, 5, 1), (3, 5, 1), (4, 5, None), (5, 1, 6)]
    assert table(m.members) == [(1, 1, "n1"), (2, 1, None)]
    assert {r["rows"] for r in S.lost(s, m).collect()} == {0}


def test_nothing_is_lost_on_the_tables(spark, sf_dir):
    s = P.shelf(spark, sf_dir)
    mapping = S.duplicates(s.papers).checkpoint()
    m = S.merged(s, mapping)
    assert mapping.count() > 0 and {r["rows"] for r in S.lost(s, m).collect()} == {0}
    roots = {r["dead"]: r["keep"] for r in mapping.collect()}
    assert not set(roots) & set(roots.values())
    pairs = lambda x, c: {(roots.get(r["paper_id"], r["paper_id"]), r[c]) for r in x.collect()}
    assert pairs(s.categories, "category_id") == {(r["paper_id"], r["category_id"]) for r in m.categories.collect()}
    assert pairs(s.members, "collection_id") == {(r["paper_id"], r["collection_id"]) for r in m.members.collect()}


def test_delete_cascades(spark):
    s = small(spark, CHAIN, [(1, 1, "a")], [(1, 1, "v"), (2, 1, "w")], [(1, 1, 2), (2, 2, 1)], [(1, False)], [(1, 1, "n")])
    d = S.deleted(s, spark.createDataFrame([(1,), (1,), (99,)], "id long"))
    assert [r[0] for r in table(d.papers)] == [2, 3, 4, 5, 6]
    assert table(d.categories) == [] and table(d.values) == [(2, 1, "w")] and table(d.references) == [(2, 2, None)] and table(d.members) == [] and table(d.collections) == [(1, False)]


LOG = "run_id int, seq int, op string, id long, field string, before string, after string"


def test_undo_in_any_order(spark):
    """A field written by three runs in turn; undoing the middle one, then the others, ends at what was there before all."""
    s = small(spark, [(1, "", "t", "c"), (2, "", "kept by hand", "b"), (3, "", "t", None)], collections=[(1, False), (2, True)], members=[(1, 1, "n")])
    log = spark.createDataFrame(
        [(1, 1, "field", 1, "filename", "", "a"), (2, 2, "field", 1, "filename", "a", "x"), (2, 3, "field", 1, "filename", "x", "b"), (3, 4, "field", 1, "filename", "b", "c"), (1, 1, "field", 2, "title", "old", "new"), (2, 5, "field", 3, "filename", "was", None), (2, 6, "collection", 1, None, None, None), (2, 7, "paper", 77, None, None, None)], LOG,
    )
    names = lambda x: {r["id"]: (r["title"], r["filename"]) for r in x.papers.collect()}
    one, left = S.undone(s, log, 2)
    assert names(one) == {1: ("t", "c"), 2: ("kept by hand", "b"), 3: ("t", "was")}
    assert table(one.collections) == [(1, True), (2, True)] and table(one.members) == [(1, 1, "n")]
    assert {(r["run_id"], r["before"]) for r in left.collect() if r["field"] == "filename"} == {(1, ""), (3, "a")}
    two, left = S.undone(one, left, 3)
    assert names(two)[1] == ("t", "a")
    three, left = S.undone(two, left, 1)
    assert names(three)[1] == ("t", "") and left.count() == 0
    same, kept = S.undone(s, log, 9)
    assert names(same) == names(s) and kept.count() == log.count()
