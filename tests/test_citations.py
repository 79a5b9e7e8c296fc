"""Citation forms one by one, and the automaton against a search for each reference on its own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import citations as C

REF = {"ref_index": 1, "names": ["Müller", "Roe"], "year": "2001", "phrases": []}


@pytest.mark.parametrize(
    ("body", "how"),
    [
        ("(Müller, 2001)", "author_year"), ("(MÜLLER\net al., 2001a, S. 3)", "author_year"), ("[Müller,\n2001 p. 5]", "author_year"), ("Müller et al. (2001)", "author_year"),
        ("Müller\net al.\n(2001, p. 2)", "author_year"), ("Müller und Other\n(2001)", "author_year"), ("(vgl. Müller,\n2001)", "author_year"), ("( vgl\nMüller et al.\n2001 )", "author_year"),
        ("(Müller & Roe,\n\n2001)", "author_year"), ("Müller and\nRoe\n(2001)", "author_year"), ("Müller in the spring of 2001", "author_year"), ("Müller und\nOther\n2001", None),
        ("Müller,\n\n2001 without brackets", None), ("Müller and long before the year that is 2001", None), ("(as Müller says)", "author"), ("[1; Müller]", "author"), ("see Müller", "author"), ("according  to\nMüller", "author"),
        ("according Müller", None), ("(closed) Müller (open", None), ("(open Müller", None), ("nothing", None), ("", None),
    ],
)
def test_forms(body, how):
    assert C.how_cited([REF], body) == [how]


def test_numbers_names_and_titles():
    assert C.cited_numbers("[12, 3-5] [7 – 9; x] [1] [20-900]") == {12, 3, 4, 5, *range(20, 120)}
    refs = [dict(REF, ref_index=k, names=[], phrases=p) for k, p in ((3, []), (40, ["the hidden rivers"]), (41, ["rivers run deep"]))]
    assert C.how_cited(refs, "[3-5] xthe\n hidden\t rivers") == ["numeric", "title", None]
    assert C.how_cited([dict(REF, names=["Roe"], year="1999")], "(Roe) " * 50) == ["author"]
    assert C.how_cited([dict(REF, names=["Roe"], year="1999")], "(Roe) " * 51) == [None]
    assert C.how_cited([dict(REF, names=["Xy"], year=None)], "(Xy)") == [None]


def test_names_and_phrases(spark):
    rows = [("Mueller, Hans; Schmidt, A.",), ("Hans Mueller and Anna Schmidt-Ott",), ("Ghazi Wakili, K. & X",), ("",), (None,), ("O'Brien, P.",)]
    got = spark.createDataFrame(rows, "a string").select(C.last_names(F.col("a"))).collect()
    assert [r[0] for r in got] == [["Mueller", "Schmidt"], ["Mueller", "Schmidt-Ott"], ["Ghazi Wakili"], [], [], ["OBrien"]]
    rows = [("The hidden rivers of northern lakes",), ("A to of in at is on by",), ("Short title",), (None,), ("One two three four five six seven words",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(C.phrases(F.col("t"))).collect()]
    assert got[0] == ["the hidden rivers", "hidden rivers northern", "rivers northern lakes"] and got[1:4] == [[], [], []]
    assert got[4][0] == "one two three four" and len(got[4]) == 5


def test_many_references_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    refs = [(1, k, f"Name{'abcdefghij'[k % 10]}, X.", 1900 + k, None) for k in range(60)] + [(2, 1, "Lost, L.", 2000, None), (3, 1, None, None, None)]
    bodies = [(1, " ".join(f"(Name{'abcdefghij'[k % 10]}, {1900 + k})" for k in range(0, 60, 3)) + " " + "word " * 40), (3, None)]
    used = C.usage(spark.createDataFrame(refs, "doc_id long, ref_index int, authors string, year int, title string"), spark.createDataFrame(bodies, "doc_id long, body string"))
    got = {(r["doc_id"], r["ref_index"]): r["how"] for r in used.collect()}
    assert len(got) == 62 and got[2, 1] is None and got[3, 1] is None
    assert all((got[1, k] == "author_year") == (k % 3 == 0) for k in range(60))
    total = {r["doc_id"]: r.asDict() for r in C.summary(used).collect()}
    assert total[2] == {"doc_id": 2, "total": 1, "used_in_text": 0, "not_used_in_text": 1, "first_unused": 1}


def test_texts_and_titles_are_split_once(spark):
    assert str(C.phrases(F.col("t"))).count("split(") == 1
    refs, bodies = (spark.createDataFrame([], s) for s in ("doc_id long, ref_index int, authors string, year int, title string", "doc_id long, body string"))
    plan = C.usage(refs, bodies)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1  # references do not meet their own counts
