"""Record mappings and field rules on values that no table holds."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from scriptoria.functions import fields as X
from scriptoria.functions import people as P
from scriptoria.operators import graph, matching, references, search
from scriptoria.sources import records


def one(frame):
    return [r.asDict() for r in frame.collect()]


def test_messages_that_hold_little(spark):
    rows = [("a", None), ("b", ""), ("c", "no json"), ("d", "{}"), ("e", json.dumps({"issued": {"date-parts": [[None]]}, "title": [], "author": [{}], "container-title": ["", None]}))]
    for r in one(records.crossref(spark.createDataFrame(rows, "doi string, message string"))):
        assert r["year"] is None and all(v == "" for k, v in r.items() if k not in ("doi", "year")), r
    for r in one(records.datacite(spark.createDataFrame(rows, "doi string, message string"))):
        assert r["doi"] and r["title"] == r["authors"] == r["item_type"] == "" and r["year"] is None
    for r in one(records.openlibrary(spark.createDataFrame(rows[:4], "isbn string, message string"))):
        assert r["isbn"] and r["title"] == r["authors"] == "" and r["year"] is None
    assert records.crossref(spark.createDataFrame([], "doi string, message string")).count() == 0


def test_crossref_details(spark):
    m = {
        "type": "Proceedings-Article", "title": [" ", "On <i>x</i>&nbsp;&lt; y"], "abstract": "<jats:title>Abstract</jats:title> <p>Text  here</p>", "container-title": ["Lecture Notes in X"], "author": [{"family": "Doe"}, {"given": "J", "family": "Roe"}],
        "published-online": {"date-parts": [["2020", "x", 3]]}, "issued": {"date-parts": [[2021, 2, 30]]}, "ISSN": ["1-2"], "ISBN": ["9", "8"], "page": " 1-2 ", "URL": "http://dx.doi.org/10.1/x",
    }
    r = one(records.crossref(spark.createDataFrame([("10.1/x", json.dumps(m))], "doi string, message string")))[0]
    assert (r["item_type"], r["title"], r["abstract"], r["authors"]) == ("conference", "On x < y", "Text here", "Doe; Roe, J")
    assert (r["booktitle"], r["series"], r["journal"], r["year"], r["pub_date"]) == ("Lecture Notes in X", "", "", 2020, "")
    assert (r["issn"], r["isbn"], r["pages"], r["url"]) == ("1-2", "9, 8", "1-2", "")


def test_organisations_by_column_as_by_value(spark):
    names = ["Institute of Rivers", "Doe, Jane", "Jane Doe", "{ACME}", "River GmbH", "Umweltbundesamt", "a b c d e", "van der a b c d", "", "Universität Wien", "Behörde", "Grouper"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.reads_as_organisation(F.col("n")).alias("o")).collect()
    assert {r["n"]: r["o"] for r in rows} == {n: P.is_organisation(n) for n in names}


def test_roman_and_letters(spark):
    pairs = list(zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True))

    def plain(n):
        out = ""
        for v, c in pairs:
            out, n = out + c * (n // v), n % v
        return out

    got = spark.range(1, 4000).select("id", X.label_number(F.col("id").cast("int"), F.lit("R")).alias("r"), X.label_number(F.col("id").cast("int"), F.lit("a")).alias("a")).collect()
    assert {r["id"]: r["r"] for r in got} == {n: plain(n).upper() for n in range(1, 4000)}
    assert {r["id"]: r["a"] for r in got if r["id"] in (1, 26, 27, 53)} == {1: "a", 26: "z", 27: "aa", 53: "aaa"}


def test_pieces_are_whole_lines_and_the_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60)))
        got = references.cut_lines(text, 7)
        assert "".join(got) == text and all(len(p) <= 7 for p in got) and got
        for p, rest in zip(got, got[1:], strict=False):
            assert p.endswith("\n") or "\n" not in p[1:]
            assert rest


def test_a_start_that_stands_twice_is_no_place(spark):
    page = "The river de-\nlta is wide and slow here. The river delta ends."
    rows = [("the RIVER delta is wide", "The RIVER delta is wide".replace("The", "the")), ("The river", None), ("river delta not on this page", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(rows)], "i int, p string").select("i", search.locate(F.col("p"), F.lit(page)).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [w for _, w in rows]


def test_values_that_say_the_same(spark):
    d = spark.range(1)
    same = lambda f, a, b: d.select(X.same_value(f, F.lit(a), F.lit(b)).alias("s")).first()["s"]
    assert same("authors", "Doe, Jane and Roe, R.", "doe, jane; roe, r.") and not same("authors", "Doe, Jane", "Doe, John")
    assert same("url", "http://x", "http://x//") and not same("isbn", "", "") and same("title", None, " .") and not same("year", 2001, 2000)


def test_analysis_of_an_import(spark):
    shelf = spark.createDataFrame([(1, "10.1/a", "x", "f.pdf"), (2, "", "A study of the large delta rivers", None)], "id long, doi string, title string, filename string")
    asked = spark.createDataFrame([(7, "10.1/A", ""), (8, "", "A study of the large delta river"), (9, "", "something else entirely")], "ref_id long, doi string, title string")
    got = {r["ref_id"]: (r["matched_id"], r["has_file"]) for r in matching.analyse(asked, shelf).collect()}
    assert got == {7: (1, True), 8: (2, False), 9: (None, False)}


def test_prefetch_fills_up_to_the_bound(spark):
    e = spark.createDataFrame([(s, t) for t in range(10) for s in range(2 if t < 3 else 1)], "source long, target long")
    assert sorted(r["target"] for r in graph.prefetch(e, 5).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r["target"] for r in graph.prefetch(e, 2).collect()) == [0, 1, 2]


def test_files_choose_in_order(spark):
    rng = random.Random(4)
    rows = [(f"f{i:02}", j, rng.randint(0, 2), round(rng.random(), 2)) for i in range(15) for j in range(12) if rng.random() < 0.4]
    want, taken = set(), set()
    for f in sorted({r[0] for r in rows}):
        open_ones = sorted((t, -s, j) for g, j, t, s in rows if g == f and j not in taken)
        if open_ones:
            t, s, j = open_ones[0]
            taken.add(j)
            want.add((f, j, t, -s))
    frame = spark.createDataFrame(rows, "file string, id long, tier int, score double")
    assert {tuple(r) for r in matching.in_order(frame).collect()} == want
    assert matching.in_order(frame.filter("false")).count() == 0


def test_search_in_what_was_chosen(spark):
    pool = spark.createDataFrame([(1, "river delta"), (2, "river"), (3, "lake"), (4, "river river")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 1.0])], "id long, vector array<double>")
    q, ids = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>"), spark.createDataFrame([(1,), (2,), (3,)], "id long")
    run = lambda word, v, i: [(r["mode"], r["id"]) for r in search.within(pool, spark.createDataFrame([(word, 1)], "term string, qtf int"), v, q, i).orderBy("rank").collect()]
    assert run("delta", vectors, ids) == [("hybrid", 1), ("hybrid", 3)]
    assert run("nowhere", vectors, ids) == [("semantic", 1), ("semantic", 3)]
    assert run("delta", vectors.filter("false"), ids) == [("bm25", 1)]
    assert run("delta", vectors, ids.filter("false")) == []
    none, some = vectors.filter("false").select("id"), vectors.select("id")
    assert search.semantic_or_lexical(none, some).count() == 0
    assert {r["mode"] for r in search.semantic_or_lexical(None, some).collect()} == {"lexical"}
