"""Threads, double marks and reading order against plain versions; components against a plain one."""

from __future__ import annotations

import random
from collections import defaultdict

from scriptoria.operators import annotations as A
from scriptoria.operators.components import components
from scriptoria.plans import annotations as P
from scriptoria.plans import library


def plain_components(links):
    of = {}

    def root(i):
        of.setdefault(i, i)
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    return {i: root(i) for i in of}


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randint(2000, 2600), rng.randint(2000, 2600)) for _ in range(500)] + [(7, None), (None, None), (9000, 9000), (5, 4), (5, 4)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = plain_components(links)
    assert {r["id"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_home(parents, x):
    """parents: of each mark the one it answers, or null."""
    looped = set()
    for start in parents:
        path, cur = [], start
        while cur is not None and cur not in path:
            path.append(cur)
            cur = parents.get(cur)
        if cur is not None:
            looped |= set(path[path.index(cur) :])
    while x not in looped and parents.get(x) is not None:
        x = parents[x]
    return x


def test_homes_with_loops_of_any_length(spark):
    rng = random.Random(11)
    docs = {
        1: {k: k - 1 if k else None for k in range(70)},  # a chain
        2: {k: (k + 1) % 37 for k in range(37)},  # one loop
        3: {**{k: (k + 1) % 8 for k in range(8)}, **{100 + k: 99 + k if k else 3 for k in range(40)}},  # a long tail into a loop whose length is a power of two
        4: {k: rng.choice([None, k, rng.randrange(60), 999]) for k in range(60)},  # answers to itself and to what is not there
        5: {k: rng.randrange(80) for k in range(80)},
        6: {0: None},
    }
    rows = [(d, x, up, False) for d, m in docs.items() for x, up in m.items()] + [(7, 1, 2, True), (7, 2, 1, None), (7, 3, 1, False)]
    docs[7] = {1: None, 2: 1, 3: 1}
    got = {(r["doc"], r["xref"]): r["home"] for r in A.homes(spark.createDataFrame(rows, "doc long, xref long, irt long, grouped boolean")).collect()}
    for d, m in docs.items():
        parents = {x: up if up in m else None for x, up in m.items()}
        for x in m:
            assert got[d, x] == plain_home(parents, x), (d, x)
    assert len(got) == len(rows)


def plain_double(rows):
    """rows in order: (id, like, comment, box); all marks kept so far are looked at."""
    kept, out = [], {}
    for i, like, comment, (x0, y0, x1, y1) in rows:
        for k in kept:
            if k["like"] != like or (k["comment"] and comment and k["comment"] != comment):
                continue
            if any(min(x1, b[2]) > max(x0, b[0]) and min(y1, b[3]) - max(y0, b[1]) > 0.5 * max(0.1, min(y1 - y0, b[3] - b[1])) for b in k["boxes"]):
                k["boxes"].append((x0, y0, x1, y1))
                k["comment"] = k["comment"] or comment
                out[i] = k["id"]
                break
        else:
            kept.append({"id": i, "like": like, "comment": comment, "boxes": [(x0, y0, x1, y1)]})
            out[i] = i
    return out


def test_double_marks_query(spark, sf_dir):
    rows = P.boxes(spark, sf_dir).collect()
    ordered = sorted(rows, key=lambda r: r["id"])
    want = plain_double([(r["id"], (r["doc"], r["page"], r["part"] % 2, int(r["quantity"] % 2)), f"c{r['part'] % 2}" if r["part"] % 3 == 0 else "", (r["x0"], r["y0"], r["x1"], r["y1"])) for r in ordered])
    got = {r["id"]: r["home"] for r in library.queries()["double_marks"](spark, sf_dir).collect()}
    assert got == want and any(i != h for i, h in want.items())


def test_double_marks_of_several_boxes_and_equal_ones(spark):
    like = "struct<page:long,kind:string>"
    marks = [(1, 1, "", (1, "h")), (2, 2, "x", (1, "h")), (3, 3, "y", (1, "h")), (4, 4, None, (1, "h")), (5, 5, "", (1, "u")), (6, 6, "", (1, None)), (7, 7, "", (1, "h"))]
    boxes = [(1, 0.0, 0.0, 50.0, 10.0), (1, 0.0, 20.0, 50.0, 30.0), (2, 40.0, 21.0, 300.0, 31.0), (3, 10.0, 0.0, 20.0, 10.0), (4, 290.0, 20.0, 310.0, 30.0), (5, 0.0, 0.0, 50.0, 10.0), (6, 0.0, 0.0, 50.0, 10.0), (7, 0.0, 0.0, 50.0, 10.0), (7, 5.0, 5.0, 5.0, 5.0)]
    m = spark.createDataFrame(marks, f"id long, seq long, comment string, like {like}")
    got = {r["id"]: r["home"] for r in A.double_marks(m, spark.createDataFrame(boxes, "id long, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 1}
    assert A.double_marks(m.limit(0), spark.createDataFrame([], "id long, x0 double, y0 double, x1 double, y1 double")).collect() == []


def plain_order(rows):
    """(id, line, place) of the boxes (id, x0, y0) of one page, read box by box."""
    out, line, left = [], 0, sorted(rows, key=lambda r: (r[2], r[0]))
    while left:
        line += 1
        own = [r for r in left if r[2] - left[0][2] <= 3.0]
        out += [(r[0], line, k) for k, r in enumerate(sorted(own, key=lambda r: (r[1], r[2], r[0])), 1)]
        left = [r for r in left if r not in own]
    return sorted(out)


def test_reading_order_query(spark, sf_dir):
    pages = defaultdict(list)
    for r in P.boxes(spark, sf_dir).collect():
        pages[r["doc"], r["page"]].append((r["id"], r["x0"], r["y0"]))
    got = defaultdict(list)
    for r in library.queries()["reading_order"](spark, sf_dir).collect():
        got[r["doc"], r["page"]].append((r["id"], r["line"], r["place"]))
    assert set(got) == set(pages)
    for k, rows in pages.items():
        assert sorted(got[k]) == plain_order(rows)


def test_reading_order_of_a_staircase(spark):
    """Each box 2 points below the one before: no gap is over 3, and yet it is many lines."""
    rows = [(1, 1, k, float(-k), 2.0 * k) for k in range(50)] + [(1, 2, 0, 5.0, 1.0), (1, 2, 1, 5.0, 1.0)]
    got = A.reading_order(spark.createDataFrame(rows, "doc long, page long, id long, x0 double, y0 double")).collect()
    assert sorted((r["id"], r["line"], r["place"]) for r in got if r["page"] == 1) == plain_order([r[2:] for r in rows[:50]])
    assert sorted((r["id"], r["line"], r["place"]) for r in got if r["page"] == 2) == [(0, 1, 1), (1, 1, 2)]


def test_homes_of_documents_in_one_piece_and_by_jumps(spark):
    """A bound below a document's marks sends it through the joins; either way gives the same."""
    rng = random.Random(5)
    rows = [(d, x, rng.randrange(90) if rng.random() < 0.9 else None, rng.random() < 0.1) for d in range(6) for x in range(20 * d + 1)]
    rows += [(None, 1, 2, False), (None, 2, None, False), (3, None, 5, False), (5, None, 999, False)]
    marks = spark.createDataFrame(rows, "doc long, xref long, irt long, grouped boolean")
    whole, jumped, mixed = (sorted(map(tuple, A.homes(marks, n).collect()), key=str) for n in (1000, 0, 50))
    assert whole == jumped == mixed and len(whole) == len(rows)


def test_threads_move_each_mark_a_few_times_only(spark):
    """The plan deals the marks once by document and once by thread; it joins no marks to marks."""
    rows = [(1, 1, None, False, 0, "a", "", ""), (1, 2, 1, True, 1, "", "t", "x"), (1, 3, 2, False, 2, "b", "u", "y"), (1, 4, 9, None, 3, None, None, None)]
    marks = spark.createDataFrame(rows, "doc long, xref long, irt long, grouped boolean, seq long, author string, created string, comment string")
    t = A.threads(marks)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    got = {r["xref"]: (r["author"], r["created"], r["comment"], [tuple(x) for x in r["replies"]]) for r in t.collect()}
    assert got == {1: ("a", None, None, []), 2: ("a", "t", "x", [("b", "u", "y")]), 4: (None, None, None, [])}


def test_double_marks_of_few_and_of_many_of_a_kind(spark):
    """A bound below a kind's marks sends it through links and their components; either way gives the same."""
    rng = random.Random(8)
    box = lambda: (lambda x, y: {"x0": x, "y0": y, "x1": x + rng.choice([0.0, 20.0, 60.0]), "y1": y + 9.0})(float(rng.randrange(0, 200, 5)), float(rng.randrange(0, 60, 3)))
    kinds = [None, *[{"page": rng.choice([None, 1, 2, 2, 2]), "kind": rng.choice(["h", "u"])} for _ in range(8)]]
    rows = [(i, rng.randrange(100), rng.choice(["", "", None, "a", "b"]), rng.choice(kinds), [box() for _ in range(rng.randrange(4))]) for i in range(150)]
    marks = spark.createDataFrame(rows, "id long, seq long, comment string, like struct<page:long,kind:string>, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    whole, linked, mixed = (sorted(map(tuple, A.double_marks_of(marks, n).collect())) for n in (1000, 0, 25))
    assert whole == linked == mixed and len(whole) == 150 and any(i != h for i, h in whole)


def test_double_marks_move_once_by_pack(spark, sf_dir):
    """The plan deals the lines by their keys and the marks by pack; it joins nothing."""
    plan = library.queries()["double_marks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
