"""Find-or-create by DOI against a loop over the items; keys past taken ones; running sums over pieces."""

from __future__ import annotations

import random
import re

from scriptoria.operators import catalogue, running
from scriptoria.operators.intake import find_or_create
from scriptoria.operators.running import running_sum
from pyspark.sql import functions as F

ITEM = "pos long, doi string, title string, authors string, year int, extra string"
PAPER = "id long, doi string, cite_key string, filename string"
WORK = "doi string, authors string, year int"


def suffix(n: int) -> str:
    out = ""
    while n:
        n, out = (n - 1) // 26, chr(97 + (n - 1) % 26) + out
    return out


def give(authors, year, taken: set) -> str:
    base = (re.sub(r"\W", "", authors.split(",")[0]) if authors else "Unknown") + (str(year) if year else "XXXX")
    n = 0
    while base + suffix(n) in taken:
        n += 1
    return base + suffix(n)


def plain(items, papers, works) -> dict:
    """One item after the other, as a reader would."""
    library = {}
    for i, doi, key, name in sorted(papers):
        if doi and doi.strip():
            library.setdefault(doi.strip().lower(), [i, key or "", "fetched" if name else "none"])
    taken, top = {p[2] for p in papers if p[2]}, max([p[0] for p in papers], default=0)
    found = {w[0]: w for w in works}
    made, out = {}, {}
    for pos, doi, _, authors, year, _ in sorted(items):
        key = re.sub(r"^(https?://doi\.org/|doi:)", "", (doi or "").strip().lower()).rstrip(".")
        authors, year = (authors or "").strip(), year or 0
        if not key:
            out[pos] = (key, False, None)
            continue
        created = key not in library
        if created:
            top += 1
            cite = give(authors, year, taken)
            taken.add(cite)
            library[key] = [top, cite, "none"]
            made[key] = (authors, year)
        out[pos] = (key, created, library[key])
    for key, (authors, year) in made.items():
        _, a, y = found.get(key, (None, None, None))
        if not authors and not year and (a or y):
            taken.discard(library[key][1])
            library[key][1] = give(a, y, taken)
            taken.add(library[key][1])
    return {pos: (k, c, *(v or [None, "", "none"])) for pos, (k, c, v) in out.items()}


def answers(found) -> dict:
    return {r["pos"]: (r["doi"] if r["paper_id"] is not None else "", r["created"], r["paper_id"], r["cite_key"], r["pdf"]) for r in found.collect()}


def test_against_a_loop(spark):
    rng = random.Random(5)
    names = ["Doe, J.", "Roe", None, "", "Ünal, Ö."]
    papers = [(i, rng.choice(["10.1/A%d" % (i % 9), "", None]), rng.choice(["Doe2001", "DoeXXXXa", "UnknownXXXX", "UnknownXXXXb", "Roe2002", "", None, "own key"]), rng.choice(["f.pdf", "", None])) for i in range(30)]
    items = [(pos, rng.choice(["10.1/a%d", "doi:10.1/B%d.", "https://doi.org/10.1/b%d", " 10.1/c%d "]) % rng.randrange(40) if rng.random() < 0.9 else rng.choice([None, " "]), "t", rng.choice(names), rng.choice([2001, 2002, 0, None]), "x") for pos in rng.sample(range(10**6), 150)]
    works = [(f"10.1/{c}{i}", rng.choice(["Doe, K.", None, "Late"]), rng.choice([2001, None])) for c in "bc" for i in range(40)]
    found = find_or_create(spark.createDataFrame(items, ITEM), spark.createDataFrame(papers, PAPER), spark.createDataFrame(works, WORK))
    assert answers(found) == plain(items, papers, works)


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert answers(find_or_create(none(ITEM), none(PAPER), none(WORK))) == {}
    one = spark.createDataFrame([(7, "10.1/x", None, None, None, None)], ITEM)
    assert answers(find_or_create(one, none(PAPER), none(WORK))) == {7: ("10.1/x", True, 1, "UnknownXXXX", "none")}


def test_keys_past_taken_ones(spark):
    rng = random.Random(2)
    held = {"Doe2001" + suffix(n) for n in rng.sample(range(1200), 500)} | {"Doe2001", "Roe2001zz", "doe2001", "Doe2001aA", "Doe2001" + "z" * 20}
    papers = spark.createDataFrame([(i, "Doe", 2001) for i in range(0, 900_000, 900)] + [(-1, "Roe", 2001)], "id long, authors string, year int")
    found = {r["id"]: r["cite_key"] for r in catalogue.allocate_keys(papers, spark.createDataFrame([(k,) for k in held | {None}], "cite_key string")).collect()}
    taken, expected = set(held), {-1: "Roe2001"}
    for i in range(0, 900_000, 900):
        expected[i] = give("Doe", 2001, taken)
        taken.add(expected[i])
    assert found == expected


def test_running_sum_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(running, "BITS", 3)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in rng.sample(range(-100, 300), 200)]
    found = running_sum(spark.createDataFrame(rows, "g string, i long, v int"), "s", F.col("v"), ["g"], "i").collect()
    assert len(found) == 200
    for r in found:
        assert r["s"] == sum(v for g, i, v in rows if g == r["g"] and i <= r["i"])
