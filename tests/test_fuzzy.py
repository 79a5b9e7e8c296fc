"""The title join loses no pair: equal to scoring all pairs."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.operators import fuzzy
from scriptoria.operators import matching as M
from scriptoria.plans.base import papers
from scriptoria.plans.documents import title_probes


def words(text):
    return " ".join(sorted((text or "").lower().split()))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best_of_all(ref, titles, least=85):
    found = [(-200.0 * fuzzy.common_length(ref, t) / (len(ref) + len(t)), i) for i, t in titles if t]
    found = [f for f in found if -f[0] >= least]
    return min(found, default=None)


@settings(max_examples=150, deadline=None)
@given(st.text("abc d", max_size=14), st.text("abc d", max_size=14))
def test_common_length(a, b):
    assert fuzzy.common_length(a, b) == longest_common(a, b)


def test_no_candidate_is_lost():
    """Texts over few letters with edits up to the threshold, so that trigrams repeat and shift."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 90))) for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 5))):
                at = rng.randrange(len(c) + 1)
                if rng.random() < 0.5 and len(c) > 5:
                    del c[min(at, len(c) - 1)]
                else:
                    c.insert(at, rng.choice("abcde "))
            texts.append("".join(c))
    titles = fuzzy.Titles(texts, list(range(len(texts))))
    pairs = 0
    for ref in base:
        kept = {titles.ids[j] for j in titles.candidates(ref)}
        for i, t in enumerate(texts):
            if 200 * fuzzy.common_length(ref, t) >= 85 * (len(ref) + len(t)):
                pairs += 1
                assert i in kept
    assert pairs > 200


def test_query_equals_all_pairs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fuzzy, "PART", 37)  # several parts a band
    monkeypatch.setattr(fuzzy, "BLOCK", 1)
    refs = {r["ref_id"]: r for r in title_probes(spark, sf_dir).collect()}
    shelf = [(r["id"], words(r["title"])) for r in papers(spark, sf_dir).collect()]
    got = {r["ref_id"]: r for r in M.match(title_probes(spark, sf_dir), papers(spark, sf_dir)).collect()}
    assert set(got) == set(refs)
    for k, r in refs.items():
        if got[k]["strategy"] == "doi":
            continue
        best = best_of_all(words(r["title"]), shelf) if len(r["title"].strip()) >= 10 else None
        assert (got[k]["matched_id"], got[k]["confidence"]) == ((best[1], round(-best[0] / 100, 3)) if best else (None, None))


def test_whole_library_against_itself(spark, sf_dir, monkeypatch):
    """Every title, with its last word cut, finds what all pairs find."""
    monkeypatch.setattr(fuzzy, "PART", 50)
    p = papers(spark, sf_dir).select("id", "title")
    rows = p.collect()
    refs = spark.createDataFrame([(r["id"], " ".join(r["title"].split()[:-1]) or None) for r in rows], "ref_id long, title string")
    got = {r["ref_id"]: (-r["score"], r["matched_id"]) for r in fuzzy.best_titles(refs, p).collect()}
    shelf = [(r["id"], words(r["title"])) for r in rows]
    want = {}
    for r in refs.collect():
        if r["title"] and len(r["title"].strip()) >= 10 and (best := best_of_all(words(r["title"]), shelf)):
            want[r["ref_id"]] = best
    assert got == want and len(want) > 20


def test_odd_titles(spark):
    lib = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "ﬁrst tïtle of 𝔘 things"), (5, "first title of two things"), (6, "first title of two things")], "id long, title string")
    refs = spark.createDataFrame([(1, None), (2, "  "), (3, "short"), (4, "things 𝔘 of tïtle ﬁrst"), (5, "TWO things of title first"), (6, "nothing like any of these")], "ref_id long, title string")
    assert sorted((r["ref_id"], r["matched_id"], r["score"]) for r in fuzzy.best_titles(refs, lib).collect()) == [(4, 4, 100.0), (5, 5, 100.0)]
    assert fuzzy.best_titles(refs, lib.limit(0)).collect() == []
    assert fuzzy.best_titles(refs.limit(0), lib).collect() == []


def test_many_texts_at_once_and_few_scored_singly(monkeypatch):
    """Numbers of 63 bits carry over; equal to a text at a time; equal titles are scored once and no title a text at a time."""
    import numpy as np

    from scriptoria.operators.common import Texts

    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abc dé𝔘") for _ in range(n))
    texts = [made(rng.randint(0, 150)) for _ in range(200)]
    chars = Texts(texts)
    for n in (0, 1, 62, 63, 64, 126, 127, 190):
        a = made(n)
        want = [fuzzy.common_length(a, t) for t in texts]
        assert list(chars.common(a, np.arange(200))) == want and (chars.shared(a) >= want).all()
    base = [made(60) for _ in range(40)]
    titles = fuzzy.Titles([b[1:] + rng.choice("abc") for b in base for _ in range(3)], list(range(120)))
    want = [best_of_all(b, list(zip(titles.ids, titles.texts))) for b in base]
    monkeypatch.setattr(fuzzy, "CHUNKS", (1, 2))
    monkeypatch.setattr(fuzzy, "common_length", None)
    assert [(-f[0], f[1]) for b in base if (f := titles.best(b))] == [w for w in want if w]


def test_shelf_equals_all_pairs(monkeypatch):
    """The best by token-set ratio, own words at the end of either side or of none, empty texts too; no title is scored singly."""
    rng = random.Random(4)
    shelf_words = ["".join(rng.choice("abdé𝔘") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    made = lambda: " ".join(rng.choice(shelf_words) for _ in range(rng.choice([0, 1, 2, 5, 20, 60])))
    rows = [(made(), i) for i in range(200)] + [("", 7000), ("a b", 1), ("a b", 0)]
    items = ["", "a b", *[made() for _ in range(30)], *[t + " zz" for t, _ in rows[:30]]]
    want = [sorted((-M.token_set_ratio(x, t), i) for t, i in rows)[:3] for x in items]
    monkeypatch.setattr(M, "CHUNKS", (7, 50))
    monkeypatch.setattr(M, "token_set_ratio", None)
    shelf = M.Shelf(rows)
    assert [shelf.best(x, 3) for x in items] == want


def test_match_of_many_papers_with_one_doi(spark):
    """Papers are brought to one a DOI before the join, so a DOI's references do not meet all its papers; no reference left, no titles."""
    from scriptoria.operators import matching as M

    papers = spark.createDataFrame([(i, "10.1/A", "a title of some length") for i in range(9, 3, -1)] + [(1, "", "no identifier at all"), (2, None, None)], "id long, doi string, title string")
    refs = papers.filter("id > 3").withColumnRenamed("id", "ref_id")
    found = M.match(refs, papers)
    assert {(r["ref_id"], r["matched_id"], r["strategy"]) for r in found.collect()} == {(i, 4, "doi") for i in range(4, 10)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [d#" in plan and "FlatMapCoGroupsInPandas" not in plan


def test_references_share_the_steps_of_scoring(monkeypatch):
    """Pairs of many references are scored together, each in a band of one number; equal to all pairs, texts of any alphabet; only long texts take the whole table."""
    from scriptoria.operators.common import Texts

    rng = random.Random(11)

    def edited(t, share):
        c = list(t)
        for _ in range(rng.randint(0, int(share * len(t)))):
            at = rng.randrange(len(c) + 1)
            if rng.random() < 0.5 and len(c) > 2:
                del c[min(at, len(c) - 1)]
            else:
                c.insert(at, rng.choice("abcd é𝔘"))
        return "".join(c)

    base = ["".join(rng.choice("abcd é𝔘") for _ in range(rng.choice([1, 3, 16, 63, 64, 65, 120]))) for _ in range(70)]
    texts = [edited(b, 0.2) for b in base for _ in range(4)] + ["", "a"]
    refs = [*base, *[edited(b, 0.25) for b in base], *[edited(b, 0.9) for b in base], "ж" * 30]
    titles = fuzzy.Titles(texts, list(range(len(texts))))
    want = [best_of_all(r, [(i, t) for i, t in enumerate(texts)]) for r in refs]
    want = [w and (-w[0], w[1]) for w in want]
    assert sum(w is None for w in want) > 5 and sum(w is not None for w in want) > 70
    with monkeypatch.context() as m:
        m.setattr(Texts, "common", None)
        assert titles.best_of(refs) == want
        m.setattr(fuzzy, "CHUNKS", (3, 40))
        assert titles.best_of(refs) == want
    long = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (180, 200, 220, 511, 513, 900)]
    titles = fuzzy.Titles([edited(t, 0.1) for t in long for _ in range(3)], list(range(18)))
    pairs = list(zip(titles.ids, titles.texts))
    got = titles.best_of(long)
    assert got == [(-w[0], w[1]) for w in (best_of_all(r, pairs) for r in long)]
    for least in (60, 100):
        titles = fuzzy.Titles(texts, list(range(len(texts))))
        want = [best_of_all(r, list(enumerate(texts)), least) for r in refs]
        assert titles.best_of(refs, least) == [w and (-w[0], w[1]) for w in want]


def test_common_words_give_a_floor(monkeypatch):
    """What common words alone give is never above the score, and is the answer where k titles have all words or none but these; a floor loses nothing at or above it."""
    rng = random.Random(6)
    shelf_words = ["".join(rng.choice("abdé𝔘") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    made = lambda n: " ".join(rng.choice(shelf_words) for _ in range(n))
    rows = [(made(rng.choice([0, 1, 2, 3, 8, 20])), i) for i in range(150)] + [("a b", 900), ("b a a", 800)]
    items = ["", "zz", "a b", *[made(n) for n in (1, 2, 4, 8, 16, 25) for _ in range(6)]]
    shelf, whole = M.Shelf(rows), 0
    for x in items:
        want = sorted((-M.token_set_ratio(x, t), i) for t, i in rows)
        score, known = {i: s for s, i in want}, shelf.known(x, 3)
        assert len(known) == 3 and all(score[i] <= s + 1e-9 for s, i in known)
        floor = -known[-1][0]
        if floor == 100:
            assert known == want[:3]
            whole += 1
        for f in (floor, -want[2][0], -want[1][0]):
            assert [b for b in shelf.best(x, 3, f) if -b[0] >= f] == [b for b in want[:3] if -b[0] >= f]
    assert 10 < whole < len(items)
    monkeypatch.setattr(M.Shelf, "_rest", None)
    assert [shelf.best("a b " + x, 1) for x in items] == [[min((-M.token_set_ratio("a b " + x, t), i) for t, i in rows)] for x in items]


def test_tables_of_references_are_bounded(monkeypatch):
    """Neither a large alphabet nor a long reference makes large tables; what is found is that of all pairs."""
    from scriptoria.operators import common

    rng, sizes = random.Random(12), []
    letters = [chr(0x4E00 + i) for i in range(3000)]
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(90)]
    long = "".join(rng.choice(letters) for _ in range(5000))
    titles = fuzzy.Titles([*texts, long + "x"], list(range(91)))
    refs = [long, *[t[2:] for t in texts[:40]]]

    def windows(of, some):
        table = windows_of(of, some)
        sizes.append(table.size)
        return table

    windows_of = common.windows
    monkeypatch.setattr(common, "windows", windows)
    got = titles.best_of(refs)
    assert [g[1] for g in got] == [90, *range(40)] and got[0][0] == 200.0 * 5000 / 10001
    assert sizes and max(sizes) <= fuzzy.HELD
