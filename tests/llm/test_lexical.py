"""Ranked search against a plain scoring of every item and document."""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptoria.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=50):
    bags = [Counter(plain_terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for b in bags if b), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            n, score = sum(bag.values()), 0
            for t in set(plain_terms(text)) & set(bag):
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def rows(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: tuple((v is not None, v) for v in r))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from("aZ09 _-\t\n\x00\x7fÄ"), max_size=60))
def test_terms(text):
    assert [t.decode() for part in lexical.terms(text) for t in part] == plain_terms(text)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 50)
    text = "Ähre x1 " * 40 + "y" * 300 + " ende"
    parts = list(lexical.terms(text))
    assert len(parts) > 3 and [t.decode() for p in parts for t in p] == plain_terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 50) - 1)))
def test_radix_order(values):
    key = np.array(values, np.uint64)
    assert (lexical.radix_order(key) == np.argsort(key, kind="stable")).all()


def test_many_ties_small_batches_and_item_blocks(spark, monkeypatch):
    """Groups of copies tie; the best of 5 are cut through a tie; items in several blocks give the same."""
    docs = [(i, ["red blue green", "red red stone", "BLUE sky", "nothing else", "Red, blue; green-stone"][i % 5] + (" pad" * (i % 3))) for i in range(400)]
    items = [(1, "red stone"), (2, "blue BLUE sky"), (3, "absent"), (4, "pad"), (5, "red"), (5, "red"), (6, None), (None, "green")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items, 5)
    assert rows(lexical.search(d, q, top=5)) == want
    assert rows(lexical.search(d, q, top=5, block_terms=8)) == want


def test_odd_rows(spark):
    docs = [(1, None), (None, "alpha beta"), (None, "alpha beta"), (2, ""), (3, "alpha beta"), (3, "alpha beta"), (4, "ALPHA ünï " * 3000), (5, " \t\n?!")]
    items = [(1, "Alpha"), (2, "ÜNÏ"), (3, "ünï beta"), (4, "")]
    d = spark.createDataFrame([(*r, "x", 1, "s", 2) for r in docs], "doc_id long, text string, item string, score long, ids string, n long")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    assert rows(lexical.search(d, q)) == plain_search(docs, items)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(d.limit(0), q).collect() == []
    assert lexical.search(d, q.limit(0)).collect() == []
    assert rows(lexical.search(d, q)) == plain_search([(1, "a")], [(1, "a")])
