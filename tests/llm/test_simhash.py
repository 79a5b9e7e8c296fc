"""Fingerprints and components against plain versions over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from scriptoria.llm import queries, simhash


def plain_print(text) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: list[int]) -> list[int]:
    """The least index that each is joined to."""
    of = list(range(len(prints)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist():
            x, y = root(i), root(j)
            of[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = sorted(docs)
    prints = [plain_print(docs[i]) for i in ids]
    least = plain_components(prints)
    want = [(i, f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, least, strict=True)]
    got = queries.op13_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == want
    assert any(i != c for i, _, c in want)


def test_slices_do_not_matter(monkeypatch):
    text = " ".join(f"W{i % 91} x{i % 7}" for i in range(500))
    whole = plain_print(text)
    for size in (3, 7, 100):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("length", [2, 3])
def test_every_near_pair_meets(length):
    """Of any two fingerprints within the limit one asks under a key of the other, whichever bits differ."""
    rng = random.Random(length)
    masks = [simhash.chain_masks(at, length)[-1] for at in range(5)]
    allowed = [set(simhash.turns(at, length).tolist()) for at in range(5)]
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(differ & m in a for m, a in zip(masks, allowed, strict=True))


def chain_of(rng, n, bits):
    x, out = rng.getrandbits(64), []
    for _ in range(n):
        for b in rng.sample(range(64), bits):
            x ^= 1 << b
        out.append(x)
    return out


def components(spark, prints, **kw):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), **kw).collect()]
    for a, b in links:
        assert (a ^ b).bit_count() > 0
    at = {p: i for i, p in enumerate(prints)}
    of = list(range(len(prints)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        x, y = root(at[a]), root(at[b])
        of[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def test_links_of_chains_and_dense_groups(spark, monkeypatch):
    """Long chains at distance 4 and a dense ball, with keys so small that they are split by the longer chain and by blocks."""
    rng = random.Random(13)
    prints = [p for _ in range(20) for p in chain_of(rng, 8, 4)] + [rng.getrandbits(64) for _ in range(300)]
    centre = rng.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)]
    prints += [centre ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randint(0, 6))) for _ in range(200)]
    prints = list(dict.fromkeys(prints))
    want = plain_components(prints)
    assert components(spark, prints) == want
    monkeypatch.setattr(simhash, "BLOCK", 32)
    assert components(spark, prints, hot=20) == want


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977} then{i % 13}" for i in range(60_000))
    docs = [(4, None), (3, ""), (None, " \t"), (1, "One two three four five"), (1, "one TWO three four  five"), (None, "alone here"), (9, "few"), (7, long), (8, long + " end")]
    d = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in docs], "doc_id long, text string, fp long, at string, key string, fingerprint long")
    got = simhash.near_components(d).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    found = sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=key)
    prints = [plain_print(t) for _, t in docs]
    groups = plain_components(prints)
    least = {g: min((i for (i, _), h in zip(docs, groups, strict=True) if h == g and i is not None), default=None) for g in set(groups)}
    assert found == sorted(((i, p, least[g]) for (i, _), p, g in zip(docs, prints, groups, strict=True)), key=key)


def test_empty_table(spark):
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
