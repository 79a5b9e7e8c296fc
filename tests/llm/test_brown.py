"""Classes of single words against plain counts, and against trying every class."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from scriptoria.llm import brown


def classes(model, counts):
    """Class by hash of every training word."""
    return {h: c for r in counts.collect() for h, c in zip(np.frombuffer(r["hashes"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint8).tolist(), strict=True)}


def bigrams(of, texts):
    g, before = np.zeros((brown.CLASSES, brown.CLASSES), np.int64), of[brown.word_hash(brown.END)]
    for t in texts:
        for w in brown.tokens(t):
            after = of[brown.word_hash(w)]
            g[before, after] += 1
            before = after
    return g


def test_rare_words_of_one_suffix_have_classes_of_their_own(spark):
    """Beyond the commonest words, nouns and verbs that share their endings stand in different places."""
    draw = random.Random(3)
    nouns, verbs = [f"noun{i}ing" for i in range(40)], [f"verb{i}ing" for i in range(40)]
    usual = [[f"{k}{i}{k}" for i in range(brown.TOP // 2)] for k in "nv"]
    texts = [f"the {draw.choice(usual[0])} a {draw.choice(usual[1])}" for _ in range(9000)]
    texts += [f"the {n} a {v}" for n, v in zip(nouns, verbs, strict=True)] * 2
    model, counts = brown.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    of = classes(model, counts)
    assert {brown.suffix_group(w.encode()) for w in nouns + verbs} == {brown.suffix_group(b"ing")}
    used = [{of[brown.word_hash(w.encode())] for w in ws} for ws in (nouns, verbs)]
    assert used[0].isdisjoint(used[1])
    assert max(model["likelihood"]) > model["likelihood"][0]
    g = bigrams(of, texts)
    assert brown.likelihood(g) == pytest.approx(max(model["likelihood"]), rel=1e-9)
    assert (g.sum(0) == model["size"]).all()


def test_best_classes_are_those_of_trying_all():
    draw = np.random.default_rng(5)
    n, k = 30, brown.CLASSES
    words = draw.integers(0, n, 3000)
    words = np.append(words, [7, 7, 7])
    cls = draw.integers(0, k, n).astype(np.uint8)

    def g(of):
        m = np.zeros((k, k), np.int64)
        np.add.at(m, (of[words[:-1]], of[words[1:]]), 1)
        return m

    sizes, codes, ns = [], [], []
    for w in range(n):
        seen: Counter = Counter()
        for a, b in zip(words[:-1], words[1:], strict=True):
            if a == b == w:
                seen[brown.ITSELF] += 1
            elif b == w:
                seen[brown.BEFORE + int(cls[a])] += 1
            elif a == w:
                seen[brown.AFTER + int(cls[b])] += 1
        sizes.append(len(seen))
        codes += sorted(seen)
        ns += [seen[c] for c in sorted(seen)]
    got = brown.best_classes(cls, np.array(sizes, np.uint8), np.array(codes, np.uint8), np.array(ns, np.int64), g(cls), block=4)
    for w in range(n):
        tried = []
        for b in range(k):
            of = cls.copy()
            of[w] = b
            tried.append(brown.likelihood(g(of)))
        assert tried[got[w]] == pytest.approx(max(tried), abs=1e-5)


@pytest.mark.parametrize("own", [0.0, 0.3])
def test_contexts_of_a_chunk_are_plain_counts_in_little_memory(own):
    """Counted in the space of the tokens, not of all codes of each word, and as one by one."""
    import tracemalloc

    draw = np.random.default_rng(7)
    seq = draw.integers(0, 50, 4000)
    seq[1:] = np.where(draw.random(3999) < own, seq[:-1], seq[1:])
    cls = draw.integers(0, brown.CLASSES, 50).astype(np.uint8)
    seen: Counter = Counter()
    for a, b in zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True):
        if a == b:
            seen[a, brown.ITSELF] += 1
        else:
            seen[b, brown.BEFORE + int(cls[a])] += 1
            seen[a, brown.AFTER + int(cls[b])] += 1
    word, code, n = brown.chunk_contexts(seq, cls)
    assert list(zip(word.tolist(), code.tolist(), n.tolist(), strict=True)) == [(*k, v) for k, v in sorted(seen.items())]
    key, total = brown.summed(np.tile(word * 129 + code, 3), np.concatenate([n, n, np.full(len(n), 1 << 31)]))
    assert (key == word * 129 + code).all() and (total == 2 * n + (1 << 31)).all()
    assert [len(x) for x in brown.summed(key[:0], n[:0])] == [len(x) for x in brown.chunk_contexts(np.zeros(1, np.int64), cls)[:2]] == [0, 0]
    tracemalloc.start()
    brown.chunk_contexts(np.arange(300_000), np.zeros(300_000, np.uint8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # 310 MB as a row of all codes for each word
