"""The piece lattice: whole words whatever their length, and draws that follow the enumerated segmentations."""

from __future__ import annotations

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from scriptoria.llm import pieces, queries


@pytest.fixture(scope="module")
def known():
    return pieces.Lattices(pieces.Pieces(queries.tokenizer_path(), 1.0))


def segmentations(text: str, weight: dict[str, float]) -> list[tuple[tuple[str, ...], float]]:
    if not text:
        return [((), 1.0)]
    return [((text[:k], *rest), weight[text[:k]] * w) for k in range(1, len(text) + 1) if text[:k] in weight for rest, w in segmentations(text[k:], weight)]


def test_draws_follow_all_segmentations(known):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    names = [sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size())]
    first = min(i for i in range(len(names)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    weight = {t: 1.0 / (i - first + 2.0) for i, t in enumerate(names) if i >= first}
    word, n = " these", 40_000
    every = segmentations(word, weight)
    total = sum(w for _, w in every)
    seeds = np.array([pieces.seed_of(str(k), 0) for k in range(n)], np.uint64)
    ids, sizes = known.sample([word] * n, seeds)
    drawn = Counter(tuple(names[i] for i in part) for part in np.split(ids, np.cumsum(sizes)[:-1]))
    assert set(drawn) <= {s for s, _ in every} and len(drawn) >= 3
    for cut, w in every:
        p = w / total
        assert drawn[cut] / n == pytest.approx(p, abs=5 * math.sqrt(p * (1 - p) / n) + 1e-6)


def test_a_long_word_is_one_lattice(known):
    word = "internationalisation" * 400 + "\U00010348" + "z" * 3000
    text = f"{word} and {word}   \n end"
    (ids, sizes), *rest = list(pieces.encode_texts(["k"], [text], known, 0))
    assert not rest and pieces.decode_texts(ids, sizes, known.pieces) == [text]
    # a piece that crosses the 32nd character of the word is drawn under some key
    short = "x" * 30 + "there"
    crossing = 0
    for key in range(200):
        (i, n), *_ = list(pieces.encode_texts([str(key)], [short], known, 0))
        ends = np.cumsum([len(known.pieces.bytes_of[p]) for p in i])
        crossing += 33 not in ends  # the first byte is the space in front
    assert crossing


def test_a_worker_that_is_done_keeps_little_memory():
    """Workers that waited after the stage kept some 390 MB each, which an executor lacked in the stages after it."""
    code = """
import random, re
import pyarrow as pa
from scriptoria.llm import pieces
from scriptoria.llm.queries import tokenizer_path
held = lambda: sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
rng = random.Random(3)
def batch(k):
    texts = [" ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 11))) for _ in range(150)) for _ in range(1500)]
    return pa.array([str(i) for i in range(len(texts))]), pa.array(texts)
pieces.lattices(tokenizer_path(), 1.0)
before, most = held(), 0
for out in pieces._checked(map(batch, range(2)), tokenizer_path(), 1.0, 0):
    most = max(most, held())
out = None
print(before, most, held())
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2], env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])})
    before, most, after = map(float, run.stdout.split())
    assert most > before + 150 and after < before + 60, (before, most, after)
