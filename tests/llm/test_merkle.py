"""The manifest against trees built one by one in plain Python."""

from __future__ import annotations

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from scriptoria.llm import merkle, queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_path(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def plain_query(rows: list[tuple]) -> list[tuple]:
    """rows (doc_id, source, lang, n_chars, text) as the registered query has them."""
    nulls_first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    made = [(r, plain_leaf(*r), plain_leaf(*r[:4], r[4] and r[4].translate(LOWER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else None) for r in rows]
    sources = sorted({r[1] for r in rows}, key=nulls_first)
    own = {s: sorted((m for m in made if m[0][1] == s), key=lambda m: (nulls_first(m[0][0]), m[1])) for s in sources}
    trees = {s: plain_tree([m[1] for m in own[s]]) for s in sources}
    top = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (r, leaf, tampered) in enumerate(own[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            folded = tampered or leaf
            for at, others in path:
                folded = sha("".join(others[:at]) + folded + "".join(others[at:]))
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, sha("".join("".join(o) for _, o in path)), folded, folded == root))
    return out


def test_paths_of_a_block():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 300, 4095, 4096):
        leaves = [sha(str(i)) for i in range(n)]
        tree = plain_tree(leaves)
        paths = list(merkle.successive_paths(leaves, merkle.height(n)))
        assert len(paths) == n
        for i in range(0, n, max(1, n // 97)):
            assert paths[i] == ([at for at, _ in plain_path(tree, i)], ["".join(o) for _, o in plain_path(tree, i)])


def test_growth_keeps_few_nodes():
    """Of a block of three heights no list holds more than a run."""
    into: list[str] = []
    steps = sum(1 for _ in merkle._growing([sha(str(i)) for i in range(4096)], 2, 0, into))
    assert len(into) == 16 and steps == 256 + 16  # at most a digest a leaf, so a run is complete in time


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.COLUMNS).collect()]
    got = queries.op12_merkle(spark, sf_dir).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(plain_query(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_group_of_several_blocks(spark):
    """A hot group of more than a block, and than two, beside small ones; ids in no order."""
    ids = list(range(9000))
    random.Random(5).shuffle(ids)
    rows = [(i, "hot" if i % 9 else f"s{i % 45}", None, i, f"Text {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.manifest(docs)
    got = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("positions"), F.col("siblings"))).select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256), "folded")
    want = [(*w[:5], w[3]) for w in plain_query(rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_odd_rows(spark):
    """Nulls in any column, ties in the id, equal rows, empty text, other columns of the names in use."""
    rows = [(1, "a", "en", 3, "One"), (1, "a", "en", 3, "One"), (1, "a", "en", 3, "Two"), (None, "a", None, None, None), (None, None, None, None, ""), (7, None, "en", 0, None), (9, "b", "en", 1, "ü" * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, k string, rank long, row string, positions string, pack long")
    leaves = docs.withColumn("leaf", merkle.leaf(*[F.col(c) for c in merkle.COLUMNS]))
    got = merkle.prove(leaves)
    assert {"k", "rank", "row", "pack"} <= set(got.columns)
    found = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256), merkle.folded(F.col("leaf"), F.col("positions"), F.col("siblings"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted([(*w[:5], w[3]) for w in plain_query(rows)], key=key)


@pytest.mark.parametrize("make", [lambda d: merkle.manifest(d)])
def test_empty_table(spark, make):
    docs = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert make(docs).collect() == []
