"""Merging references into a graph against a loop over them; levels of works to fetch."""

from __future__ import annotations

import hashlib
import random

import pytest

from scriptoria.operators.graph_merge import merge_references, prefetch_levels

SCHEMAS = {
    "nodes": "id string, type string, depth int, title string", "edges": "source string, target string", "refs": "ref_id long, source long, matched long, title string, doi string", "papers": "id long",
    "works": "id string, doi string", "links": "source string, target string, place int", "own_works": "id string", "own_dois": "doi string",
}


def plain(t: dict, depth: int, most: int):
    """One reference after the other."""
    papers, nodes = {p[0] for p in t["papers"]}, {n[0]: (n[1], n[2]) for n in t["nodes"]}
    edges = {e: "" for e in t["edges"]}
    held = lambda w, d: w in {x[0] for x in t["own_works"]} or bool(d) and d in {x[0] for x in t["own_dois"]}
    doi_of = {w: (d or "").lower() for w, d in t["works"]}
    work_of: dict = {}
    for w, d in t["works"]:
        if d:
            work_of[d.lower()] = min(w, work_of.get(d.lower(), w))
    out: dict = {}
    for s, g, place in sorted(t["links"], key=lambda x: (x[0], x[2])):
        if place < 30:
            out.setdefault(s, []).append(g)
    for _, s, m, _, _ in t["refs"]:
        for x in (s, m):
            if x in papers:
                nodes.setdefault(f"own_{x}", ("own", 0))
    groups: dict = {}
    for _, s, m, title, doi in sorted(t["refs"]):
        if m is not None:
            if f"own_{s}" in nodes and f"own_{m}" in nodes:
                edges.setdefault((f"own_{s}", f"own_{m}"), "pdf_ref")
        elif (title or "").strip():
            groups.setdefault(title.strip().lower(), [(doi or "").strip(), []])[1].append(s)
    wanted: dict = {}
    for key, (doi, sources) in groups.items():
        work = work_of.get(doi) if doi else None
        target = work or "ref_" + hashlib.sha256(key.encode()).hexdigest()[:12]
        there = target in nodes
        if there and not work:
            continue
        if not there:
            nodes[target] = ("own_ref" if work and held(work, doi) else "missing" if len(set(sources)) > 1 else "external", 1)
        for s in sources:
            if f"own_{s}" in nodes:
                edges.setdefault((f"own_{s}", target), "pdf_ref")
        for g in out.get(work, []) if not there else []:
            if g not in nodes:
                wanted[g] = 1
                edges.setdefault((target, g), "")
    wanted = {g: 1 for g in wanted if g not in nodes}
    for d in range(2, max(2, depth) + 1):
        after: dict = {}
        for w in [w for w in list(wanted)[:most] if w in doi_of]:
            nodes.setdefault(w, ("own_ref" if held(w, doi_of[w]) else f"depth{d}", d))
            for g in out.get(w, []) if d < depth else []:
                if g not in nodes:
                    after[g] = 1
                    edges.setdefault((w, g), "")
        wanted = after
    edges = {e: k for e, k in edges.items() if e[0] in nodes and e[1] in nodes}
    n_own = lambda i: len({s for s, g in edges if g == i and nodes[s][0] == "own"})
    return {i: (k, d, None if k in ("own", "own_ref") else n_own(i)) for i, (k, d) in nodes.items()}, edges


def tables(seed: int) -> dict:
    rng = random.Random(seed)
    works = [(f"W{i}", rng.choice([f"10.1/{i}", f"10.1/Q{i % 9}", "", None])) for i in range(120)]
    links = [(f"W{i}", f"W{rng.randrange(150)}", n) for i in range(120) for n in range(rng.choice([0, 3, 34]))]
    doi = lambda: rng.choice([f"10.1/{rng.randrange(130)}", f"10.1/q{rng.randrange(9)}", f" 10.1/Q{rng.randrange(9)}", "", None])
    refs = [(i, rng.randrange(1, 30), rng.choice([None, None, None, rng.randrange(1, 30)]), rng.choice([f" Title {rng.randrange(25)}", f"title {rng.randrange(25)}", "", None]), doi()) for i in rng.sample(range(1000), 90)]
    gone = "ref_" + hashlib.sha256(b"title 3").hexdigest()[:12]
    nodes = [(f"W{i}", rng.choice(["external", "own_ref"]), 1, "x") for i in range(0, 120, 7)] + [("own_2", "own", 0, "y"), ("own_77", "own", 0, None), (gone, "missing", 1, "z")]
    edges = [("own_2", "W7"), ("own_77", "W14"), ("own_2", "lost"), ("W7", "W14")]
    return {"nodes": nodes, "edges": edges, "refs": refs, "papers": [(i,) for i in range(1, 25)], "works": works, "links": links, "own_works": [(f"W{i}",) for i in range(0, 120, 11)], "own_dois": [(f"10.1/{i}",) for i in range(0, 120, 5)]}


def frames(spark, t: dict) -> list:
    return [spark.createDataFrame(t[name], schema) for name, schema in SCHEMAS.items()]


@pytest.mark.parametrize("seed, depth, most", [(1, 1, 50), (2, 3, 50), (3, 4, 5), (4, 2, 3)])
def test_against_a_loop(spark, seed, depth, most):
    t = tables(seed)
    nodes, edges = merge_references(*frames(spark, t), depth=depth, most=most)
    expected_nodes, expected_edges = plain(t, depth, most)
    assert {r["id"]: (r["type"], r["depth"], r["n_own"]) for r in nodes.collect()} == expected_nodes
    assert {(r["source"], r["target"]): r["kind"] for r in edges.collect()} == expected_edges


def test_empty_tables(spark):
    nodes, edges = merge_references(*frames(spark, {name: [] for name in SCHEMAS}))
    assert nodes.collect() == [] and edges.collect() == []


def test_levels(spark):
    rng = random.Random(6)
    links = [(i, rng.randrange(400), n) for i in range(300) for n in range(rng.choice([0, 2, 40]))]
    works, first = range(350), range(0, 30, 3)
    out: dict = {}
    for s, g, n in sorted(links, key=lambda x: (x[0], x[2])):
        if n < 30:
            out.setdefault(s, []).append(g)
    seen = {i: 1 for i in first}
    level = list(first)
    for d in (2, 3):
        after: dict = {}
        for s in sorted(level):
            for g in out.get(s, []):
                if g not in seen:
                    after[g] = 1
        level = [g for g in list(after)[:20] if g in works]
        seen |= {g: d for g in level}
    make = spark.createDataFrame
    found = prefetch_levels(make(links, "source long, target long, place int"), make([(i,) for i in first], "id long"), make([(i,) for i in works], "id long"), 3, 20)
    assert {r["id"]: r["depth"] for r in found.collect()} == seen
