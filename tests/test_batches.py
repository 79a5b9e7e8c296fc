"""Texts taken apart in steps bounded by characters."""

from __future__ import annotations

from scriptoria.operators import batches
from scriptoria.operators.chunks import chunk
from scriptoria.operators.references import pieces
from scriptoria.sources import rdf


def test_exploded_in_steps_of_any_size(spark):
    """What a step gives on is bounded by characters: small steps and one large one give the same rows."""
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "d"), (None, "e f")]
    rows = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    words = lambda t: [(k, w or None) for k, w in enumerate((t or "").split(" "))]
    small, large = (sorted(map(tuple, batches.exploded(rows, "text", words, "k int, word string", n).collect()), key=str) for n in (1, 1000))
    assert small == large == sorted(((i, *w) for i, t in texts for w in words(t)), key=str)
    assert batches.exploded(rows, "text", lambda t: [], "k int", 1).collect() == []


def test_texts_are_taken_apart_by_that_step(spark):
    """No array of a whole batch's parts: pieces, chunks and elements come from mapInArrow."""
    d = spark.createDataFrame([(1, 1, "x")], "paper_id long, page int, text string")
    for made in (pieces(d, "paper_id", "text"), chunk(d)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Seq rdf:about="#a"> x </rdf:Seq></rdf:RDF>'
    files = spark.createDataFrame([("f", xml), ("g", "<broken"), ("h", None)], "file string, text string")
    assert [tuple(r) for r in rdf.elements(files).collect()] == [("f", 1, 0, 1, "", "Seq", "#a", "", "x", "x")]
