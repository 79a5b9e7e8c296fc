"""Attachment fields of other libraries' exports, resolved against a listing of the files there are."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECS = "array<struct<spec:string,candidates:array<string>>>"


def _cut(text: str, separator: str) -> list[str]:
    """Parts between separators that no backslash escapes; escapes stay in."""
    covered = re.sub(r"(?s)\\.", "\0\0", text)
    ends = [k for k, c in enumerate(covered) if c == separator] + [len(text)]
    return [text[a:b] for a, b in zip([0, *[k + 1 for k in ends[:-1]]], ends, strict=True)]


def candidates(spec: str) -> list[str]:
    """Paths that a spec may mean, the most specific first: a file URL, description:path:type in part or whole, a bare path;
    each also with its escaped colons, semicolons and backslashes read once and twice."""
    spec = spec.strip()
    if spec.lower().startswith("file:"):
        path = unquote(spec[5:].lstrip("/"))
        return [path if path[1:2] == ":" else f"/{path}"]
    parts = _cut(spec, ":")
    spans = {1: [], 2: [(1, 2), (0, 1)]}.get(len(parts), [(1, -1), (0, -1), (1, len(parts))])
    readings = [*[":".join(parts[a:b]) for a, b in spans], spec]
    found: dict[str, None] = {}
    for reading in readings:
        for _ in range(3):
            found.setdefault(reading.strip())
            reading = re.sub(r"\\([:;\\])", r"\1", reading)
    return [f for f in found if f]


def resolve(fields: DataFrame, files: DataFrame) -> DataFrame:
    """id, place, spec, path: of each spec the first reading that is a file, null where none is. A file that several specs of
    an item name stands once, at the first. fields: id, field, base (the folder of relative paths); files: path."""

    @F.pandas_udf(SPECS)
    def read(texts: pd.Series, bases: pd.Series) -> pd.Series:
        whole = lambda base, c: posixpath.normpath(posixpath.join(base or "/", c))
        specs = lambda t: [p.strip() for p in _cut(t or "", ";") if p.strip()]
        rows = [[{"spec": s, "candidates": [whole(b, c) for c in candidates(s)]} for s in specs(t)] for t, b in zip(texts, bases, strict=True)]
        return pd.Series(rows, dtype=object)

    specs = fields.select("id", F.posexplode(read("field", "base")).alias("at", "s")).select("id", (F.col("at") + 1).alias("place"), "s.*")
    listed = files.select("path", F.col("path").alias("found")).distinct()
    tried = specs.select("id", "place", "spec", F.posexplode("candidates").alias("rank", "path")).join(listed, "path", "left")
    best = tried.groupBy("id", "place", "spec").agg(F.min_by("found", F.when(F.col("found").isNotNull(), F.col("rank"))).alias("path"))
    there = best.filter("path is not null").groupBy("id", "path").agg(F.min(F.struct("place", "spec")).alias("s")).select("id", "s.place", "s.spec", "path")
    return there.unionByName(best.filter("path is null"))
