"""Rows of texts taken apart in Python, with what one step holds bounded by characters and not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Characters of texts that are taken apart before what they gave goes on.
CHARACTERS = 1 << 20
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def exploded(rows: DataFrame, text: str, parts: Callable[[str | None], list[tuple]], kind: str, most: int = CHARACTERS) -> DataFrame:
    """The other columns and, for each tuple that ``parts`` gives of a text, a row. kind: "name int|long|string, ..."."""
    kept = [c for c in rows.columns if c != text]
    fields = [tuple(f.split()) for f in kind.split(", ")]
    schema = StructType([*[rows.schema[c] for c in kept], *StructType.fromDDL(kind).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            of: list[int] = []
            size = 0
            for i, t in enumerate(batch[text]):
                value = t.as_py()
                own = parts(value)
                made += own
                of += [i] * len(own)
                size += len(value or "")
                if size >= most or i + 1 == len(batch):
                    others = batch.select(kept).take(pa.array(of, pa.int64()))
                    columns = [pa.array([m[k] for m in made], KINDS[n]) for k, (_, n) in enumerate(fields)]
                    yield pa.RecordBatch.from_arrays([*others.columns, *columns], [*kept, *[f[0] for f in fields]])
                    made, of, size = [], [], 0

    return rows.mapInArrow(run, schema)
