"""CSV files that spreadsheets open as meant: byte order mark, CRLF, quotes where needed, and no cell that runs as a formula."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.fields import csv_cell

MARK = "\ufeff"


def quoted(cell: Column) -> Column:
    """In quotes if it holds a comma, a quote or a line end; null is empty."""
    c = F.coalesce(cell, F.lit(""))
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[quoted(csv_cell(F.col(f"`{c}`").cast("string"))) for c in columns])


def header(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in columns)


def with_custom_fields(papers: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    """``papers`` (id, ...) with a column for each custom field, in order of position, empty where a paper has no value.

    fields: field_id, name, position; values: paper_id, field_id, value. A name that is taken gets its field's id behind it."""
    known = fields.orderBy("position", "field_id").collect()  # columns of a sheet: as many as the reader has made
    taken, out = {c.lower() for c in papers.columns}, papers
    if not known:
        return out
    wide = values.groupBy(F.col("paper_id").alias("_paper")).pivot("field_id", [r["field_id"] for r in known]).agg(F.max("value"))
    out = out.join(wide, F.col("id") == F.col("_paper"), "left").drop("_paper")
    for r in known:
        name = r["name"] if r["name"].lower() not in taken else f"{r['name']} {r['field_id']}"
        taken.add(name.lower())
        out = out.withColumn(name, F.coalesce(F.col(f"`{r['field_id']}`"), F.lit(""))).drop(f"{r['field_id']}")
    return out


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Part files under ``path``, each a CSV file of its own with byte order mark and header, so that any of them opens alone.

    An empty table gives one file with the header; rows stay in the order and the partitions that they have.
    """
    head = header(columns)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([MARK + head])], ["value"])
        for b in batches:  # made anew, as Spark's own say that no value is null
            yield pa.RecordBatch.from_arrays([b["value"].cast(pa.string())], ["value"])

    lines = rows.select(line(columns).alias("value"))
    if not rows.limit(1).count():
        lines = rows.sparkSession.createDataFrame([(None,)], "value string").filter("value is not null").repartition(1)
    lines.mapInArrow(begin, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)
