"""Overlapping text chunks, breaking at separators. Offsets depend on the break before, so one text is cut in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.batches import exploded

#: After these a chunk may end.
SEPARATORS = ("\n\n", ".\n", ". ", "! ", "? ")
SIZE, OVERLAP, LEAST = 800, 150, 50


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of at most ``size`` characters that end behind the last separator in their second half, or else where they are full."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            found = -1
            for s in SEPARATORS:
                at = text.rfind(s, start + size // 2, end)
                found = at + len(s) if at > found else found
            end = found if found > start else end
        part = text[start:end].strip()
        if len(part) > least:
            out.append(part)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """paper_id, chunk_index (running over the pages of a paper), page, chunk_text, token_count. pages: paper_id, page, text."""

    from pyspark.sql import Window

    rows = exploded(pages.select("paper_id", "page", "text"), "text", lambda t: list(enumerate(cut(t or "", size, overlap, least))), "k int, chunk_text string")
    index = F.row_number().over(Window.partitionBy("paper_id").orderBy("page", "k")) - 1
    tokens = F.size(F.filter(F.split("chunk_text", r"\s+"), lambda w: w != ""))
    return rows.select("paper_id", index.alias("chunk_index"), "page", "chunk_text", tokens.alias("token_count"))


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """paper_id, page (from 1), text of the pages of form-feed separated texts that hold a visible character."""
    p = docs.select(F.col(id_col).alias("paper_id"), F.posexplode(F.split(text_col, "\f")).alias("page", "text"))
    return p.filter(F.trim("text") != "").withColumn("page", F.col("page") + 1)


def missing(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages of papers that have no chunk yet: an index run does the rest only."""
    return pages.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti")
