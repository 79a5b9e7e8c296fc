"""A facade over the operators: what a plug-in of a library asks for, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.operators import catalogue, chunks, dedup, retrieval, search
from scriptoria.plans.base import keyed, papers
from scriptoria.session import table
from scriptoria.sources import bibliography


class Library:
    """Papers, chunks and vectors of one folder of tables. Writing methods return new rows and need ``write``."""

    def __init__(self, spark: SparkSession, folder: str, write: bool = False):
        self.spark, self.folder, self.write = spark, folder, write

    def papers(self) -> DataFrame:
        return keyed(papers(self.spark, self.folder)).withColumnRenamed("base", "key")

    def get_reference(self, key: str) -> DataFrame:
        return self.papers().filter(F.col("key") == key)

    def search_papers(self, q: str, limit: int = 20) -> DataFrame:
        return catalogue.lookup(self.papers(), q, limit=limit)

    def search_passages(self, text: str, k: int = 10, vectors: DataFrame | None = None, query: DataFrame | None = None) -> DataFrame:
        """Hybrid where vectors (id, vector) and a query vector are given, else lexical."""
        terms = retrieval.query_terms(self.spark.createDataFrame([(text,)], "text string"))
        return search.hybrid(table(self.spark, self.folder, "documents"), terms, vectors, query, k)

    def passages(self) -> DataFrame:
        return chunks.chunk(chunks.pages_of(table(self.spark, self.folder, "documents")))

    def duplicates(self) -> DataFrame:
        return dedup.doi_and_title_groups(self.papers())

    def statistics(self) -> DataFrame:
        return catalogue.statistics(self.papers())

    def bibtex(self) -> DataFrame:
        return bibliography.bibtex_text(self.papers())

    def create_by_doi(self, dois: list[str]) -> DataFrame:
        """doi, id of papers found, or null for those to be created."""
        if not self.write:
            raise PermissionError("this library was opened for reading")
        asked = self.spark.createDataFrame([(d,) for d in dois], "asked string").select(I.doi_key(F.col("asked")).alias("doi")).distinct()
        found = self.papers().groupBy(F.lower("doi").alias("doi")).agg(F.min("id").alias("id"))
        return asked.join(found, "doi", "left")


def embed(rows: DataFrame, how: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 50, tries: int = 3) -> DataFrame:
    """``rows`` with vector (array<float>) of an injected function on up to ``batch`` texts a call; a failing call is tried again."""
    import pandas as pd

    @F.pandas_udf("array<float>")
    def of(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for k in range(0, len(texts), batch):
            part = [t or "" for t in texts[k : k + batch]]
            for left in range(tries - 1, -1, -1):
                try:
                    out += how(part)
                    break
                except OSError:
                    if not left:
                        raise
        return pd.Series(out, dtype=object)

    return rows.withColumn("vector", of(F.col(text_col)))
