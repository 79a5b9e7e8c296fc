"""Connected components of links between rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.session import checkpoint_folder


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id of its component) of every id in ``links`` (a, b). Null ends and links of an id to itself add nothing.

    Every round first hangs the larger neighbours of an id on its least neighbour, then its smaller ones; links are
    aggregated and joined, never collected, so an id with very many links is no problem. Rounds grow with the
    logarithm of the longest chain.
    """
    checkpoint_folder(links.sparkSession)
    ends = lambda d: d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = ends(links.filter("a is not null and b is not null")).checkpoint()
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
        wide = ends(both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b")))
        low = wide.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), "low")
        down = wide.join(low, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = ends(down.unionByName(low.select(F.col("of").alias("a"), F.col("low").alias("b")))).checkpoint()
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        seen = now
