"""Running sums and numbers within groups that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column, 2 to this power, that one window covers.
BITS = 16


def running_sum(rows: DataFrame, name: str, value: Column, group: list[str], order: str, *then: str) -> DataFrame:
    """``rows`` with ``name`` (long): the sum of ``value`` over the rows of the group up to this one, by ``order`` (long), then ``then``.

    A group is cut at fixed values of ``order``, so a hot one is many windows; only a row a piece is summed up by group.
    Nulls in the group are a group; a null order is an order before all others, in one window; rows equal in all of these follow in any order.
    """
    piece = F.coalesce(F.shiftright(F.col(order).cast("long"), BITS), F.lit(-(1 << 62)))
    cut = rows.withColumn("_value", value.cast("long")).withColumn("_piece", piece)
    totals = cut.groupBy(*group, "_piece").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_piece").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = cut["_piece"] == totals["_p"]
    for i, g in enumerate(group):
        same = same & cut[g].eqNullSafe(totals[f"_g{i}"])
    inside = F.sum("_value").over(Window.partitionBy(*group, "_piece").orderBy(F.col(order).asc_nulls_first(), *then).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(totals, same).withColumn(name, F.col("_before") + inside).select(*rows.columns, name)
