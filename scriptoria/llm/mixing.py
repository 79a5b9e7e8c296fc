"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Training time t runs from 0 to 1. Source i draws words at the rate ``target_i * (1 + tilt_i * (2t - 1))``:
its schedule integrates to its target, a positive tilt puts it late and a negative one early. Documents of
a source queue in an order fixed by a digest of their id, pass after pass; the word at which a document
stands in that queue is a cumulative demand, and inverting the source's cumulative schedule

    D(t) / target = t + tilt * (t*t - t)

gives the position at which it is trained. Range-sorting by position makes the training order.

A hot source is not one task: its queue is cut into digest ranges whose totals are summed
first, so that running sums are taken within (source, range) and offset by the ranges before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.text import n_words

#: Weights dealt to sources in order, the share of all words to draw, the most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2.0
#: Tilts dealt to sources in order: early, even, late.
TILTS = (-0.5, 0.0, 0.5)
#: Least digest ranges of a source's queue, as hexadecimal digits of the digest: 16 ** 3; rows that carry texts along make
#: more of them, of about ``RANGE_BYTES`` if all are of one source.
DIGITS, RANGE_BYTES = 3, 64 << 20


def _dealt(index: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """``sizes`` (source, source_size) with target and tilt: one row a source, so windows here see sources only.

    Water-filling in closed form. Sources by cap/weight ascending are capped first; the level for the k
    first capped is (wanted - their caps) / (weights of the others), and the right k is the first whose
    level is at most the next source's cap/weight. Resharing the excess by weight ends at the same point.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("i", F.row_number().over(order) - 1)
    s = s.withColumns({"weight": _dealt(F.col("i"), weights), "tilt": _dealt(F.col("i"), TILTS), "cap": F.col("source_size") * F.lit(float(passes))})
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    s = s.withColumn("level", level)
    right = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(every)["level"]
    return s.withColumn("right", right).select("source", "source_size", "tilt", F.least(F.col("cap"), F.coalesce(F.col("right"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def position(demand: Column, tilt: Column) -> Column:
    """t in [0, 1] with t + tilt * (t*t - t) = demand."""
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * demand)
    return F.when(tilt == 0, demand).otherwise((root - (1 - tilt)) / (2 * tilt))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, passes: float = PASSES, digest: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies (long), taken (long), positions.

    ``digest`` (hexadecimal) fixes the queue instead of the id's, for tables whose ids are null or repeated
    often; the columns of ``carry`` come along in a struct ``row``, so that no join on ids is needed.

    Pass p (0, 1) takes a document whole if the middle of its words stands within the target, so a source
    is off by half a document at most. Null sources are one source, the last; null texts have size 0 and
    null ids a digest of their own; a document of size 0 is taken in the passes that its place falls in.
    Repeated rows are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        (F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) if digest is None else digest).alias("digest"),
        *([F.struct(*carry).alias("row")] if carry else []),
    )
    digits = DIGITS
    if carry:
        total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
        digits = max(DIGITS, round(math.log(max(total / RANGE_BYTES, 1), 16)))
    # md5 ties only for repeated ids; size settles those, and equal rows are interchangeable
    d = d.withColumns({"bucket": F.substring("digest", 1, digits), "no_source": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    keys = ["no_source", "source"]
    buckets = d.drop("row").groupBy(*keys, "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy(*keys).agg(F.sum("bucket_size").alias("source_size"))
    named = sizes.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size")
    t = targets(named, weights, share, passes).select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "tilt", "target")
    ahead = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(t, keys).drop("bucket_size")
    within = Window.partitionBy(*keys, "bucket").orderBy("digest", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, [*keys, "bucket"])
    middle = F.col("offset") + F.col("start") + F.col("size") / 2
    middles = F.transform(F.sequence(F.lit(0), F.lit(int(passes))), lambda p: p * F.col("source_size") + middle)
    taken = F.filter(middles, lambda m: (m <= F.col("target")) & (F.col("target") > 0))
    d = d.withColumn("taken_at", F.slice(taken, 1, int(passes)))
    return d.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.size("taken_at").cast("long").alias("copies"), (F.size("taken_at") * F.col("size")).cast("long").alias("taken"),
        F.transform("taken_at", lambda m: position(m / F.col("target"), F.col("tilt"))).alias("positions"),
        *(["row"] if carry else []),
    )


def curriculum(plan: DataFrame) -> DataFrame:
    """The training order: a row for each time a document is trained, range-sorted by position."""
    return plan.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions").orderBy("position", "doc_id", "epoch")
