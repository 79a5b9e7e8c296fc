"""Merkle manifest of a table: a digest a row, a tree a group, a tree over the groups, and every row's proof.

Leaves of a group stand in the order of a column. While a group has several nodes, every 16 consecutive ones (the
last run may be shorter, even one) become the digest of their hexadecimal texts. What remains is the group's
subroot; subroots in order of their group make a further tree in the same way, whose top is the root.

Ranks come from a range partitioning whose parts are counted, so a hot group is many parts. Trees are built upwards
by grouping, 4,096 nodes of one level (an aligned block, three levels high) to one of the next; the upper levels are
tables too. Proofs are made downwards, by fractal traversal: a task walks through the leaves of an aligned block
and keeps, for each height, the existing run of 16 nodes that the current leaf's ancestor belongs to and the desired
run that follows, which grows by at most one digest a step and is complete when the walk enters it. Each leaf's
path is read off the existing runs; the path of its block, found in the same way in the tree above, is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from scriptoria.llm.text import shared_folder

RUN, HEIGHT = 16, 3
#: Leaves of an aligned block.
BLOCK = RUN**HEIGHT
#: Rows of one Arrow batch that a task returns.
BATCH = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and the value as text: no two sequences of fields have one concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(nodes: Sequence[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _growing(leaves: Sequence[str], h: int, run: int, into: list[str]) -> Iterator[None]:
    """Appends the nodes of a run of height ``h`` to ``into``; yields after each digest."""
    first, last = run * RUN ** (h + 1), min((run + 1) * RUN ** (h + 1), len(leaves))
    tail: list[list[str]] = [[] for _ in range(h)] + [into]
    for i in range(first, last):
        tail[0].append(leaves[i])
        for g in range(h):
            if len(tail[g]) < RUN and (i + 1 < last or not tail[g]):
                break
            tail[g + 1].append(digest(tail[g]))
            tail[g].clear()
            yield


def successive_paths(leaves: Sequence[str], levels: int) -> Iterator[tuple[list[int], list[str]]]:
    """Leaf by leaf the path to the top of its block: its place in the run of each height, and the others of that run,
    joined. Nodes held at a time: two runs a height and what is unfinished of the growing ones."""
    existing: list[list[str]] = [[] for _ in range(levels)]
    desired: list[list[str]] = [[] for _ in range(levels)]
    for h in range(levels):
        for _ in _growing(leaves, h, 0, existing[h]):
            pass
    growth = [_growing(leaves, h, 1, desired[h]) for h in range(levels)]
    places, others = [-1] * levels, [""] * levels
    for i in range(len(leaves)):
        for h in range(levels):
            step = RUN**h
            if i and i % (step * RUN) == 0:
                for _ in growth[h]:  # a run of the lowest height grows without a digest
                    pass
                existing[h], desired[h], places[h] = desired[h], [], -1
                growth[h] = _growing(leaves, h, i // (step * RUN) + 1, desired[h])
            place = i // step % RUN
            if place != places[h]:
                run = existing[h]
                places[h], others[h] = place, "".join(run[:place] + run[place + 1 :])
        yield list(places), list(others)
        for g in growth:
            next(g, None)


def folded(start: Column, positions: Column, siblings: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    steps = F.arrays_zip(positions.alias("at"), siblings.alias("others"))
    up = lambda own, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), s["at"] * 64), own, F.substring(s["others"], s["at"] * 64 + 1, F.length(s["others"]))), 256)
    return F.aggregate(steps, start, up)


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (k, g, o, digest, seq, ...) with rank in k and n, the size of k."""
    placed = rows.repartitionByRange("g", "o", "digest", "seq").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("c"))
    offsets = counts.select("k", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    within = Window.partitionBy("k", "part").orderBy("g", "o", "digest", "seq")
    return placed.withColumn("own", F.row_number().over(within) - 1).join(offsets, ["k", "part"]).withColumn("rank", F.col("ahead") + F.col("own"))


def _next(nodes: DataFrame) -> DataFrame:
    """What aligned blocks of ``nodes`` (k, rank, n, digest) fold to; a group that has one node keeps it."""
    for _ in range(HEIGHT):
        run = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]), "")
        up = nodes.groupBy("k", "n", F.expr(f"rank div {RUN}").alias("above")).agg(run.alias("run"))
        nodes = up.select("k", F.col("above").alias("rank"), F.ceil(F.col("n") / RUN).alias("n"), F.when(F.col("n") > 1, F.sha2("run", 256)).otherwise(F.col("run")).alias("digest"))
    return nodes.withColumn("row", F.struct(F.lit(0).alias("none")))


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes, each a block's height above the one before, and the top of each group."""
    found = []
    while True:
        largest = nodes.agg(F.max("n")).first()[0] or 0
        found.append(nodes)
        nodes = _next(nodes).checkpoint()
        if largest <= BLOCK:
            return found, nodes.select("k", "digest")


def _walked(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with positions, siblings, subroot and root; ``above`` (k, block, positions, siblings, subroot, root) holds those of their blocks."""
    packs = max(1, nodes.count() // BLOCK)
    pack = F.pmod(F.xxhash64("k", "block"), F.lit(packs)).alias("pack")
    own = nodes.select("k", "rank", "n", "digest", "row").withColumn("block", F.expr(f"rank div {BLOCK}"))
    schema = StructType(
        [StructField("k", StringType()), StructField("rank", LongType()), StructField("digest", StringType()), nodes.schema["row"]]
        + [StructField("positions", ArrayType(IntegerType())), StructField("siblings", ArrayType(StringType())), StructField("subroot", StringType()), StructField("root", StringType())]
    )

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("k", "ascending"), ("rank", "ascending")])
        k, block, n = (left[c].to_pylist() for c in ("k", "block", "n"))
        digests = left["digest"].to_pylist()
        upper = {(r["of"], r["at"]): r for r in right.to_pylist()}
        out, begin = [], 0
        fixed = left.select(["k", "rank", "digest", "row"])
        while begin < len(k):
            end = begin
            while end < len(k) and k[end] == k[begin] and block[end] == block[begin]:
                end += 1
            up = upper[k[begin], block[begin]]
            paths = successive_paths(digests[begin:end], min(height(n[begin]), HEIGHT))
            for at in range(begin, end, BATCH):
                some = [next(paths) for _ in range(at, min(at + BATCH, end))]
                part = fixed.slice(at, len(some))
                part = part.append_column("positions", pa.array([p + up["positions"] for p, _ in some], pa.list_(pa.int32())))
                part = part.append_column("siblings", pa.array([s + up["siblings"] for _, s in some], pa.list_(pa.string())))
                for c in ("subroot", "root"):
                    part = part.append_column(c, pa.array([up[c]] * len(some), pa.string()))
                out.append(part)
            begin = end
        return pa.concat_tables(out) if out else _empty(fixed)

    def _empty(fixed: pa.Table) -> pa.Table:
        part = fixed.slice(0, 0).append_column("positions", pa.array([], pa.list_(pa.int32()))).append_column("siblings", pa.array([], pa.list_(pa.string())))
        return part.append_column("subroot", pa.array([], pa.string())).append_column("root", pa.array([], pa.string()))

    left = own.withColumn("pack", pack).groupBy("pack")
    # other names, as both sides may stem from one table
    right = above.select(pack.alias("pack_"), F.col("k").alias("of"), F.col("block").alias("at"), "positions", "siblings", "subroot", "root")
    return left.cogroup(right.groupBy("pack_")).applyInArrow(walk, schema)


def _down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Proofs of the lowest level, from the paths of the tops."""
    for i, nodes in reversed(list(enumerate(levels))):
        above = _walked(nodes, above)
        if i:
            above = above.select("k", F.col("rank").alias("block"), "positions", "siblings", "subroot", "root").checkpoint()
    return above


def prove(leaves: DataFrame, group_col: str = "source", order_col: str = "doc_id", leaf_col: str = "leaf") -> DataFrame:
    """``leaves`` with positions array<int>, siblings array<string>, subroot, root: every row's proof.

    Entry h of positions says how many nodes of the run of height h stand before the row's own, entry h of siblings
    holds the run's other nodes, joined; first within the group, then over the groups. ``folded`` leads from them to
    the root. Groups and leaves stand in ascending order, null first; leaves that tie in the order column stand
    by their digest, and those that tie in it too are interchangeable. Nulls may stand in any column but the leaf.
    All columns pass, whatever their names, as long as they can be ordered by; columns of the four new names are
    replaced. An empty table gives no rows.
    """
    spark = leaves.sparkSession
    shared_folder(spark)
    new = ["positions", "siblings", "subroot", "root"]
    kept = [c for c in leaves.columns if c.lower() not in new]
    named = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = leaves.select(named, field(F.col(group_col)).alias("k"), F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(leaf_col).alias("digest"))
    rows = rows.withColumn("seq", F.monotonically_increasing_id()).checkpoint()
    levels, tops = _levels(_ranked(rows).select("k", "rank", "n", "digest", "row").checkpoint())
    # the tree over the groups is one group itself
    groups = rows.select("k", "g").distinct().join(tops, "k")
    nodes = groups.select(F.struct("k").alias("row"), F.lit("").alias("k"), "g", F.lit(0).alias("o"), "digest", F.lit(0).alias("seq"))
    upper, root = _levels(_ranked(nodes).select("k", "rank", "n", "digest", "row").checkpoint())
    none = [F.lit(0).cast("long").alias("block"), F.array().cast("array<int>").alias("positions"), F.array().cast("array<string>").alias("siblings"), F.lit("").alias("subroot")]
    of_group = _down(upper, root.select("k", *none, F.col("digest").alias("root")))
    above = of_group.select(F.col("row.k").alias("k"), F.lit(0).cast("long").alias("block"), "positions", "siblings", F.col("digest").alias("subroot"), "root").checkpoint()
    return _down(levels, above).select("row.*", *new)


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group_col: str = "source", order_col: str = "doc_id") -> DataFrame:
    """``docs`` as (order column, group column, leaf, positions, siblings, subroot, root): a proof of each row's ``columns``.

    Nulls, ties, repeated rows and empty tables as in ``prove``; a null in a column differs from an empty text.
    """
    made = leaf(*[F.col(f"`{c}`") for c in columns])
    return prove(docs.select(F.col(order_col), F.col(group_col), made.alias("leaf")), group_col, order_col)
