"""A library with its child tables: papers merged, papers deleted, import runs undone, and what hangs on papers follows.

Every operation is a function from tables to tables; ids of papers are looked up by joins, and no paper's
children are gathered in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.components import components


@dataclass(frozen=True)
class Shelf:
    """papers: id and fields; categories: paper_id, category_id, ...; values: paper_id, field_id, value; references: id,
    source_id, matched_id, ...; collections: id, deleted, ...; members: collection_id, paper_id, ..."""

    papers: DataFrame
    categories: DataFrame
    values: DataFrame
    references: DataFrame
    collections: DataFrame
    members: DataFrame


def duplicates(papers: DataFrame, least_title: int = 10) -> DataFrame:
    """dead, keep: papers (id, doi, title) linked by an equal DOI or an equal folded title of over ``least_title`` characters,
    chains included, with the least id of all as keeper. Null and empty DOIs and titles link nothing."""
    p = papers.select("id", F.lower(F.trim("doi")).alias("doi"), T.fold_title(F.col("title")).alias("title"))
    keys = p.filter("doi <> ''").select("id", F.concat(F.lit("d:"), "doi").alias("key")).unionByName(p.filter(F.length("title") > least_title).select("id", F.concat(F.lit("t:"), "title").alias("key")))
    first = keys.groupBy("key").agg(F.min("id").alias("a"))
    links = keys.join(first, "key").select("a", F.col("id").alias("b"))
    return components(links).filter("id <> root").select(F.col("id").alias("dead"), F.col("root").alias("keep"))


def repointed(children: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``children`` with dead papers in ``column`` replaced by their keepers."""
    m = mapping.select(F.col("dead").alias("_dead"), F.col("keep").alias("_keep"))
    return children.join(m, F.col(column) == F.col("_dead"), "left").withColumn(column, F.coalesce("_keep", column)).drop("_dead", "_keep")


def adopted(children: DataFrame, mapping: DataFrame, key: str, useful: Column | None = None) -> DataFrame:
    """``children`` (paper_id, ``key``, ...) re-pointed, one row a paper and key: the keeper's own, else the one of the least
    dead id. Rows that are not ``useful`` come last."""
    late = F.struct((~F.coalesce(useful, F.lit(False)) if useful is not None else F.lit(False)).alias("blank"), F.col("_dead").isNotNull().alias("late"), F.col("paper_id").alias("from"))
    m = mapping.select(F.col("dead").alias("_dead"), F.col("keep").alias("_keep"))
    rest = [c for c in children.columns if c not in ("paper_id", key)]
    own = children.join(m, F.col("paper_id") == F.col("_dead"), "left").withColumn("_late", late)
    one = own.groupBy(F.coalesce("_keep", "paper_id").alias("paper_id"), key).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), "_late").alias("r"))
    return one.select("paper_id", key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*children.columns)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def deleted(shelf: Shelf, ids: DataFrame) -> Shelf:
    """Without the papers ``ids`` (id) and what hangs on them: categories, values, their own references, memberships; a
    reference that was matched to one is unmatched. Ids that are not there change nothing."""
    gone = ids.select("id").distinct()
    matched = without(shelf.references, gone, "source_id").join(gone.select(F.col("id").alias("_gone")), F.col("matched_id") == F.col("_gone"), "left")
    return replace(
        shelf,
        papers=without(shelf.papers, gone, "id"),
        categories=without(shelf.categories, gone, "paper_id"),
        values=without(shelf.values, gone, "paper_id"),
        references=matched.withColumn("matched_id", F.when(F.col("_gone").isNull(), F.col("matched_id"))).drop("_gone"),
        members=without(shelf.members, gone, "paper_id"),
    )


def merged(shelf: Shelf, mapping: DataFrame) -> Shelf:
    """Dead papers (``mapping``: dead, keep; a keeper is never dead) are deleted, and their keepers take over categories,
    memberships, values of fields that they have empty, and the references matched to them."""
    moved = replace(
        shelf,
        categories=adopted(shelf.categories, mapping, "category_id"),
        values=adopted(shelf.values, mapping, "field_id", F.coalesce("value", F.lit("")) != ""),
        references=repointed(shelf.references, mapping, "matched_id"),
        members=adopted(shelf.members, mapping, "collection_id"),
    )
    return deleted(moved, mapping.select(F.col("dead").alias("id")))


def lost(before: Shelf, after: Shelf) -> DataFrame:
    """child, rows: rows of ``after`` that point to no paper; all 0 after a merge or an undo of a sound library."""
    ids = after.papers.select(F.col("id").alias("_id"))
    dangling = lambda d, c: d.filter(F.col(c).isNotNull()).join(ids, F.col(c) == F.col("_id"), "left_anti")
    checks = {"categories": (after.categories, "paper_id"), "values": (after.values, "paper_id"), "sources": (after.references, "source_id"), "matches": (after.references, "matched_id"), "members": (after.members, "paper_id")}
    out = None
    for name, (rows, column) in checks.items():
        one = dangling(rows, column).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("child"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def undone(shelf: Shelf, log: DataFrame, run: int) -> tuple[Shelf, DataFrame]:
    """The library as if ``run`` had not been, and the log without it.

    log: run_id, seq, op (paper or collection: created it; field: wrote one), id, field, before, after. A field goes back
    to what it was before the run's first write if it still holds the run's last one; who has written over it since
    is left alone. A later write that started from the run's value now starts from the one before it, so later runs can be
    undone in their turn. Papers that the run created go with all that hangs on them; its collections become
    tombstones, whose members stay as they are. What has been deleted since is skipped; an unknown run changes nothing.
    """
    own = log.filter(F.col("run_id") == run)
    writes = own.filter("op = 'field'").groupBy("id", "field").agg(F.min_by("before", "seq").alias("first"), F.max_by("after", "seq").alias("last"), F.max("seq").alias("until"))
    papers = shelf.papers
    fields = sorted(r["field"] for r in writes.select("field").distinct().collect())  # columns of papers: no more than it has
    if fields:
        wide = writes.groupBy("id").pivot("field", fields).agg(F.first(F.struct("first", "last"))).select(F.col("id").alias("_id"), *[F.col(f"`{f}`").alias(f"_{f}") for f in fields])
        papers = papers.join(wide, F.col("id") == F.col("_id"), "left")
        for f in fields:
            back = F.col(f"_{f}").isNotNull() & F.col(f).cast("string").eqNullSafe(F.col(f"_{f}.last"))
            papers = papers.withColumn(f, F.when(back, F.col(f"_{f}.first").cast(shelf.papers.schema[f].dataType)).otherwise(F.col(f)))
        papers = papers.select(*shelf.papers.columns)
    made = own.filter("op = 'collection'").select(F.col("id").alias("_made")).distinct()
    collections = shelf.collections.join(made, F.col("id") == F.col("_made"), "left").withColumn("deleted", F.col("deleted") | F.col("_made").isNotNull()).drop("_made")
    after = deleted(replace(shelf, papers=papers, collections=collections), own.filter("op = 'paper'").select("id"))
    # the next write of another run behind the run's last one
    later = log.filter((F.col("run_id") != run) & (F.col("op") == "field")).join(writes, ["id", "field"]).filter("seq > until")
    following = later.groupBy("id", "field").agg(F.min("seq").alias("seq"), F.first("first").alias("first"), F.first("last").alias("last")).withColumn("op", F.lit("field"))
    kept = log.filter(F.col("run_id") != run).join(following, ["op", "id", "field", "seq"], "left")
    before = F.when(F.col("last").isNotNull() & (F.col("before").eqNullSafe(F.col("last"))), F.col("first")).otherwise(F.col("before"))
    return after, kept.withColumn("before", before).select(*log.columns)
