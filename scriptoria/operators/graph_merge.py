"""References read off papers, merged into a citation graph: matched ones as edges, others as works or nodes of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.graph import _node
from scriptoria.session import checkpoint_folder

#: Works fetched for a level below the first, and references of a work that are followed.
LEVEL, FOLLOWED = 50, 30


def own(paper: str) -> Column:
    return F.concat(F.lit("own_"), F.col(paper).cast("string"))


def placed(links: DataFrame, followed: int = FOLLOWED) -> DataFrame:
    """source, target, place: of each work's references in their order the first ``followed``. links: source, target, place (from 0)."""
    return links.filter((F.col("place") < followed) & F.col("target").isNotNull()).select("source", "target", "place")


def prefetch_levels(links: DataFrame, first: DataFrame, works: DataFrame, depth: int, most: int = LEVEL) -> DataFrame:
    """id, depth of the works to fetch for a graph: ``first`` (id, distinct) at depth 1, then level by level what the last level's
    works refer to and no level has, at most ``most`` a level, in the order of those works' ids and of their references.

    works: id, those that exist; only these are followed. A level below the first is at most ``most`` rows.
    """
    checkpoint_folder(links.sparkSession)
    p, exist = placed(links), works.select("id").distinct()
    seen = level = first.select("id").distinct().join(exist, "id", "left_semi").withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        after = p.join(level.select(F.col("id").alias("source")), "source").join(seen.select(F.col("id").alias("target")), "target", "left_anti")
        wanted = after.groupBy("target").agg(F.min(F.struct("source", "place")).alias("o")).orderBy("o", "target").limit(most)
        level = exist.join(F.broadcast(wanted.select(F.col("target").alias("id"))), "id", "left_semi").withColumn("depth", F.lit(d)).checkpoint()
        seen = seen.unionByName(level)
    return seen


def merge_references(
    nodes: DataFrame, edges: DataFrame, refs: DataFrame, papers: DataFrame, works: DataFrame, links: DataFrame, own_works: DataFrame, own_dois: DataFrame, depth: int = 1, most: int = LEVEL
) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, depth, n_own) and edges (source, target, kind) of a graph with what papers' references add.

    nodes: id, type, depth; edges: source, target; refs: ref_id (unique), source, matched (null: no paper), title, doi; papers, own_works:
    id; own_dois: doi; works: id, doi; links: source, target, place (from 0) of works.

    Papers that refer or are referred to are nodes own_ID of type own. A matched reference is an edge between two such. The others are grouped
    by folded title, in the order of the first reference; blank titles are left out. A group whose DOI (the first reference's) is a
    work's is that work; else a node of its title's digest, and none if that node is there already. A new work is own_ref if the library
    has it, else missing if two papers or more refer to it, else external; so are titles. Works that new works refer to, and that are no
    nodes by then, follow by levels down to the greater of 2 and ``depth``, ``most`` a level in the order met: own_ref or
    depthN. Edges that a level beyond ``depth`` would add, and edges to what is no node in the end, are left out. kind is
    pdf_ref for what references add, '' else; n_own counts the papers that refer to a node, null for own and own_ref.
    Everything before the levels is joins and grouping, whatever a title's or a work's number of references; a level is ``most`` rows.
    """
    checkpoint_folder(nodes.sparkSession)
    there, p = papers.select("id").distinct(), placed(links)
    cited = refs.select(F.col("source").alias("id")).unionByName(refs.select(F.col("matched").alias("id"))).distinct().join(there, "id", "left_semi")
    before = nodes.select("id", "type", F.col("depth").cast("int").alias("depth"))
    base = before.unionByName(cited.select(own("id").alias("id")).join(before.select("id"), "id", "left_anti").select("id", F.lit("own").alias("type"), F.lit(0).alias("depth"))).checkpoint()
    known = base.select("id")
    matched = refs.filter("matched is not null").select(own("source").alias("source"), own("matched").alias("target"))
    matched = matched.join(known.withColumnRenamed("id", "target"), "target", "left_semi")

    doi = F.trim(F.coalesce("doi", F.lit("")))
    open_refs = refs.filter("matched is null").withColumn("key", F.lower(F.trim("title"))).filter("key <> ''")
    groups = open_refs.groupBy("key").agg(F.min("ref_id").alias("first"), F.min_by(doi, "ref_id").alias("doi"), (F.min("source") < F.max("source")).alias("shared"))
    named = works.select(F.lower(F.trim("doi")).alias("doi"), "id").filter("doi <> ''").groupBy("doi").agg(F.min("id").alias("work"))
    groups = groups.join(named, "doi", "left").withColumn("target", F.coalesce("work", _node(F.col("key"))))
    groups = groups.join(known.select(F.col("id").alias("target"), F.lit(True).alias("old")), "target", "left").filter("work is not null or old is null").checkpoint()
    library = F.col("is_own") | F.col("has_doi")
    in_library = lambda d: d.join(own_works.select("id", F.lit(True).alias("is_own")).distinct(), "id", "left").join(own_dois.select(F.lower(F.trim("doi")).alias("doi"), F.lit(True).alias("has_doi")).filter("doi <> ''").distinct(), "doi", "left")
    fresh = groups.filter("old is null").groupBy("target").agg(F.min_by(F.struct("first", "doi", "shared", "work"), "first").alias("g")).select(F.col("target").alias("id"), "g.*")
    fresh = in_library(fresh).withColumn("type", F.when(F.col("work").isNotNull() & F.coalesce(library, F.lit(False)), "own_ref").when(F.col("shared"), "missing").otherwise("external"))
    every = base.unionByName(fresh.select("id", "type", F.lit(1).alias("depth")))
    read = open_refs.select("key", own("source").alias("source")).join(groups.select("key", "target"), "key").select("source", "target")

    met = fresh.filter("work is not null").select(F.col("id").alias("source"), "first")
    down = p.join(met, "source").join(known.withColumnRenamed("id", "target"), "target", "left_anti").join(met.select(F.col("source").alias("target"), F.col("first").alias("made")), "target", "left")
    down = down.filter("made is null or made > first").select("source", "target", F.struct("first", "place").alias("o")).checkpoint()
    added = down.select("source", "target")
    facts = works.select("id", F.lower(F.trim(F.coalesce("doi", F.lit("")))).alias("doi"))
    wanted = down.groupBy("target").agg(F.min("o").alias("o")).withColumnRenamed("target", "id").join(every.select("id"), "id", "left_anti")
    for d in range(2, max(depth, 2) + 1):
        chosen = wanted.orderBy("o", "id").limit(most).select("id", F.row_number().over(Window.orderBy("o", "id")).alias("first"))  # ``most`` rows
        level = in_library(facts.join(F.broadcast(chosen), "id")).groupBy("id", "first").agg(F.max(F.coalesce(library, F.lit(False))).alias("held")).checkpoint()
        new = level.join(every.select("id"), "id", "left_anti").select("id", F.when(F.col("held"), "own_ref").otherwise(F.lit(f"depth{d}")).alias("type"), F.lit(d).alias("depth"))
        if d < depth:
            after = p.join(F.broadcast(level.select(F.col("id").alias("source"), "first")), "source").join(every.select(F.col("id").alias("target")), "target", "left_anti")
            after = after.join(F.broadcast(level.select(F.col("id").alias("target"), F.col("first").alias("made"))), "target", "left").filter("made is null or made > first").checkpoint()
            added = added.unionByName(after.select("source", "target"))
            wanted = after.groupBy("target").agg(F.min(F.struct("first", "place")).alias("o")).withColumnRenamed("target", "id")
        every = every.unionByName(new)
    every = every.checkpoint()

    ids = every.select("id")
    lines = edges.select("source", "target", F.lit(0).alias("k")).unionByName(matched.unionByName(read).select("source", "target", F.lit(1).alias("k"))).unionByName(added.select("source", "target", F.lit(2).alias("k")))
    lines = lines.groupBy("source", "target").agg(F.min("k").alias("k"))
    lines = lines.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    lines = lines.select("source", "target", F.when(F.col("k") == 1, "pdf_ref").otherwise("").alias("kind"))
    by = lines.join(every.filter("type = 'own'").select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counted = every.join(by, "id", "left").select("id", "type", "depth", F.when(~F.col("type").isin("own", "own_ref"), F.coalesce("n", F.lit(0))).cast("long").alias("n_own"))
    return counted, lines
