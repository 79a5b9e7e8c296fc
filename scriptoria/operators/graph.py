"""Citation graphs and category trees, level by level with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.session import checkpoint_folder


def paths(tree: DataFrame) -> DataFrame:
    """id, path (array of names from the root), root, depth, for a tree (id, name, parent); rows of a cycle are left out.

    One join a level, whatever the depth; each level is kept, so that the next does not compute those above again.
    A level without rows ends the loop; the rows of a cycle hang below no root and are never reached.
    """
    checkpoint_folder(tree.sparkSession)
    level = tree.filter(F.col("parent").isNull()).select("id", F.array("name").alias("path"), F.col("id").alias("root"), F.lit(0).alias("depth"))
    every = level
    below = tree.filter(F.col("parent").isNotNull()).select(F.col("id").alias("child"), F.col("name").alias("child_name"), "parent")
    depth = 0
    while True:
        depth += 1
        up = level.select(F.col("id").alias("parent"), "path", "root")
        level = below.join(up, "parent").select(F.col("child").alias("id"), F.concat("path", F.array("child_name")).alias("path"), "root", F.lit(depth).alias("depth")).checkpoint()
        if not level.limit(1).count():
            break
        every = every.unionByName(level)
    return every


def subtree(tree: DataFrame, top: str) -> DataFrame:
    """ids of ``top`` and all below it."""
    return descendants(tree).filter(F.col("ancestor") == top).select("id")


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, id for every node and each of its descendants, itself included."""
    level = tree.select(F.col("id").alias("ancestor"), "id")
    every = level
    down = tree.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("p"), F.col("id").alias("c"))
    # a row of a cycle would be its own descendant for ever: only what hangs below a root takes part
    rooted = paths(tree.select("id", F.col("id").alias("name"), "parent")).select(F.col("id").alias("c"))
    down = down.join(rooted, "c")
    while True:
        level = level.join(down, F.col("id") == F.col("p")).select("ancestor", F.col("c").alias("id")).checkpoint()
        if not level.limit(1).count():
            break
        every = every.unionByName(level)
    return every


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, refs: int = 30) -> DataFrame:
    """id, depth of all nodes within ``depth`` steps of the seeds (id); of a node at most its ``refs`` least targets are followed.

    The frontier and what is seen are cut from their history by checkpoints when a folder is set.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy("target"))
    followed = edges.withColumn("place", place).filter(F.col("place") <= refs).select("source", "target")
    cut = (lambda d: d.checkpoint()) if edges.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d)
    seen = frontier = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        nxt = followed.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = cut(nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def node_type(nodes: DataFrame, own: DataFrame, known: DataFrame) -> DataFrame:
    """``nodes`` with type: own (in the library), external (a known work), else missing."""
    a, b = own.select("id").distinct().withColumn("is_own", F.lit(True)), known.select("id").distinct().withColumn("is_known", F.lit(True))
    return nodes.join(a, "id", "left").join(b, "id", "left").withColumn("type", F.when(F.col("is_own"), "own").when(F.col("is_known"), "external").otherwise("missing")).drop("is_own", "is_known")


def cocited(edges: DataFrame, least: int = 2, k: int = 500) -> DataFrame:
    """target, n: targets that ``least`` or more distinct sources cite, the ``k`` most cited."""
    n = edges.groupBy("target").agg(F.count_distinct("source").alias("n")).filter(F.col("n") >= least)
    return n.orderBy(F.desc("n"), "target").limit(k)


def collapse(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges after nodes of one DOI become the least of them (names: id, doi; '' is none); no edge to itself."""
    named = names.filter(F.col("doi") != "")
    least = named.groupBy("doi").agg(F.min("id").alias("to"))
    to = named.join(least, "doi").filter(F.col("id") != F.col("to")).select("id", "to")
    a = edges.join(to.select(F.col("id").alias("source"), F.col("to").alias("s")), "source", "left")
    b = a.join(to.select(F.col("id").alias("target"), F.col("to").alias("t")), "target", "left")
    return b.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target")).filter("source <> target").distinct()


def _node(title: Column) -> Column:
    return F.concat(F.lit("ref_"), F.substring(F.sha2(F.lower(F.trim(title)), 256), 1, 12))


def unmatched_titles(refs: DataFrame) -> DataFrame:
    """key, node id, title (of the first reference), n: references without a paper, by folded title."""
    g = refs.filter(F.col("matched").isNull()).groupBy(F.lower(F.trim("title")).alias("key")).agg(F.min_by("title", "ref_id").alias("title"), F.count(F.lit(1)).alias("n"))
    return g.select("key", _node(F.col("key")).alias("node"), "title", "n")


def unmatched_sources(refs: DataFrame) -> DataFrame:
    """node, ref_id, source: a row for each reference without a paper, repeated sources kept."""
    return refs.filter(F.col("matched").isNull()).select(_node(F.col("title")).alias("node"), "ref_id", "source")


def prefetch(edges: DataFrame, most: int = 100) -> DataFrame:
    """target, n: works to fetch for a graph's first level: all that two or more sources cite, and, up to ``most``
    in all, others in order of their id."""
    n = edges.groupBy("target").agg(F.count_distinct("source").alias("n"))
    shared = n.filter("n >= 2")
    held = F.broadcast(shared.agg(F.count(F.lit(1)).alias("held")))  # one row
    others = n.filter("n < 2").orderBy("target").limit(most).withColumn("place", F.row_number().over(Window.orderBy("target")))  # at most ``most`` rows
    return shared.unionByName(others.crossJoin(held).filter(F.col("place") <= most - F.col("held")).select("target", "n"))


def seeded(refs: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """source, target, title: references of the seeds; one to a node outside them keeps only that node's title, as an
    external neighbour, and goes if the node has none. refs: source, target; nodes: id, title; seeds: id."""
    s = seeds.select("id").distinct()
    own = refs.join(s.withColumnRenamed("id", "source"), "source", "left_semi")
    met = own.join(s.select(F.col("id").alias("target"), F.lit(True).alias("inside")), "target", "left").join(nodes.select(F.col("id").alias("target"), "title"), "target", "left")
    outside = F.col("inside").isNull()
    return met.filter(~outside | (F.coalesce("title", F.lit("")) != "")).select("source", F.when(~outside, F.col("target")).alias("target"), F.when(outside, F.col("title")).alias("title"))


def first_of_work(ranked: DataFrame) -> DataFrame:
    """The most cited row of each work: of a DOI, or of a folded title where there is none. ranked: id, doi, title, cited."""
    key = F.coalesce(F.nullif("doi", F.lit("")), F.nullif(F.lower("title"), F.lit("")))
    best = ranked.withColumn("k", key).filter("k is not null").groupBy("k").agg(F.min_by(F.struct("id", "doi", "title", "cited"), F.struct(-F.col("cited"), "id")).alias("b"))
    return best.select("b.*")
