"""Queries on graphs and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.operators import graph as G
from scriptoria.operators import graph_merge as M
from scriptoria.plans.base import EDGES, PAPERS, TREE, edges, papers, tree
from scriptoria.plans.registry import query
from scriptoria.session import table

PATHS = "p AS (SELECT id, name AS path, id AS root, 0 AS depth FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, p.path || ' / ' || t.name, p.root, p.depth + 1 FROM tree t JOIN p ON t.parent = p.id)"


@query("tree_paths", "G10", f"WITH RECURSIVE {TREE}, {PATHS} SELECT id, path, root, depth FROM p")
def tree_paths(spark, sf_dir):
    return G.paths(tree(spark, sf_dir)).withColumn("path", F.array_join("path", " / "))


@query("category_tree_counts", "A1 J3 G10", f"""
WITH RECURSIVE {TREE}, d AS (SELECT id AS ancestor, id FROM tree UNION ALL SELECT d.ancestor, t.id FROM d JOIN tree t ON t.parent = d.id),
m AS (SELECT 'n' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1)
SELECT ancestor AS id, coalesce(max(CASE WHEN d.id = ancestor THEN n END), 0) AS direct, coalesce(sum(n), 0)::BIGINT AS total FROM d LEFT JOIN m USING (id) GROUP BY ancestor""")
def category_tree_counts(spark, sf_dir):
    m = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    d = G.descendants(tree(spark, sf_dir)).join(m, "id", "left")
    return d.groupBy("ancestor").agg(F.coalesce(F.max(F.when(F.col("id") == F.col("ancestor"), F.col("n"))), F.lit(0)).alias("direct"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumnRenamed("ancestor", "id")


@query("subtree_members", "G9", "SELECT c_custkey AS paper_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def subtree_members(spark, sf_dir):
    below = G.subtree(tree(spark, sf_dir), "r1")
    return table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).join(below, "id", "left_semi").select(F.col("c_custkey").alias("paper_id"))


@query("edge_dedup", "G4 J23", f"WITH {EDGES} SELECT source, target FROM edges WHERE source IN (SELECT p_partkey FROM part) AND target IN (SELECT p_partkey FROM part)")
def edge_dedup(spark, sf_dir):
    """Edges of which both ends are nodes."""
    e = edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return e.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")


@query("bfs_depth", "G1", f"""
WITH RECURSIVE {EDGES}, f AS (SELECT source, target FROM edges QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 30),
r AS (SELECT unnest([1, 2, 3]) AS id, 0 AS depth UNION SELECT f.target, r.depth + 1 FROM r JOIN f ON f.source = r.id WHERE r.depth < 3)
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def bfs_depth(spark, sf_dir):
    return G.bfs(edges(spark, sf_dir), spark.createDataFrame([(1,), (2,), (3,)], "id long"), 3)


@query("node_types", "G2 G8", f"""
WITH {EDGES}, n AS (SELECT DISTINCT target AS id FROM edges)
SELECT id, CASE WHEN id % 4 = 0 THEN 'own' WHEN id % 3 = 0 THEN 'external' ELSE 'missing' END AS type FROM n""")
def node_types(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return G.node_type(edges(spark, sf_dir).select(F.col("target").alias("id")).distinct(), part.filter("id % 4 = 0"), part.filter("id % 3 = 0"))


@query("co_citation", "A11 W11 G8", f"WITH {EDGES} SELECT target, count(DISTINCT source) AS n FROM edges GROUP BY target HAVING n >= 2 ORDER BY n DESC, target LIMIT 500")
def co_citation(spark, sf_dir):
    return G.cocited(edges(spark, sf_dir))


@query("doi_collapse", "G3", f"""
WITH {EDGES}, m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY CASE WHEN p_partkey % 3 = 0 THEN 'd' || (p_partkey % 60) ELSE 'own' || p_partkey END) AS o FROM part)
SELECT DISTINCT s.o AS source, t.o AS target FROM edges JOIN m s ON s.id = source JOIN m t ON t.id = target WHERE s.o <> t.o""")
def doi_collapse(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("d"), (F.col("p_partkey") % 60).cast("string"))).otherwise("").alias("doi"))
    return G.collapse(edges(spark, sf_dir), names)


UNMATCHED = """r AS (SELECT o_orderkey AS ref_id, o_custkey AS source, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || upper(o_orderpriority) ELSE o_orderpriority END || ' ' || o_orderdate::DATE AS title FROM orders WHERE o_orderkey % 3 <> 0)"""


def _refs(spark, sf_dir):
    """References of customers; every third one has its paper."""
    priority = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    title = F.concat(priority, F.lit(" "), F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("source"), title.alias("title"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("matched"))


@query("unmatched_refs", "G7 A12", f"""
WITH {UNMATCHED} SELECT lower(trim(title)) AS key, 'ref_' || substr(sha256(lower(trim(title))), 1, 12) AS node, arg_min(title, ref_id) AS title, count(*) AS n FROM r GROUP BY 1""")
def unmatched_refs(spark, sf_dir):
    return G.unmatched_titles(_refs(spark, sf_dir))


@query("unmatched_ref_sources", "G7 A12", f"WITH {UNMATCHED} SELECT 'ref_' || substr(sha256(lower(trim(title))), 1, 12) AS node, ref_id, source FROM r")
def unmatched_ref_sources(spark, sf_dir):
    """Who cites each of these nodes, a row a reference: a title that many cite is no list in one row."""
    return G.unmatched_sources(_refs(spark, sf_dir))


@query("doi_map_join", "J12 J10", f"WITH {PAPERS}, w AS (SELECT doi, min(id) AS work FROM papers WHERE doi <> '' GROUP BY doi) SELECT id, work FROM papers JOIN w USING (doi)")
def doi_map_join(spark, sf_dir):
    """Each paper with the one work of its DOI: papers that share a DOI all get it."""
    p = papers(spark, sf_dir).filter("doi <> ''").select("id", "doi")
    return p.join(p.groupBy("doi").agg(F.min("id").alias("work")), "doi").select("id", "work")


LINKED = f"""{EDGES}, links AS (SELECT 'W' || source AS source, 'W' || target AS target, row_number() OVER (PARTITION BY source ORDER BY target) - 1 AS place FROM edges),
followed AS (SELECT * FROM links WHERE place < 30), works AS (SELECT 'W' || p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN '10.5/' || p_partkey ELSE '' END AS doi FROM part)"""


@query("prefetch_depths", "G5", f"""
WITH {LINKED}, first AS (SELECT id FROM works WHERE length(id) = 2),
one AS (SELECT id, 1 AS depth FROM first),
wanted AS (SELECT target AS id, min({{'s': source, 'p': place}}) AS o FROM followed WHERE source IN (SELECT id FROM one) AND target NOT IN (SELECT id FROM one) GROUP BY 1 ORDER BY o, id LIMIT 50),
two AS (SELECT id, 2 AS depth FROM wanted WHERE id IN (SELECT id FROM works)),
further AS (SELECT target AS id, min({{'s': source, 'p': place}}) AS o FROM followed WHERE source IN (SELECT id FROM two) AND target NOT IN (SELECT id FROM one UNION ALL SELECT id FROM two) GROUP BY 1 ORDER BY o, id LIMIT 50)
SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT id, 3 FROM further WHERE id IN (SELECT id FROM works)""")
def prefetch_depths(spark, sf_dir):
    """Works to fetch on three levels, fifty at most on the second and third."""
    works, links = _works(spark, sf_dir)
    return M.prefetch_levels(links, works.filter("length(id) = 2").select("id"), works, 3)


MERGED = f"""
WITH {LINKED}, c AS (SELECT count(*) AS n FROM customer), r AS (
  SELECT o_orderkey AS ref_id, o_custkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % c.n) + 1 END AS matched, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || upper(o_orderpriority) ELSE o_orderpriority END || ' ' || o_orderdate::DATE AS title,
    CASE WHEN o_orderkey % 4 = 1 THEN ' 10.5/' || (o_orderkey * 7 % (SELECT count(*) FROM part)) ELSE '' END AS doi FROM orders, c),
papers AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0),
cited AS (SELECT source AS id FROM r UNION SELECT matched FROM r),
base AS (SELECT id, 'external' AS type, 1 AS depth FROM works WHERE id LIKE '%9' UNION ALL SELECT 'own_' || id, 'own', 0 FROM papers WHERE id IN (SELECT id FROM cited) OR id % 2 = 0),
g AS (SELECT lower(trim(title)) AS key, min(ref_id) AS first, trim(arg_min(doi, ref_id)) AS doi, count(DISTINCT source) > 1 AS shared FROM r WHERE matched IS NULL GROUP BY 1),
t AS (SELECT g.*, w.id AS work, coalesce(w.id, 'ref_' || substr(sha256(key), 1, 12)) AS target FROM g LEFT JOIN works w ON w.doi = g.doi AND g.doi <> ''),
fresh AS (SELECT *, CASE WHEN work IS NOT NULL AND (work LIKE '%7' OR doi LIKE '%3') THEN 'own_ref' WHEN shared THEN 'missing' ELSE 'external' END AS type FROM t WHERE target NOT IN (SELECT id FROM base) QUALIFY row_number() OVER (PARTITION BY target ORDER BY first) = 1),
one AS (SELECT * FROM base UNION ALL SELECT target, type, 1 FROM fresh),
down AS (SELECT f.source, f.target, {{'f': a.first, 'p': f.place}} AS o FROM followed f JOIN fresh a ON a.work = f.source LEFT JOIN fresh b ON b.work = f.target WHERE f.target NOT IN (SELECT id FROM base) AND (b.first IS NULL OR b.first > a.first)),
wanted AS (SELECT target AS id FROM down WHERE target NOT IN (SELECT id FROM one) GROUP BY 1 ORDER BY min(o), id LIMIT 50),
nodes AS (SELECT * FROM one UNION ALL SELECT id, CASE WHEN id LIKE '%7' OR doi LIKE '%3' THEN 'own_ref' ELSE 'depth2' END, 2 FROM wanted JOIN works USING (id)),
lines AS (SELECT 'own_' || o_custkey AS source, 'W' || (o_orderkey % 20 * 10 + 9) AS target, 0 AS k FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT 'own_' || source, 'own_' || matched, 1 FROM r WHERE matched IS NOT NULL UNION ALL SELECT 'own_' || source, target, 1 FROM r JOIN t ON key = lower(trim(r.title)) WHERE matched IS NULL UNION ALL SELECT source, target, 2 FROM down),
edges_out AS (SELECT source, target, CASE WHEN min(k) = 1 THEN 'pdf_ref' ELSE '' END AS kind FROM lines WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) GROUP BY 1, 2)"""


def _works(spark, sf_dir):
    """Parts as works with their DOIs, and what they refer to, in order."""
    name = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    k = F.col("p_partkey")
    works = table(spark, sf_dir, "part").select(name("p_partkey").alias("id"), F.when(k % 2 == 1, F.concat(F.lit("10.5/"), k.cast("string"))).otherwise("").alias("doi"))
    links = edges(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("target")) - 1)
    return works, links.select(name("source").alias("source"), name("target").alias("target"), "place")


def _merged(spark, sf_dir):
    works, links = _works(spark, sf_dir)
    one_row = lambda name: F.broadcast(table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(name)))
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    title = F.concat(F.when(key % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.col("o_orderpriority")), F.lit(" "), F.to_date("o_orderdate").cast("string"))
    doi = F.when(key % 4 == 1, F.concat(F.lit(" 10.5/"), (key * 7 % F.col("part")).cast("string"))).otherwise("")
    refs = o.crossJoin(one_row("part")).crossJoin(one_row("customer")).select(key.alias("ref_id"), F.col("o_custkey").alias("source"), F.when(key % 3 == 0, key % F.col("customer") + 1).alias("matched"), title.alias("title"), doi.alias("doi"))
    papers = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id"))
    nodes = works.filter("id like '%9'").select("id", F.lit("external").alias("type"), F.lit(1).alias("depth")).unionByName(papers.filter("id % 2 = 0").select(M.own("id").alias("id"), F.lit("own").alias("type"), F.lit(0).alias("depth")))
    given = o.filter(key % 10 == 0).select(M.own("o_custkey").alias("source"), F.concat(F.lit("W"), (key % 20 * 10 + 9).cast("string")).alias("target"))
    return M.merge_references(nodes, given, refs, papers, works, links, works.filter("id like '%7'"), works.filter("doi like '%3'").select("doi"), 2)


@query("merged_nodes", "G7 G2", f"""{MERGED},
n AS (SELECT target AS id, count(*) AS n FROM edges_out WHERE source IN (SELECT id FROM nodes WHERE type = 'own') GROUP BY 1)
SELECT id, type, depth, CASE WHEN type NOT IN ('own', 'own_ref') THEN coalesce(n, 0) END AS n_own FROM nodes LEFT JOIN n USING (id)""")
def merged_nodes(spark, sf_dir):
    """Customers as papers, orders as their references, parts as works: own, own_ref, external, missing and depth2."""
    return _merged(spark, sf_dir)[0]


@query("merged_edges", "G7 G4", f"{MERGED} SELECT source, target, kind FROM edges_out")
def merged_edges(spark, sf_dir):
    return _merged(spark, sf_dir)[1]
