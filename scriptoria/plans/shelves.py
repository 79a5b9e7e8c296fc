"""Queries on a library with child tables: papers of documents, children of labels, lines and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.operators import shelf as S
from scriptoria.plans.base import FOLD, PAPERS, papers
from scriptoria.plans.registry import query
from scriptoria.session import table

CHILDREN = """categories AS (SELECT doc_id AS paper_id, quality * 2 + toxic AS category_id, 'c' || doc_id AS note FROM labels),
vals AS (SELECT doc_id AS paper_id, f AS field_id, CASE WHEN (doc_id + f) % 3 = 0 THEN '' ELSE coalesce(lang, '') || doc_id END AS value FROM documents, range(3) t(f)),
links AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS source_id, min(l_partkey) AS matched_id FROM lineitem GROUP BY 1),
refs AS (SELECT id, source_id, matched_id FROM links WHERE source_id IN (SELECT doc_id FROM documents) AND matched_id IN (SELECT doc_id FROM documents)),
members AS (SELECT doc_id % 7 AS collection_id, doc_id AS paper_id, 'n' || doc_id AS note FROM documents UNION ALL SELECT 7 + doc_id % 5, doc_id, 'm' || doc_id FROM documents WHERE doc_id % 2 = 0)"""


def shelf(spark, sf_dir) -> S.Shelf:
    p = papers(spark, sf_dir).select("id", "title", "doi", "filename")
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    ids = d.select(i.alias("_id"))
    text = lambda c: i.cast("string") if c is None else F.concat(F.lit(c), i.cast("string"))
    values = d.select(i, "lang", F.explode(F.array(*map(F.lit, range(3)))).alias("field_id")).select(
        i.alias("paper_id"), F.col("field_id").cast("long").alias("field_id"), F.when((i + F.col("field_id")) % 3 == 0, "").otherwise(F.concat(F.coalesce("lang", F.lit("")), text(None))).alias("value")
    )
    refs = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_orderkey").alias("source_id"), F.min("l_partkey").alias("matched_id"))
    refs = refs.join(ids, F.col("source_id") == F.col("_id"), "left_semi").join(ids, F.col("matched_id") == F.col("_id"), "left_semi")
    members = d.select((i % 7).alias("collection_id"), i.alias("paper_id"), text("n").alias("note")).unionByName(d.filter(i % 2 == 0).select((7 + i % 5).alias("collection_id"), i.alias("paper_id"), text("m").alias("note")))
    return S.Shelf(
        papers=p,
        categories=table(spark, sf_dir, "labels").select(i.alias("paper_id"), (F.col("quality") * 2 + F.col("toxic")).cast("long").alias("category_id"), text("c").alias("note")),
        values=values,
        references=refs,
        collections=spark.range(12).select("id", F.lit(False).alias("deleted")),
        members=members,
    )


def rows(s: S.Shelf) -> DataFrame:
    """child, paper_id, key, value of all tables."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parts = [
        s.papers.select(F.lit("paper").alias("child"), F.col("id").alias("paper_id"), F.lit(0).cast("long").alias("key"), F.col("filename").alias("value")),
        s.categories.select(F.lit("category").alias("child"), "paper_id", F.col("category_id").alias("key"), F.col("note").alias("value")),
        s.values.filter("value <> ''").select(F.lit("value").alias("child"), "paper_id", F.col("field_id").alias("key"), "value"),
        s.references.select(F.lit("reference").alias("child"), F.col("source_id").alias("paper_id"), F.col("id").alias("key"), text("matched_id").alias("value")),
        s.collections.select(F.lit("collection").alias("child"), F.lit(0).cast("long").alias("paper_id"), F.col("id").alias("key"), text("deleted").alias("value")),
        s.members.select(F.lit("member").alias("child"), "paper_id", F.col("collection_id").alias("key"), F.col("note").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


_TO = "coalesce(keep, {c})"
MERGED = f"""
WITH RECURSIVE {PAPERS}, {CHILDREN},
folded AS (SELECT id, lower(trim(doi)) AS doi, {FOLD} AS title FROM papers),
keys AS (SELECT id, 'd:' || doi AS key FROM folded WHERE doi <> '' UNION ALL SELECT id, 't:' || title FROM folded WHERE length(title) > 10),
step AS (SELECT k.id AS a, l.a AS b FROM keys k JOIN (SELECT key, min(id) AS a FROM keys GROUP BY key) l USING (key)),
both_ways AS (SELECT a, b FROM step UNION SELECT b, a FROM step),
reach AS (SELECT DISTINCT a AS id, a AS to_id FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.to_id),
mapping AS (SELECT id AS dead, min(to_id) AS keep FROM reach GROUP BY id HAVING min(to_id) <> id)
"""


@query("merge_children", "D7 K8", MERGED + """,
alive AS (SELECT id, filename FROM papers WHERE id NOT IN (SELECT dead FROM mapping))
SELECT 'paper' AS child, id AS paper_id, 0::BIGINT AS key, filename AS value FROM alive
UNION ALL SELECT 'category', coalesce(keep, paper_id), category_id, arg_min(note, (keep IS NOT NULL)::BIGINT * 1000000000 + paper_id) FROM categories LEFT JOIN mapping ON dead = paper_id GROUP BY 2, 3
UNION ALL SELECT 'value', coalesce(keep, paper_id), field_id, arg_min(value, (keep IS NOT NULL)::BIGINT * 1000000000 + paper_id) FROM vals LEFT JOIN mapping ON dead = paper_id WHERE value <> '' GROUP BY 2, 3
UNION ALL SELECT 'reference', source_id, id, coalesce(keep, matched_id)::VARCHAR FROM refs LEFT JOIN mapping ON dead = matched_id WHERE source_id NOT IN (SELECT dead FROM mapping)
UNION ALL SELECT 'collection', 0, i, 'false' FROM range(12) t(i)
UNION ALL SELECT 'member', coalesce(keep, paper_id), collection_id, arg_min(note, (keep IS NOT NULL)::BIGINT * 1000000000 + paper_id) FROM members LEFT JOIN mapping ON dead = paper_id GROUP BY 2, 3""")
def merge_children(spark, sf_dir):
    """All papers that share a DOI or a title, directly or over others, merged with what hangs on them."""
    s = shelf(spark, sf_dir)
    return rows(S.merged(s, S.duplicates(s.papers).checkpoint()))


def runs(spark, sf_dir) -> tuple[S.Shelf, DataFrame]:
    """The library after two import runs, and their log: run 1 made the papers of 5k+1, run 2 those of 5k+2; run 1 hung a
    file on every paper of 5k+3, twice, run 2 wrote over it where the id is even and wrote on those of 5k+4."""
    s = shelf(spark, sf_dir)
    i, name = F.col("id"), lambda c: F.concat(F.lit(c), F.col("id").cast("string"))
    p = s.papers.select("id")
    none = F.lit(None).cast("string")
    entry = lambda d, run, seq, op, field=none, before=none, after=none: d.select(F.lit(run).alias("run_id"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), "id", field.alias("field"), before.alias("before"), after.alias("after"))
    file = F.lit("filename")
    log = [
        entry(p.filter(i % 5 == 1), 1, 1, "paper"), entry(spark.range(5, 8), 1, 1, "collection"), entry(p.filter(i % 5 == 3), 1, 2, "field", file, name("old"), name("tmp")), entry(p.filter(i % 5 == 3), 1, 3, "field", file, name("tmp"), name("one")),
        entry(p.filter(i % 5 == 2), 2, 4, "paper"), entry(spark.range(8, 10), 2, 4, "collection"), entry(p.filter((i % 5 == 3) & (i % 2 == 0)), 2, 5, "field", file, name("one"), name("two")), entry(p.filter(i % 5 == 4), 2, 5, "field", file, name("old"), name("two")),
    ]
    filename = F.when((i % 5 == 3) & (i % 2 == 0) | (i % 5 == 4), name("two")).when(i % 5 == 3, name("one")).otherwise(F.col("filename"))
    return S.Shelf(s.papers.withColumn("filename", filename), s.categories, s.values, s.references, s.collections, s.members), reduce(DataFrame.unionByName, log)


_AFTER = f"""
WITH {PAPERS}, {CHILDREN}, alive AS (SELECT * FROM papers WHERE {{alive}})
SELECT 'paper' AS child, id AS paper_id, 0::BIGINT AS key, {{filename}} AS value FROM alive
UNION ALL SELECT 'category', paper_id, category_id, note FROM categories WHERE paper_id IN (SELECT id FROM alive)
UNION ALL SELECT 'value', paper_id, field_id, value FROM vals WHERE value <> '' AND paper_id IN (SELECT id FROM alive)
UNION ALL SELECT 'reference', source_id, id, CASE WHEN matched_id IN (SELECT id FROM alive) THEN matched_id::VARCHAR ELSE '-' END FROM refs WHERE source_id IN (SELECT id FROM alive)
UNION ALL SELECT 'collection', 0, i, CASE WHEN {{dead}} THEN 'true' ELSE 'false' END FROM range(12) t(i)
UNION ALL SELECT 'member', paper_id, collection_id, note FROM members WHERE paper_id IN (SELECT id FROM alive)"""


@query("undo_first_run", "C9", _AFTER.format(alive="id % 5 <> 1", dead="i BETWEEN 5 AND 7", filename="CASE WHEN id % 5 = 3 AND id % 2 = 0 OR id % 5 = 4 THEN 'two' || id WHEN id % 5 = 3 THEN 'old' || id ELSE filename END"))
def undo_first_run(spark, sf_dir):
    """What the second run alone would have left, but for what it wrote over the first."""
    s, log = runs(spark, sf_dir)
    return rows(S.undone(s, log, 1)[0])


@query("undo_both_runs", "C9", _AFTER.format(alive="id % 5 NOT IN (1, 2)", dead="i BETWEEN 5 AND 9", filename="CASE WHEN id % 5 IN (3, 4) THEN 'old' || id ELSE filename END"))
def undo_both_runs(spark, sf_dir):
    """The first run undone, then the second by the log that was left: the library before either."""
    s, log = runs(spark, sf_dir)
    return rows(S.undone(*S.undone(s, log, 1), 2)[0])
