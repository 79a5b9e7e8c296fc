"""Queries on duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import dedup
from scriptoria.plans.base import BLANKS, FOLD, PAPERS, papers
from scriptoria.plans.registry import Fixture, query
from scriptoria.session import table

FOLDED = f"folded AS (SELECT id, lower(trim(doi)) AS doi, {FOLD} AS t, title FROM papers)"
DOI_GROUPS = "SELECT 'doi' AS kind, doi AS key, list(id ORDER BY id) AS ids FROM folded WHERE doi <> '' GROUP BY doi HAVING count(*) > 1"


@query("doi_groups", "D2", f"WITH {PAPERS}, {FOLDED} SELECT key, array_to_string(ids, ',') AS ids FROM ({DOI_GROUPS})")
def doi_groups(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", F.lower(F.trim("doi")).alias("doi"))
    return dedup.groups(p, "doi").select("key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("title_groups", "D1 D3 U6", f"""
WITH {PAPERS}, {FOLDED}, d AS ({DOI_GROUPS}),
t AS (SELECT 'title' AS kind, t AS key, list(id ORDER BY id) AS ids FROM folded WHERE length(t) > 10 GROUP BY t HAVING count(*) > 1)
SELECT kind, key, array_to_string(ids, ',') AS ids FROM d UNION ALL SELECT kind, key, array_to_string(ids, ',') FROM t WHERE ids NOT IN (SELECT ids FROM d)""")
def title_groups(spark, sf_dir):
    return dedup.doi_and_title_groups(papers(spark, sf_dir)).select("kind", "key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("similar_titles", "D4 J16", f"""
WITH {PAPERS}, {FOLDED}, f AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS w FROM folded WHERE length(t) >= 15),
pairs AS (
  SELECT x.id AS a, y.id AS b, (contains(x.t, y.t) OR contains(y.t, x.t)) AS c, len(x.w) AS n, len(y.w) AS m, len(list_intersect(x.w, y.w)) AS k
  FROM f x JOIN f y ON x.id < y.id AND x.t <> y.t AND (x.doi = '' OR x.doi <> y.doi))
SELECT a, b, CASE WHEN c THEN 'contained' ELSE 'similar' END AS kind, CASE WHEN NOT c THEN floor(round(100.0::DOUBLE * k / (n + m - k), 9))::INT END AS percent
FROM pairs WHERE c OR (n >= 3 AND m >= 3 AND k * 100 >= 80 * (n + m - k))""")
def similar_titles(spark, sf_dir):
    return dedup.similar_titles(papers(spark, sf_dir))


LIBRARY = Fixture("id long, file_hash string, doi string, title string", [
    (1, "h1", "10.1000/alpha", "A study of river deltas"), (2, "h2", "", "Counting words in large corpora"), (3, "h3", "10.1000/GAMMA ", "Short"),
    (4, "h4", "10.1/x", "Counting words in large corpora!"), (5, "h5", "", "Über die Größe der Städte"),
])
NEW = Fixture("id long, file_hash string, doi string, title string", [
    (11, "h2", "10.1000/alpha", "whatever it is called"), (12, "n1", " 10.1000/gamma", "x"), (13, "n2", "", "counting words, in large corpora"),
    (14, "n3", "", "Short"), (15, "n4", "10.9", "ÜBER die Größe der Städte"), (16, "n5", "10.1/x", ""),
])


@query("intake_check", "D5 D6 J15", f"""
WITH lib AS (SELECT id, file_hash, lower(trim(doi)) AS d, {FOLD} AS t FROM {LIBRARY.sql}),
n AS (SELECT id AS new_id, file_hash, lower(trim(doi)) AS d, {FOLD} AS t, length(title) AS size FROM {NEW.sql}),
hits AS (
  SELECT new_id, min(id) AS match, 0 AS rule FROM n JOIN lib USING (file_hash) GROUP BY new_id
  UNION ALL SELECT new_id, min(id), 1 FROM n JOIN lib ON n.d = lib.d AND length(n.d) > 5 GROUP BY new_id
  UNION ALL SELECT new_id, min(id), 2 FROM n JOIN lib ON n.t = lib.t AND size > 15 AND length(n.t) > 10 GROUP BY new_id)
SELECT new_id, arg_min(match, rule) AS match, ['hash', 'doi', 'title'][min(rule) + 1] AS by FROM n LEFT JOIN hits USING (new_id) GROUP BY new_id""")
def intake_check(spark, sf_dir):
    return dedup.intake_check(NEW.frame(spark), LIBRARY.frame(spark))


@query("hash_dedup", "D6 S6", "SELECT sha256(text) AS file_hash, min(doc_id) AS id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return d.groupBy("file_hash").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query("merge_duplicates", "D7 D8 A21 K8", f"""
WITH {PAPERS}, rows AS (SELECT id, ['s:' || venue, 'y' || (year % 3)] AS tags, CASE WHEN id % 2 = 0 THEN 'note ' || id ELSE '' END AS notes, 2000 + (id * 7) % 23 AS date_added, filename, lower(trim(doi)) AS d FROM papers),
k AS (SELECT *, CASE WHEN d = '' THEN id ELSE min(id) OVER (PARTITION BY d) END AS keeper FROM rows),
t AS (SELECT keeper, list(tag ORDER BY first) AS tags FROM (SELECT keeper, tag, min((id <> keeper)::INT * 10000000 + id * 10 + p) AS first FROM (SELECT keeper, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM k) GROUP BY keeper, tag) GROUP BY keeper),
g AS (SELECT keeper AS id, coalesce(string_agg(notes, chr(10) ORDER BY id) FILTER (notes <> ''), '') AS notes, min(date_added) AS date_added, coalesce(arg_min(filename, id) FILTER (filename <> ''), '') AS filename FROM k GROUP BY keeper)
SELECT g.id, array_to_string(tags, '|') AS tags, notes, date_added, filename FROM g JOIN t ON t.keeper = g.id""")
def merge_duplicates(spark, sf_dir):
    p = papers(spark, sf_dir)
    rows = p.select("id", F.array(F.concat(F.lit("s:"), "venue"), F.concat(F.lit("y"), (F.col("year") % 3).cast("string"))).alias("tags"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("note "), F.col("id").cast("string"))).otherwise("").alias("notes"), (2000 + (F.col("id") * 7) % 23).alias("date_added"), "filename")
    d = p.select("id", F.lower(F.trim("doi")).alias("doi")).filter("doi <> ''")
    keep = d.groupBy("doi").agg(F.min("id").alias("keep"))
    mapping = d.join(keep, "doi").filter("id <> keep").select(F.col("id").alias("dead"), "keep")
    return dedup.merge(rows, mapping).withColumn("tags", F.array_join("tags", "|"))


@query("word_overlap_match", "D10 P14", f"""
WITH {PAPERS}, w AS (SELECT id, list_distinct(list_filter(string_split({FOLD}, ' '), lambda x: x <> '')) AS w, list_distinct(list_filter(string_split(lower(substr(coalesce(text, ''), 1, 5000)), ' '), lambda x: x <> '')) AS head FROM papers)
SELECT id, CASE WHEN len(w) = 0 OR len(head) = 0 THEN 0 ELSE round(len(list_intersect(w, head)) / greatest(len(w), len(head))::DOUBLE, 6) END AS overlap,
  CASE WHEN len(w) = 0 THEN TRUE ELSE 2 * len(list_intersect(w, head)) >= len(w) END AS plausible FROM w""")
def word_overlap(spark, sf_dir):
    p = papers(spark, sf_dir).select("id", T.word_set(T.fold_title(F.col("title"))).alias("w"), T.word_set(F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 5000))).alias("head"))
    return p.select("id", F.round(T.word_overlap(F.col("w"), F.col("head")), 6).alias("overlap"), (2 * F.size(F.array_intersect("w", "head")) >= F.size("w")).alias("plausible"))
