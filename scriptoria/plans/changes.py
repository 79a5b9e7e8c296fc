"""Queries on reconciliation, memberships, index maintenance and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import reconcile as R
from scriptoria.plans.base import PAPERS, papers
from scriptoria.plans.registry import Fixture, query
from scriptoria.session import table

ASKED = Fixture("id long, identifier string", [(1, "10.1/a"), (2, "10.1/b"), (3, " "), (4, None), (5, "978-1")])
FOUND = Fixture("id long, source string", [(1, "second"), (1, "first"), (2, "third"), (5, "unknown"), (3, "first")])


@query("source_precedence", "C1", f"""
WITH b AS (SELECT id, arg_min(source, list_position(['first', 'second', 'third'], source)) AS source FROM {FOUND.sql} WHERE source IN ('first', 'second', 'third') GROUP BY id)
SELECT id, CASE WHEN coalesce(trim(identifier), '') <> '' THEN source END AS source, CASE WHEN coalesce(trim(identifier), '') = '' THEN 'no_identifier' WHEN source IS NULL THEN 'not_found' ELSE 'found' END AS status FROM {ASKED.sql} LEFT JOIN b USING (id)""")
def source_precedence(spark, sf_dir):
    return R.answer(ASKED.frame(spark), FOUND.frame(spark), ["first", "second", "third"])


FIELDS = ["title", "venue", "doi", "isbn", "pages", "year", "pub_date"]
_FOLDED = lambda c: rf"rtrim(lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))), ' .')"


@query("fills_conflicts", "C3", f"""
WITH {PAPERS}, f AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN replace(title, 'e', 'E') || ' .' ELSE title || ' x' END AS title, CASE WHEN id % 3 = 0 THEN '' ELSE upper(venue) END AS venue, CASE WHEN id % 6 = 0 THEN 'http://dx.doi.org/' || lower(doi) ELSE '10.1/' || id END AS doi,
    CASE id % 4 WHEN 0 THEN '97812' WHEN 1 THEN '978-1-3, 978-1-2' ELSE '97813' END AS isbn, CASE WHEN id % 5 = 0 THEN '3–10' ELSE '3 – 9' END AS pages, CASE WHEN id % 20 = 0 THEN 1999 ELSE 0 END::VARCHAR AS year, CASE WHEN id % 3 = 0 THEN (1980 + id % 45) || '-05' ELSE '1970-01' END AS pub_date FROM papers),
l AS (SELECT f.id, nullif(p.year, 0) AS own, u.field, u.stored, u.found, u.same FROM papers p JOIN f USING (id), LATERAL (VALUES
  ('title', p.title, f.title, {_FOLDED('p.title')} = {_FOLDED('f.title')}), ('venue', p.venue, f.venue, true), ('doi', p.doi, f.doi, p.id % 6 = 0), ('isbn', '978-1-2', f.isbn, p.id % 4 < 2), ('pages', CASE WHEN p.id % 7 = 0 THEN NULL ELSE '3--9' END, f.pages, p.id % 5 <> 0),
  ('year', p.year::VARCHAR, f.year, p.year::VARCHAR = f.year), ('pub_date', '', f.pub_date, false)) AS u(field, stored, found, same)),
k AS (SELECT *, CASE WHEN trim(coalesce(stored, '')) = '' OR field = 'year' AND stored = '0' THEN 'fill' WHEN NOT same THEN 'conflict' END AS kind FROM l
  WHERE trim(found) <> '' AND NOT (field = 'year' AND found = '0') AND NOT (field = 'pub_date' AND own IS NOT NULL AND own <> coalesce(try_cast(substr(found, 1, 4) AS INT), 0))),
o AS (SELECT id, field, stored, found, kind, own FROM k WHERE kind IS NOT NULL)
SELECT id, field, stored, found, kind FROM o
UNION ALL SELECT id, 'year', NULL, substr(found, 1, 4), 'fill' FROM o WHERE field = 'pub_date' AND own IS NULL AND id NOT IN (SELECT id FROM o WHERE field = 'year')""")
def fills_conflicts(spark, sf_dir):
    """Every paper against a found record: spellings of the same, other values, dates of the same and of other years."""
    i, n = F.col("id"), F.col("id").cast("string")
    p = papers(spark, sf_dir).select("id", "title", "venue", "doi", F.lit("978-1-2").alias("isbn"), F.when(i % 7 == 0, None).otherwise(F.lit("3--9")).alias("pages"), "year", F.lit("").alias("pub_date"))
    f = p.select(
        "id", F.when(i % 2 == 0, F.concat(F.replace("title", F.lit("e"), F.lit("E")), F.lit(" ."))).otherwise(F.concat("title", F.lit(" x"))).alias("title"), F.when(i % 3 == 0, "").otherwise(F.upper("venue")).alias("venue"),
        F.when(i % 6 == 0, F.concat(F.lit("http://dx.doi.org/"), F.lower("doi"))).otherwise(F.concat(F.lit("10.1/"), n)).alias("doi"), F.when(i % 4 == 0, "97812").when(i % 4 == 1, "978-1-3, 978-1-2").otherwise("97813").alias("isbn"),
        F.when(i % 5 == 0, "3–10").otherwise("3 – 9").alias("pages"), F.when(i % 20 == 0, 1999).otherwise(0).alias("year"), F.when(i % 3 == 0, F.concat((1980 + i % 45).cast("string"), F.lit("-05"))).otherwise("1970-01").alias("pub_date"),
    )
    return R.compare(p, f, FIELDS, ("venue",))


@query("review_rows", "C5", f"""
WITH {PAPERS} SELECT id, u.field, u.before, u.after FROM papers, LATERAL (VALUES ('doi', doi, lower(doi)), ('venue', venue, upper(venue)), ('filename', filename, CASE WHEN filename = '' THEN 'new.pdf' ELSE filename END)) AS u(field, before, after) WHERE before <> after""")
def review_rows(spark, sf_dir):
    p = papers(spark, sf_dir)
    names = ["doi", "venue", "filename"]
    after = p.select("id", F.lower("doi").alias("doi"), F.upper("venue").alias("venue"), F.when(F.col("filename") == "", "new.pdf").otherwise(F.col("filename")).alias("filename"))
    return R.unpivot(p, names, "before").join(R.unpivot(after, names, "after"), ["id", "field"]).filter("before <> after")


CHANGES = Fixture("id long, year int, pub_date string, old_year int, old_date string", [(1, 2001, None, 1999, "1999-05"), (2, None, "2010-02-03", 2009, "2009"), (3, 1999, None, 1990, "1999-01-01"), (4, None, None, 2000, None), (5, 2005, "", None, None)])


@query("write_rules", "C4", f"""
SELECT id, coalesce(try_cast(substr(pub_date, 1, 4) AS INT), year, old_year) AS year,
  CASE WHEN coalesce(pub_date, '') <> '' THEN pub_date WHEN year IS NOT NULL AND try_cast(substr(old_date, 1, 4) AS INT) <> year THEN '' ELSE old_date END AS pub_date FROM {CHANGES.sql}""")
def write_rules(spark, sf_dir):
    return R.write_rules(CHANGES.frame(spark))


@query("stale_apply", "C6", f"""
WITH {PAPERS}, rows AS (SELECT doc_id AS row_id, doc_id + CASE WHEN doc_id % 11 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN doc_id % 4 = 1 THEN 'other' ELSE coalesce(source, '') END AS before, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN coalesce(source, '') ELSE 'new' END AS after, doc_id % 13 <> 0 AS accepted FROM documents)
SELECT row_id, CASE WHEN NOT accepted THEN 'not_accepted' WHEN p.id IS NULL THEN 'no_item' WHEN after = '' THEN 'nothing_to_write' WHEN venue = after THEN 'already_there' WHEN venue <> before THEN 'stale' ELSE 'apply' END AS outcome
FROM rows LEFT JOIN papers p ON p.id = rows.id""")
def stale_apply(spark, sf_dir):
    i, venue = F.col("doc_id"), F.coalesce("source", F.lit(""))
    d = table(spark, sf_dir, "documents")
    after = F.when(i % 5 == 0, "").when(i % 7 == 0, venue).otherwise("new")
    rows = d.select(i.alias("row_id"), F.when(i % 11 == 0, i + 10_000_000).otherwise(i).alias("id"), F.lit("venue").alias("field"), F.when(i % 4 == 1, "other").otherwise(venue).alias("before"), after.alias("after"), (i % 13 != 0).alias("accepted"))
    return R.stale_apply(rows, R.unpivot(papers(spark, sf_dir), ["venue"]))


_CUR = "SELECT p_size AS collection_id, p_partkey AS paper_id FROM part WHERE p_partkey % 3 <> 0"
_WANT = "SELECT p_size AS collection_id, p_partkey AS paper_id FROM part WHERE p_partkey % 4 <> 0"


@query("membership_diff", "U2 U3 U7", f"""
SELECT collection_id, paper_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' ELSE 'kept' END AS change FROM (SELECT *, 1 AS a FROM ({_CUR})) FULL JOIN (SELECT *, 1 AS b FROM ({_WANT})) USING (collection_id, paper_id)""")
def membership_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("collection_id"), F.col("p_partkey").alias("paper_id"))
    return R.membership_diff(p.filter("paper_id % 3 <> 0"), p.filter("paper_id % 4 <> 0"))


@query("adopt_memberships", "J10 K7", f"WITH c AS ({_CUR}) SELECT collection_id, paper_id, 'old' AS note FROM c UNION ALL SELECT collection_id, paper_id, 'adopted' FROM ({_WANT}) w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.collection_id = w.collection_id AND c.paper_id = w.paper_id)")
def adopt_memberships(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("collection_id"), F.col("p_partkey").alias("paper_id"))
    return R.upsert(p.filter("paper_id % 3 <> 0").withColumn("note", F.lit("old")), p.filter("paper_id % 4 <> 0").withColumn("note", F.lit("adopted")), ["collection_id", "paper_id"], replace=False)


@query("upsert_replace", "K7 K6", """
WITH n AS (SELECT s_suppkey AS id, s_name || '*' AS name FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 1000000, 'added')
SELECT id, name FROM n UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM n)""")
def upsert_replace(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = s.filter("id % 3 = 0").withColumn("name", F.concat("name", F.lit("*"))).union(spark.createDataFrame([(1_000_000, "added")], "id long, name string"))
    return R.upsert(s, new, ["id"])


_VEC = "v AS (SELECT vec_id AS id, 'm' || (label % 3) AS model FROM embeddings WHERE vec_id % 5 <> 0)"


@query("pending_index_plan", "R13 R14 J9", f"WITH {PAPERS}, {_VEC} SELECT p.id, CASE WHEN model = 'm1' THEN 'skip' WHEN model IS NOT NULL THEN 'replace' ELSE 'pending' END AS plan FROM papers p LEFT JOIN v USING (id)")
def pending_index_plan(spark, sf_dir):
    return R.index_plan(papers(spark, sf_dir), _vectors(spark, sf_dir), "m1")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 5 <> 0")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"))


@query("stale_model", "A6 U1", f"WITH {_VEC}, e AS (SELECT model FROM v UNION ALL SELECT model FROM v WHERE id % 2 = 0) SELECT model, count(*) AS n FROM e WHERE model <> 'm1' GROUP BY model ORDER BY n DESC, model LIMIT 1")
def stale_model(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return R.stale_model([v, v.filter("id % 2 = 0")], "m1")


@query("index_coverage", "A7 A8", f"WITH {PAPERS}, {_VEC} SELECT venue, count(*) AS n, count(model) AS indexed, count(*) FILTER (model = 'm1') AS current FROM papers LEFT JOIN v USING (id) GROUP BY venue")
def index_coverage(spark, sf_dir):
    j = papers(spark, sf_dir).select("id", "venue").join(_vectors(spark, sf_dir), "id", "left")
    return j.groupBy("venue").agg(F.count(F.lit(1)).alias("n"), F.count("model").alias("indexed"), F.count_if(F.col("model") == "m1").alias("current"))


@query("change_feed_distinct", "X6", "SELECT event_type AS action, user_id AS collection_id, min(event_id) AS first_event, count(*) AS merged FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)")
def change_feed(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action"), F.col("user_id").alias("collection_id"), F.date_trunc("hour", "ts").alias("h"))
    return g.agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("merged")).drop("h")
