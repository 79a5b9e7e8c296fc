"""Queries on the catalogue: scans, look-ups, scopes, memberships, statistics, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import catalogue as C
from scriptoria.plans.base import KEY, PAPERS, keyed, papers
from scriptoria.plans.registry import Fixture, query
from scriptoria.session import table


@query("library_scan", "S1 S3 Z3 F10", f"WITH {PAPERS} SELECT id, title, authors, nullif(year, 0) AS year, {KEY} AS key FROM papers")
def library_scan(spark, sf_dir):
    p = keyed(papers(spark, sf_dir)).orderBy(F.desc_nulls_last(F.nullif("year", F.lit(0))), "authors", "id")
    return p.select("id", "title", "authors", F.nullif("year", F.lit(0)).alias("year"), F.col("base").alias("key"))


@query("like_search", "P1", f"WITH {PAPERS} SELECT id, title FROM papers WHERE title ILIKE '%an_th%' OR authors ILIKE '%an_th%' ORDER BY id DESC")
def like_search(spark, sf_dir):
    return papers(spark, sf_dir).filter(F.col("title").ilike("%an_th%") | F.col("authors").ilike("%an_th%")).select("id", "title").orderBy(F.desc("id"))


@query("lookup_ranked", "P2 P3 X11", f"""
WITH {PAPERS}, k AS (SELECT *, {KEY} AS key FROM papers)
SELECT id, key, class FROM (
  SELECT id, key, title, year, CASE WHEN starts_with(lower(key), 'src1') THEN 0 WHEN contains(lower(authors), 'src1') THEN 1 ELSE 2 END AS class
  FROM k WHERE contains(lower(title), 'src1') OR contains(lower(authors), 'src1') OR contains(lower(key), 'src1') OR contains(lower(doi), 'src1'))
ORDER BY class, year DESC NULLS LAST, title, id LIMIT 20""")
def lookup_ranked(spark, sf_dir):
    return C.lookup(keyed(papers(spark, sf_dir)).withColumnRenamed("base", "key"), "SRC1").select("id", "key", "class")


@query("page_offset_limit", "W6", f"WITH {PAPERS} SELECT id FROM papers ORDER BY venue, id LIMIT 25 OFFSET 50")
def page_offset_limit(spark, sf_dir):
    return papers(spark, sf_dir).orderBy("venue", "id").offset(50).limit(25).select("id")


ASKED = [30, 7, 30, 5_000_000, 12, 3, 7]


@query("resolve_keys", "P4 P5 J11 U5", f"WITH {PAPERS}, w AS (SELECT id, min(pos) AS pos FROM (SELECT unnest({ASKED}) AS id, generate_subscripts({ASKED}, 1) - 1 AS pos) GROUP BY id) SELECT pos, id, title FROM papers JOIN w USING (id)")
def resolve_keys(spark, sf_dir):
    return C.resolve(papers(spark, sf_dir), ASKED).select("pos", "id", "title").orderBy("pos")


@query("cite_key_alloc", "W7", f"""
WITH {PAPERS}, b AS (SELECT id, {KEY} AS base FROM papers), n AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM b)
SELECT id, base || CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr((96 + n)::INT) ELSE chr((97 + (n - 27) // 26)::INT) || chr((97 + (n - 27) % 26)::INT) END AS cite_key FROM n""")
def cite_key_alloc(spark, sf_dir):
    return C.allocate_keys(papers(spark, sf_dir))


COLLECTIONS = Fixture("id long, name string, archived_at string, deleted_at string", [(0, "Reading", None, None), (1, "archive", "2024-01-01", None), (2, "Gone", None, "2024-02-01"), (3, "empty", None, None), (4, "alpha", None, None)])
ITEMS = "items AS (SELECT id AS paper_id, id % 3 AS collection_id FROM papers WHERE id % 2 = 0 UNION SELECT id, 4 FROM papers WHERE id % 5 = 0)"


def items(p):
    a = p.filter("id % 2 = 0").select(F.col("id").alias("paper_id"), (F.col("id") % 3).alias("collection_id"))
    return a.union(p.filter("id % 5 = 0").select("id", F.lit(4).cast("long"))).distinct()


@query("collection_summary", "A3 J4 P9 W9", f"""
WITH {PAPERS}, {ITEMS}
SELECT c.id, c.name, count(p.id) AS n_items, count(p.id) FILTER (p.filename <> '') AS n_files
FROM {COLLECTIONS.sql} c LEFT JOIN items i ON i.collection_id = c.id LEFT JOIN papers p ON p.id = i.paper_id WHERE c.deleted_at IS NULL AND c.archived_at IS NULL GROUP BY c.id, c.name""")
def collection_summary(spark, sf_dir):
    p = papers(spark, sf_dir)
    return C.summary(COLLECTIONS.frame(spark), items(p), p).orderBy(F.lower("name"), "id")


@query("scoped_papers", "P6 P7 P8 J2 Z4", f"WITH {PAPERS}, {ITEMS} SELECT id, title, 'note ' || id AS note FROM papers JOIN items ON paper_id = id WHERE collection_id = 4 AND year > 2000")
def scoped_papers(spark, sf_dir):
    p = papers(spark, sf_dir)
    inside = items(p).filter("collection_id = 4").select(F.col("paper_id").alias("id"))
    return p.filter("year > 2000").join(inside, "id").select("id", "title", F.concat(F.lit("note "), F.col("id").cast("string")).alias("note"))


@query("library_statistics", "A4", f"WITH {PAPERS} SELECT count(*) AS n, min(nullif(year, 0)) AS first_year, max(nullif(year, 0)) AS last_year, count(*) FILTER (doi <> '') AS with_doi, count(*) FILTER (filename <> '') AS with_file FROM papers")
def library_statistics(spark, sf_dir):
    return C.statistics(papers(spark, sf_dir))


@query("collection_stats_by_year", "A5", f"WITH {PAPERS}, {ITEMS} SELECT year, count(*) AS n FROM papers JOIN items ON paper_id = id WHERE collection_id = 4 AND year > 0 GROUP BY year")
def collection_stats_by_year(spark, sf_dir):
    p = papers(spark, sf_dir)
    inside = items(p).filter("collection_id = 4").select(F.col("paper_id").alias("id"))
    return p.filter("year > 0").join(inside, "id", "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("n")).orderBy("year")


@query("top_n_ties", "W13 A5", f"WITH {PAPERS} SELECT venue AS name, count(*) AS n FROM papers WHERE venue <> '' GROUP BY venue ORDER BY n DESC, lower(name), name LIMIT 10")
def top_n_ties(spark, sf_dir):
    return C.top_values(papers(spark, sf_dir), "venue")


RECORDS = Fixture("id long, venue string, publisher string, school string, url string, authors string, editors string, title string, year int", [
    (1, "Journal", "", "", "", "Doe, J.", "", "T", 2000), (2, "", "Press", "", "", " ; , ", "Roe, R.", "T", 0), (3, "", "", "ETH", "", "", "", " ", 1999),
    (4, "", "", "", "http://x", "", "", "Page", None), (5, None, None, None, None, None, None, None, None), (6, "J", "", "", "", ";", "", "T", 2001),
])


def _empty(f: str) -> str:
    return f"coalesce({f}, 0) = 0" if f == "year" else rf"regexp_replace(coalesce({f}, ''), '{r'[,;\s]' if f in ('authors', 'editors') else r'\s'}', '', 'g') = ''"


_MISSING = " ".join(f"WHEN '{t}' THEN list_filter([{', '.join(f"CASE WHEN {' AND '.join(map(_empty, g.split('|')))} THEN '{g}' END" for g in needs)}], lambda x: x IS NOT NULL)" for t, needs in C.REQUIRED.items())


@query("missing_fields", "P10", f"""
WITH t AS (SELECT *, CASE WHEN NOT ({_empty('school')}) THEN 'thesis' WHEN NOT ({_empty('venue')}) THEN 'article' WHEN NOT ({_empty('publisher')}) THEN 'book' WHEN NOT ({_empty('url')}) THEN 'webpage' ELSE 'article' END AS type FROM {RECORDS.sql})
SELECT id, type, array_to_string(CASE type {_MISSING} END, ', ') AS missing FROM t""")
def missing_fields(spark, sf_dir):
    r = RECORDS.frame(spark).withColumn("type", C.item_type(*map(F.col, ("venue", "publisher", "school", "url"))))
    return C.missing_fields(r).select("id", "type", F.array_join("missing", ", ").alias("missing"))


@query("refresh_scope", "P13 Z1", f"""
WITH {PAPERS} SELECT id, array_to_string(list_filter([CASE WHEN year = 0 THEN 'year' END, CASE WHEN doi = '' THEN 'doi' END, CASE WHEN filename = '' THEN 'file' END], lambda x: x IS NOT NULL), ',') AS gaps, (doi = '' AND id % 7 <> 0) AS discover
FROM papers WHERE year = 0 OR doi = '' OR filename = ''""")
def refresh_scope(spark, sf_dir):
    gap = lambda c, v, n: F.when(F.col(c) == v, n)
    p = papers(spark, sf_dir).withColumn("gaps", F.array_compact(F.array(gap("year", 0, "year"), gap("doi", "", "doi"), gap("filename", "", "file"))))
    return p.filter(F.size("gaps") > 0).select("id", F.array_join("gaps", ",").alias("gaps"), ((F.col("doi") == "") & (F.col("id") % 7 != 0)).alias("discover"))


@query("custom_field_pivot", "J6 J7 K3", f"""
WITH {PAPERS}, v AS (SELECT doc_id AS paper_id, 'quality' AS field, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels WHERE toxic = 1)
SELECT id, title, max(value) FILTER (field = 'quality') AS quality, max(value) FILTER (field = 'toxic') AS toxic FROM papers LEFT JOIN v ON paper_id = id GROUP BY id, title""")
def custom_field_pivot(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    v = l.select(F.col("doc_id").alias("paper_id"), F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    v = v.unionByName(l.filter("toxic = 1").select(F.col("doc_id").alias("paper_id"), F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("value")))
    return C.pivot_fields(papers(spark, sf_dir).select("id", "title"), v, ["quality", "toxic"])


@query("refs_left_join", "J5 J1 A2", """
SELECT c_custkey AS paper_id, c_name AS title, count(o_orderkey) AS n_refs, count(o_orderkey) FILTER (o_orderstatus = 'O') AS open_refs, round(coalesce(sum(o_totalprice), 0), 2) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def refs_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.sum("o_totalprice").alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), zero("n").alias("n_refs"), zero("o").alias("open_refs"), F.round(zero("t"), 2).alias("total"))


@query("unreferenced_anti", "J8 J9 A13", "SELECT c_custkey AS paper_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def unreferenced_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("paper_id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id")).join(o, "paper_id", "left_anti")


@query("orphan_files", "J19 U4 T7 A17", f"""
WITH {PAPERS}, listed AS (SELECT 'f' || doc_id || '.pdf' AS name FROM documents WHERE doc_id % 5 <> 0)
SELECT 'orphan' AS kind, name, 'warning' AS severity FROM listed WHERE name NOT IN (SELECT filename FROM papers)
UNION ALL SELECT 'missing', filename, 'error' FROM papers WHERE filename <> '' AND filename NOT IN (SELECT name FROM listed)""")
def orphan_files(spark, sf_dir):
    listed = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"))
    named = papers(spark, sf_dir).filter("filename <> ''").select(F.col("filename").alias("name"))
    orphan = listed.join(named, "name", "left_anti").select(F.lit("orphan").alias("kind"), "name", F.lit("warning").alias("severity"))
    return orphan.unionByName(named.join(listed, "name", "left_anti").select(F.lit("missing").alias("kind"), "name", F.lit("error").alias("severity")))


@query("findings_by_severity", "A17 W10", f"""
WITH {PAPERS} SELECT venue, count(*) FILTER (doi = '') AS info, count(*) FILTER (year = 0) AS warning, count(*) FILTER (filename = '') AS error FROM papers GROUP BY venue""")
def findings_by_severity(spark, sf_dir):
    p = papers(spark, sf_dir)
    found = F.filter(F.array(F.when(F.col("doi") == "", "info"), F.when(F.col("year") == 0, "warning"), F.when(F.col("filename") == "", "error")), lambda x: x.isNotNull())
    long = p.select("venue", F.explode_outer(found).alias("severity")).groupBy("venue").pivot("severity", ["info", "warning", "error"]).count()
    return long.select("venue", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("info", "warning", "error")])


@query("asof_label", "J21 J22", """
WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS mark FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT event_id, user_id, round(value, 6) AS value, round(mark, 6) AS mark FROM l ASOF LEFT JOIN r USING (user_id, ts)""")
def asof_label(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    marks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("mark"))
    return C.as_of(left, marks, "user_id", "ts", "mark").select("event_id", "user_id", F.round("value", 6).alias("value"), F.round("mark", 6).alias("mark"))


@query("gap_islands", "W15", """
WITH d AS (SELECT DISTINCT user_id, floor(epoch(ts) / 86400)::BIGINT AS day FROM events), f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 ELSE 0 END AS new FROM d),
i AS (SELECT user_id, day, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS island FROM f)
SELECT user_id, island, min(day) AS first, max(day) AS last, count(*) AS n FROM i GROUP BY ALL""")
def gap_islands(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 86400).alias("day")).distinct()
    return C.islands(d, "user_id", "day").groupBy("user_id", "island").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))


@query("take_while", "W16", """
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), stop AS (SELECT user_id, min(i) AS s FROM e WHERE value < 10 GROUP BY user_id)
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM e LEFT JOIN stop USING (user_id) WHERE i < coalesce(s, 1000000000) GROUP BY user_id""")
def take_while(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id")
    open_ = F.sum((F.col("value") < 10).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0
    return e.withColumn("open", open_).filter("open").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


PROPOSED = Fixture("paper_id long, category_id long, confidence double, pos int", [(1, 1, 0.9, 0), (1, 1, 0.1, 1), (1, 99, 0.5, 2), (2, 2, 1.7, 0), (2, 3, -0.2, 1), (3, 1, None, 0), (3, 1, 0.4, 1)])
KNOWN = Fixture("id long", [(1,), (2,), (3,)])


@query("assignment_validation", "P17", f"SELECT paper_id, category_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, arg_min(confidence, pos)))::DOUBLE AS confidence FROM {PROPOSED.sql} WHERE confidence IS NOT NULL AND category_id IN (SELECT id FROM {KNOWN.sql}) GROUP BY ALL")
def assignment_validation(spark, sf_dir):
    return C.assignments(PROPOSED.frame(spark), KNOWN.frame(spark))


@query("page_median", "A19", "SELECT source, median(n_chars) AS body FROM documents GROUP BY source")
def page_median(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.percentile("n_chars", 0.5).alias("body"))


@query("excerpt", "P18", f"WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 300 THEN rtrim(substr(t, 1, 300)) || '…' ELSE t END AS excerpt FROM t")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))
