"""Queries on chunks, matches, references, people, bibliography formats and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions import people as P
from scriptoria.operators import chunks as K
from scriptoria.operators import matching as M
from scriptoria.operators import references as R
from scriptoria.plans.base import KEY, PAPERS, keyed, papers
from scriptoria.plans.registry import Fixture, query
from scriptoria.session import checkpoint_folder, table
from scriptoria.sources import bibliography as B
from scriptoria.sources import csv_files
from scriptoria.sources import record_files as RF
from scriptoria.streaming import feeds


@query("chunk_text", "R9 R10 S8")
def chunk_text(spark, sf_dir):
    return K.chunk(K.pages_of(table(spark, sf_dir, "documents")))


@query("page_score", "T1", r"""
WITH t AS (SELECT doc_id, text, string_split(trim(text, e' \t\n\x0b\f\r'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, len(list_filter(lines, lambda x: length(trim(x, e' \t\n\x0b\f\r')) BETWEEN 21 AND 299)) AS short FROM t)
SELECT doc_id, least(2.0::DOUBLE * len(regexp_extract_all(text, '10\.\d{4,}/')), 10) + least(1.5::DOUBLE * len(regexp_extract_all(text, '\[\d{1,3}\]')), 10) + least(1.0::DOUBLE * len(regexp_extract_all(text, '\((?:19|20)\d{2}\)')), 8)
  + least(1.5::DOUBLE * len(regexp_extract_all(text, '(?i)et\s+al\.')), 6) + CASE WHEN len(lines) > 5 AND short > 0.5::DOUBLE * len(lines) THEN 3 ELSE 0 END AS score FROM l""")
def page_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", R.page_score(F.col("text")).alias("score"))


REF_PAGES = Fixture("paper_id long, page int, text string", [
    *[(1, k, "plain text of a page") for k in range(1, 6)], (1, 6, "References\n[1] A 2001 10.1000/a"), (1, 7, "[2] B et al. 2002 doi 10.1000/b"), (1, 8, "appendix"),
    *[(2, k, "plain") for k in range(1, 8)], (2, 8, "[1] x 2001 [2] y 2002 10.1000/q et al."), (2, 9, "[3] x (2001) [4] y (2002) 10.1000/q"), (2, 10, "end"), *[(3, k, "plain") for k in range(1, 6)],
])


@query("reference_section", "T2 W15 W16", "SELECT * FROM (VALUES (1, 6, 'heading'), (1, 7, 'heading'), (2, 8, 'score'), (2, 9, 'score'), (2, 10, 'score'), (3, 3, 'last'), (3, 4, 'last'), (3, 5, 'last')) AS v(paper_id, page, rule)")
def reference_section(spark, sf_dir):
    return R.section(REF_PAGES.frame(spark))


def title_probes(spark, sf_dir):
    """ref_id, doi, title: every paper whose id is divisible by 100, its title cited with its words in another order
    and its letters 'h' left out; of every third also its DOI as a link."""
    p = papers(spark, sf_dir).filter("id % 100 = 0")
    moved = F.array_join(F.reverse(F.split(F.regexp_replace("title", "h", ""), " ")), " ")
    return p.select(F.col("id").alias("ref_id"), F.when(F.col("id") % 9 == 0, F.concat(F.lit("https://doi.org/"), F.col("doi"))).otherwise("").alias("doi"), moved.alias("title"))


@query("fuzzy_token_sort", "J13")
def fuzzy_token_sort(spark, sf_dir):
    """The probes against all papers."""
    return M.match(title_probes(spark, sf_dir), papers(spark, sf_dir))


@query("ranked_candidates", "J20")
def ranked_candidates(spark, sf_dir):
    """Every paper whose id is divisible by 100, by its whole title, against all papers."""
    p = papers(spark, sf_dir)
    return M.ranked(p.filter("id % 100 = 0").select(F.col("id").alias("item_id"), F.col("title").alias("name")), p)


SCORES = Fixture("file string, id long, score double", [("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.95), ("b", 2, 0.2), ("c", 2, 0.8), ("c", 3, 0.1), ("d", 1, 0.3)])


@query("greedy_assignment", "", "SELECT * FROM (VALUES ('b', 1, 0.95::DOUBLE), ('a', 2, 0.8::DOUBLE), ('c', 3, 0.1::DOUBLE)) AS v(file, id, score)")
def greedy_assignment(spark, sf_dir):
    return M.greedy(SCORES.frame(spark))


CHOICES = Fixture("file string, id long, tier int, score double", [("a", 1, 1, 0.9), ("a", 2, 1, 0.8), ("b", 1, 0, 1.0), ("b", 2, 2, 0.9), ("c", 2, 1, 0.9), ("c", 3, 1, 0.9), ("d", 1, 0, 1.0)])


@query("folder_assignment", "J14", "SELECT * FROM (VALUES ('a', 1, 1, 0.9::DOUBLE), ('b', 2, 2, 0.9::DOUBLE), ('c', 3, 1, 0.9::DOUBLE)) AS v(file, id, tier, score)")
def folder_assignment(spark, sf_dir):
    """Files in sorted order, each by DOI (tier 0), else its titles (1), else its name (2), among the items left."""
    return M.in_order(CHOICES.frame(spark))


NAMES = Fixture("id long, names string", [(9, "Novák, Petr, Lind, Eva"), (10, "de la Cruz, Ana María"), (11, "Anna Berg, Carl Dahl, Eva Falk"), (12, "Bureau of Land and Water"), (13, "Institute of Rivers, Holm, J.-P."), (14, "{Holm, Berg and Partners}; Dahl, C."), (1, "Doe, Jane; Roe, Richard"), (2, "Jane Doe and Richard van Roe"), (3, "{World Health Organization}"), (4, "Jane Doe, Richard Roe"), (5, "Doe, Jane"), (6, ""), (7, None), (8, "Plato")])


@query("people_split", "F13 F14 F15", "SELECT * FROM (VALUES (1, 'Doe, Jane; Roe, Richard', 2), (2, 'Doe, Jane; van Roe, Richard', 2), (3, '{World Health Organization}', 1), (4, 'Jane Doe, Richard Roe', 1), (5, 'Doe, Jane', 1), (6, '', 0), (7, '', 0), (8, 'Plato', 1), (9, 'Novák, Petr; Lind, Eva', 2), (10, 'de la Cruz, Ana María', 1), (11, 'Berg, Anna; Dahl, Carl; Falk, Eva', 3), (12, '{Bureau of Land and Water}', 1), (13, '{Institute of Rivers}; Holm, J.-P.', 2), (14, '{Holm, Berg and Partners}; Dahl, C.', 2)) AS v(id, people, n)")
def people_split(spark, sf_dir):
    found = NAMES.frame(spark).withColumn("p", P.people(F.col("names")))
    return found.select("id", P.joined(F.col("p")).alias("people"), F.size("p").alias("n"))


def written(spark, rows, name):
    """A folder that driver and executors share, with the rows' one column as lines of text files."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    rows.write.text(folder)
    return folder


#: Small parts, so that files of any size are read in several.
SPLIT = 20_000
_CLEAN = rf"regexp_replace({{c}}, '[{{{{}}}}\"\\]', '', 'g')"
_RUN = r"trim(regexp_replace({c}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query("bibtex_files", "S9 F22", f"""
WITH {PAPERS}, k AS (SELECT *, 'k' || id AS key, {_CLEAN.format(c='title')} AS t FROM papers)
SELECT key, CASE WHEN id % 3 = 0 THEN 'book' ELSE 'article' END AS entry_type, {_RUN.format(c="t")} AS title, 'Doe, Jane' || CASE WHEN id % 2 = 0 THEN '; Roe, R.' ELSE '' END AS authors, nullif(year, 0)::INT AS year, lower(doi) AS doi, venue FROM k""")
def bibtex_files(spark, sf_dir):
    """An entry a paper, written to files and read in parts: values in braces, in quotes and bare."""
    p = papers(spark, sf_dir)
    n, title = F.col("id").cast("string"), F.regexp_replace("title", r'[{}"\\]', "")
    kind = F.when(F.col("id") % 3 == 0, "@Book{").otherwise("@article{")
    quoted = F.when(F.col("id") % 5 == 0, F.concat(F.lit('"{'), title, F.lit('}"'))).otherwise(F.concat(F.lit("{"), title, F.lit("}")))
    authors = F.concat(F.lit("{Doe, Jane"), F.when(F.col("id") % 2 == 0, " and Roe, R.").otherwise(""), F.lit("}"))
    entry = F.concat(kind, F.lit("k"), n, F.lit(",\n title = "), quoted, F.lit(",\n author = "), authors, F.lit(",\n year = "), F.when(F.col("year") > 0, F.col("year").cast("string")).otherwise("{}"), F.lit(", doi = {"), "doi", F.lit("},\n journal = {"), "venue", F.lit("}\n}\n@comment{k, no = {entry}}"))
    found = RF.read_records(spark, "bibtex", written(spark, p.select(entry), "bibtex"), SPLIT)
    return B.bibtex_columns(found).drop("fields", "file")


@query("ris_files", "S11 S12", f"""
WITH {PAPERS}
SELECT 'JOUR' AS type, {_RUN.format(c="title || ' ' || 'v' || id")} AS title, CASE WHEN id % 2 = 0 THEN 'Doe, J.; Roe, R.' ELSE 'Doe, J.' END AS authors, CASE WHEN year > 0 THEN year END::INT AS year, CASE WHEN doi = '' THEN '' ELSE lower(doi) END AS doi FROM papers""")
def ris_files(spark, sf_dir):
    """A record a paper, written to files and read in parts: long titles over two lines, DOIs as links."""
    p = papers(spark, sf_dir)
    n = F.col("id").cast("string")
    record = F.concat(F.lit("TY  - JOUR\nAU  - Doe, J.\n"), F.when(F.col("id") % 2 == 0, "AU  - Roe, R.\n").otherwise(""), F.lit("TI  - "), "title", F.lit("\n  v"), n, F.lit("\nPY  - "), F.when(F.col("year") > 0, F.concat(F.col("year").cast("string"), F.lit("///"))).otherwise(""), F.lit("\nDO  - "), F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).otherwise(""), F.lit("\nER  - \nstray line"))
    found = RF.read_records(spark, "ris", written(spark, p.select(record), "ris"), SPLIT)
    get = lambda t: F.array_join(F.coalesce(F.try_element_at("tags", F.lit(t)), F.array().cast("array<string>")), "; ")
    return found.select("type", get("TI").alias("title"), get("AU").alias("authors"), F.substring(get("PY"), 1, 4).try_cast("int").alias("year"), I.doi_key(get("DO")).alias("doi"))


@query("ris_items", "S13", f"WITH {PAPERS} SELECT id::VARCHAR AS file, 'T' || id AS title, 'A, B; C, D' AS authors, 2001 AS year, 'J' AS journal, 'KW' AS other FROM papers WHERE id % 2 = 0")
def ris_items(spark, sf_dir):
    """A file a paper; every second record has no title and goes."""
    n = F.col("id").cast("string")
    text = F.concat(F.lit("TY  - JOUR\nA1  - C, D\nAU  - A, B\nY1  - May 2001/\nJF  - J\nKW  - k\n"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("T1  - T"), n, F.lit("\n"))).otherwise(""), F.lit("ER  - "))
    got = B.ris_items(B.parse_ris(papers(spark, sf_dir).select(n.alias("file"), text.alias("text"))))
    return got.select("file", "title", F.array_join("authors", "; ").alias("authors"), "year", "journal", F.array_join(F.map_keys("other"), ",").alias("other"))


@query("ris_export", "K2", f"""
WITH {PAPERS} SELECT id, 'TY  - JOUR' || chr(10) || 'AU  - ' || trim(authors) || chr(10) || CASE WHEN title <> '' THEN 'TI  - ' || title || chr(10) ELSE '' END || CASE WHEN year > 0 THEN 'PY  - ' || year || '///' || chr(10) ELSE '' END
  || CASE WHEN venue <> '' THEN 'JO  - ' || venue || chr(10) ELSE '' END || CASE WHEN doi <> '' THEN 'DO  - ' || doi || chr(10) ELSE '' END || 'ER  - ' AS ris FROM papers""")
def ris_export(spark, sf_dir):
    return B.ris_text(papers(spark, sf_dir))


_TEX = lambda c: f"replace(replace(replace(replace({c}, '&', '\\&'), '%', '\\%'), '_', '\\_'), '#', '\\#')"


@query("bibtex_export", "K1", f"""
WITH {PAPERS}, k AS (SELECT *, {KEY} AS key FROM papers)
SELECT id, '@article{{' || key || ',' || chr(10) || array_to_string(list_filter(['  author = {{' || replace(authors, '; ', ' and ') || '}}', CASE WHEN title <> '' THEN '  title = {{' || {_TEX('title')} || '}}' END, CASE WHEN venue <> '' THEN '  journal = {{' || {_TEX('venue')} || '}}' END,
  CASE WHEN year > 0 THEN '  year = {{' || year || '}}' END, CASE WHEN doi <> '' THEN '  doi = {{' || doi || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS bibtex FROM k""")
def bibtex_export(spark, sf_dir):
    return B.bibtex_text(keyed(papers(spark, sf_dir)).withColumnRenamed("base", "key"))


@query("archive_names", "K4 W8", f"WITH {PAPERS}, f AS (SELECT id, 'F' || (id % 30) || '.pdf' AS filename FROM papers WHERE filename <> ''), n AS (SELECT id, regexp_replace(filename, '\\.pdf$', '') AS stem, row_number() OVER (PARTITION BY lower(filename) ORDER BY id) AS n FROM f) SELECT id, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.pdf' AS member FROM n")
def archive_names(spark, sf_dir):
    p = papers(spark, sf_dir).filter("filename <> ''").withColumn("filename", F.concat(F.lit("F"), (F.col("id") % 30).cast("string"), F.lit(".pdf")))
    return B.archive_names(p)


@query("event_windows", "X10", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return feeds.window_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", "X10", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return feeds.sessions(table(spark, sf_dir, "events"))


_CELL = r"CASE WHEN regexp_matches({c}, '^[=+@\t\r]') THEN chr(39) || {c} ELSE {c} END"
_QUOTED = lambda c: rf"""CASE WHEN regexp_matches({_CELL.format(c=c)}, '[,"\r\n]') THEN '"' || replace({_CELL.format(c=c)}, '"', '""') || '"' ELSE {_CELL.format(c=c)} END"""


@query("csv_files", "K3 F26", f"""
WITH {PAPERS}, p AS (SELECT id::VARCHAR AS id, CASE id % 7 WHEN 0 THEN '=' || title WHEN 1 THEN title || ', "x"' WHEN 2 THEN '@' || title WHEN 3 THEN '-' || title ELSE title END AS title, authors, coalesce(nullif(year, 0)::VARCHAR, '') AS year, CASE WHEN filename = '' THEN 'no' ELSE 'yes' END AS has_pdf,
  CASE WHEN id % 2 = 0 THEN 'v' || id ELSE '' END AS shelf, CASE WHEN id % 3 = 0 THEN '+1' ELSE '' END AS title_2 FROM papers)
SELECT concat_ws(',', {', '.join(_QUOTED(c) for c in ("id", "title", "authors", "year", "has_pdf", "shelf", "title_2"))}) AS line FROM p""")
def csv_export(spark, sf_dir):
    """All papers with two custom fields, written to files and read back line by line without the headers."""
    i = F.col("id")
    p = papers(spark, sf_dir)
    title = F.when(i % 7 == 0, F.concat(F.lit("="), "title")).when(i % 7 == 1, F.concat("title", F.lit(', "x"'))).when(i % 7 == 2, F.concat(F.lit("@"), "title")).when(i % 7 == 3, F.concat(F.lit("-"), "title")).otherwise(F.col("title"))
    sheet = p.select("id", title.alias("title"), "authors", F.nullif("year", F.lit(0)).alias("year"), F.when(F.col("filename") == "", "no").otherwise("yes").alias("has_pdf"))
    values = p.filter(i % 2 == 0).select(i.alias("paper_id"), F.lit(1).alias("field_id"), F.concat(F.lit("v"), i.cast("string")).alias("value")).unionByName(p.filter(i % 3 == 0).select(i.alias("paper_id"), F.lit(2).alias("field_id"), F.lit("+1").alias("value")))
    fields = spark.createDataFrame([(2, "Title", 2), (1, "shelf", 1)], "field_id int, name string, position int")
    full = csv_files.with_custom_fields(sheet, fields, values)
    checkpoint_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/csv-{uuid.uuid4().hex}"
    csv_files.write_csv(full, full.columns, path)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    head = csv_files.header(full.columns)  # Spark may or may not have taken the byte order mark off
    return lines.filter(~F.col("value").isin(head, csv_files.MARK + head)).select(F.col("value").alias("line"))
