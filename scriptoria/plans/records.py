"""Queries on records of services, field rules, printed pages, passages and import runs, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import fields as X
from scriptoria.functions import identifiers as I
from scriptoria.operators import graph as G
from scriptoria.operators import matching as M
from scriptoria.operators import reconcile as C
from scriptoria.operators import references as R
from scriptoria.operators import search as S
from scriptoria.plans.base import BLANKS, EDGES, PAPERS, edges, papers
from scriptoria.plans.registry import query
from scriptoria.session import table
from scriptoria.sources import records as B

_PICK = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))
_SQL_PICK = lambda values, key: "[" + ", ".join(f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"
CR_KINDS = ["journal-article", "book-chapter", "book", "dissertation", "newspaper"]
SQUEEZED = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _documents(spark, sf_dir):
    none = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", none("source").alias("source"), none("lang").alias("lang"), "text")


def _message(d, **members):
    """doi, message: JSON of members, a row a document; __ in a name stands for a dash."""
    s = F.struct(*[F.expr(v).alias(k.replace("__", "-")) for k, v in members.items()])
    return d.select("doc_id", F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.to_json(s).alias("message"))


@query("crossref_records", "S17", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_SQL_PICK(['article', 'chapter', 'book', 'thesis', ''], 'doc_id')} AS item_type FROM documents)
SELECT '10.1/' || doc_id AS doi, item_type, {SQUEEZED("'A & B ' || source")} AS title, {SQUEEZED("source || ', G.; {Group of ' || lang || '}'")} AS authors, 1990 + doc_id % 30 AS year,
  CASE WHEN doc_id % 2 = 0 THEN (1990 + doc_id % 30) || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') ELSE '' END AS pub_date,
  CASE WHEN item_type IN ('chapter', 'book') THEN '' ELSE 'Lecture Notes in Rivers' END AS journal, CASE WHEN item_type = 'chapter' THEN 'Book ' || doc_id ELSE '' END AS booktitle,
  CASE WHEN item_type IN ('chapter', 'book') THEN 'Lecture Notes in Rivers' ELSE '' END AS series, CASE WHEN item_type = 'thesis' THEN 'phdthesis' ELSE '' END AS thesis_type,
  'P' || doc_id AS issn, CASE WHEN doc_id % 3 = 0 THEN 'http://x.org/' || doc_id ELSE '' END AS url FROM d WHERE trim(source) <> ''""")
def crossref_records(spark, sf_dir):
    d = _documents(spark, sf_dir).filter("trim(source) <> ''").withColumn("kind", _PICK(CR_KINDS, F.col("doc_id")))
    m = _message(
        d, type="kind", title="array('', concat('A <b>&amp;</b> B ', source))", author="array(named_struct('family', source, 'given', 'G.', 'name', null), named_struct('family', '', 'given', null, 'name', concat('Group of ', lang)))",
        published__print="case when doc_id % 2 = 0 then named_struct('date-parts', array(array(1990 + doc_id % 30, 1 + doc_id % 12))) end", issued="named_struct('date-parts', array(array(1990 + doc_id % 30)))",
        container__title="array('Lecture Notes in Rivers', concat('Book ', doc_id))", degree="array('Ph.D.')", issn__type="array(named_struct('type', 'electronic', 'value', 'E'), named_struct('type', 'print', 'value', concat('P', doc_id)))",
        URL="case when doc_id % 3 = 0 then concat('http://x.org/', doc_id) else 'https://doi.org/10.1/x' end",
    )
    return B.crossref(m).select("doi", "item_type", "title", "authors", "year", "pub_date", "journal", "booktitle", "series", "thesis_type", "issn", "url")


@query("datacite_records", "S18", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents)
SELECT CASE WHEN doc_id % 4 = 0 THEN '10.48550/arXiv.' || doc_id ELSE '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 1 THEN 'article' WHEN doc_id % 4 = 0 THEN 'preprint' ELSE '' END AS item_type,
  'Main ' || doc_id AS title, {SQUEEZED("source")} || ', G.; {{Institute of Rivers}}' AS authors, 2000 + doc_id % 20 AS year, CASE WHEN doc_id % 3 = 0 THEN (2000 + doc_id % 20) || '-05-01' ELSE '' END AS pub_date,
  CASE WHEN doc_id % 2 = 1 THEN 'Press' ELSE 'House' END AS publisher, CASE WHEN doc_id % 2 = 1 THEN 'J' ELSE '' END AS journal, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR ELSE '' END AS eprint FROM d WHERE trim(source) <> ''""".replace("{{Institute of Rivers}}", "{Institute of Rivers}"))
def datacite_records(spark, sf_dir):
    d = _documents(spark, sf_dir).filter("trim(source) <> ''")
    person = lambda *v: "named_struct('name', {}, 'nameType', {}, 'familyName', {}, 'givenName', {})".format(*v)
    m = _message(
        d, attributes=f"""named_struct('doi', case when doc_id % 4 = 0 then concat('10.48550/arXiv.', doc_id) end, 'publicationYear', 2000 + doc_id % 20, 'types', named_struct('resourceTypeGeneral', if(doc_id % 2 = 1, 'JournalArticle', 'Text')),
        'titles', array(named_struct('title', 'Other', 'titleType', 'Subtitle'), named_struct('title', concat('Main  ', doc_id), 'titleType', null)),
        'creators', array({person("''", "'Personal'", "source", "'G.'")}, {person("'Institute of Rivers'", "null", "null", "null")}), 'publisher', if(doc_id % 2 = 1, 'Press', '{{"name":"House"}}'),
        'dates', array(named_struct('date', concat(2000 + doc_id % 20 + if(doc_id % 3 = 0, 0, 1), '-05-01'), 'dateType', 'Issued')), 'container', named_struct('title', 'J'))""",
    )
    return B.datacite(m).select("doi", "item_type", "title", "authors", "year", "pub_date", "publisher", "journal", "eprint")


OL_DATES = ["2009", "July 2009", "Sep 15, 2009", "2009-07-31", "Feb 30, 2010", "März 1999", "Marine 2001", "no date"]
OL_YEARS = ["2009", "2009", "2009", "2009", "2010", "1999", "2001", ""]
OL_FULL = ["", "2009-07", "2009-09-15", "2009-07-31", "2010-02", "1999-03", "", ""]


@query("openlibrary_records", "S19", f"""
WITH d AS (SELECT doc_id FROM documents)
SELECT doc_id::VARCHAR AS isbn, 'book' AS item_type, 'T' || doc_id || ': Sub' AS title, 'Berg, Anna; {{River Institute}}' AS authors, 'Press' AS publisher, nullif({_SQL_PICK(OL_YEARS, 'doc_id')}, '')::INT AS year,
  {_SQL_PICK(OL_FULL, 'doc_id')} AS pub_date, {_SQL_PICK(['3', 'Revised edition', '2', ''], 'doc_id')} AS edition FROM d""".replace("{{River Institute}}", "{River Institute}"))
def openlibrary_records(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumns({"d": _PICK(OL_DATES, F.col("doc_id")), "e": _PICK(["3rd ed.", "Revised edition", "2. Auflage", ""], F.col("doc_id"))})
    m = _message(d, title="concat('T', doc_id)", subtitle="'Sub'", authors="array(named_struct('name', 'Anna Berg'), named_struct('name', 'River Institute'))", publishers="array(named_struct('name', ' '), named_struct('name', 'Press'))", publish_date="d", edition_name="e")
    return B.openlibrary(m.withColumn("isbn", F.col("doc_id").cast("string"))).select("isbn", "item_type", "title", "authors", "publisher", "year", "pub_date", "edition")


_WORDS = "list_filter(string_split(title, ' '), lambda x: x <> '')"


@query("work_abstracts", "S20 X8", f"WITH {PAPERS}, w AS (SELECT doi, min(array_to_string({_WORDS}, ' ')) AS abstract FROM papers WHERE doi <> '' GROUP BY doi) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'own' END, w.abstract, '') AS abstract FROM papers LEFT JOIN w USING (doi)")
def work_abstracts(spark, sf_dir):
    """Papers without an abstract get that of the work with their DOI, read from its inverted index; one that is stored stays."""
    p = papers(spark, sf_dir)
    w = F.filter(F.split("title", " "), lambda x: x != "")
    places = lambda x: F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull())
    index = F.to_json(F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, places(x)))))
    works = p.filter("doi <> ''").select("doi", B.abstract_of_index(index).alias("abstract"))
    return B.enrich(p.select("id", "doi", F.when(F.col("id") % 2 == 0, "own").otherwise("").alias("abstract")), works, ["abstract"]).select("id", "abstract")


@query("same_values", "D11", f"""
WITH {PAPERS} SELECT id, true AS title, true AS doi, (id % 2 = 0) AS year, true AS pages, (id % 3 = 0) AS isbn, true AS url FROM papers""")
def same_values(spark, sf_dir):
    """Stored values against spellings of the same, and of others."""
    plain, even = F.regexp_replace(F.lower("title"), "[^a-z ]", ""), F.col("id") % 2 == 0
    pairs = {
        "title": (plain, F.concat(F.lit(" "), F.upper(plain), F.lit(" ."))), "doi": (F.col("doi"), F.concat(F.lit("https://dx.doi.org/"), F.upper("doi"))), "year": (F.lit(2000), F.when(even, "2000-05").otherwise("1999")),
        "pages": (F.lit("3--9"), F.lit("3 – 9")), "isbn": (F.lit("978-1, 12-3"), F.when(F.col("id") % 3 == 0, "123").otherwise("124")), "url": (F.lit("http://x/"), F.lit("http://x")),
    }
    return papers(spark, sf_dir).select("id", *[X.same_value(f, a, b).alias(f) for f, (a, b) in pairs.items()])


@query("month_numbers", "F19", "SELECT o_orderkey, month(o_orderdate)::INT AS by_name, month(o_orderdate)::INT AS by_number, NULL::INT AS junk FROM orders")
def month_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = F.date_format("o_orderdate", "MMMM")
    return o.select("o_orderkey", X.month_number(F.concat(F.lit("{"), names, F.lit("}."))).alias("by_name"), X.month_number(F.date_format("o_orderdate", "MM")).alias("by_number"), X.month_number(F.concat(names, F.lit("s"))).alias("junk"))


@query("metadata_titles", "F9", f"""
WITH {PAPERS}, t AS (SELECT id, trim(title) AS t FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'Untitled ' || title WHEN id % 7 = 0 THEN title || '.docx' ELSE title END AS title FROM papers))
SELECT id, CASE WHEN length(t) < 10 OR NOT regexp_matches(t, '\\S\\s+\\S') OR regexp_matches(t, '{X.NO_TITLE}') THEN '' ELSE t END AS title FROM t""")
def metadata_titles(spark, sf_dir):
    title = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Untitled "), F.col("title"))).when(F.col("id") % 7 == 0, F.concat(F.col("title"), F.lit(".docx"))).otherwise(F.col("title"))
    return papers(spark, sf_dir).select("id", X.metadata_title(title).alias("title"))


@query("safe_names", "F12", rf"""
WITH {PAPERS} SELECT id, coalesce(nullif(substr(trim(regexp_replace(regexp_replace(strip_accents(replace(title, 'ß', 'ss')), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), 1, 80), ''), 'library') AS name FROM papers""")
def safe_names(spark, sf_dir):
    return papers(spark, sf_dir).select("id", X.safe_basename(F.col("title")).alias("name"))


@query("group_paths", "F24 S10", f"WITH {PAPERS} SELECT id, 'A / ' || id || '|B' AS collections, 'x|' || id AS tags FROM papers")
def group_paths(spark, sf_dir):
    n = F.col("id").cast("string")
    paths = X.group_paths(F.concat(F.lit(" A/ "), n, F.lit(" , B;;A/"), n))
    tags = X.keyword_tags(F.concat(F.lit("{x}; "), n, F.lit(", x,")))
    return papers(spark, sf_dir).select("id", F.array_join(F.transform(paths, X.collection_name), "|").alias("collections"), F.array_join(tags, "|").alias("tags"))


_DIGITS = [["", *"i ii iii iv v vi vii viii ix".split()], ["", *"x xx xxx xl l lx lxx lxxx xc".split()]]


@query("page_labels", "R17", f"""
WITH p AS (SELECT o_orderkey AS id, o_custkey AS doc, o_orderkey % 90 AS page FROM orders),
r AS (SELECT c_custkey AS doc, u.* FROM customer, (VALUES (0, '', 'r', 1), (40, '', 'D', 7), (60, 'A-', 'a', 1)) AS u(start, prefix, style, first) WHERE c_custkey % 7 <> 0),
j AS (SELECT id, page - start + first AS n, prefix, style FROM p ASOF LEFT JOIN r ON p.doc = r.doc AND p.page >= r.start)
SELECT id, coalesce(prefix || CASE style WHEN 'D' THEN n::VARCHAR WHEN 'r' THEN {_DIGITS[1]}[n // 10 + 1] || {_DIGITS[0]}[n % 10 + 1] ELSE repeat(chr(97 + ((n - 1) % 26)::INT), (n - 1) // 26 + 1) END, '') AS label FROM j""")
def page_labels(spark, sf_dir):
    """Labels of pages by the last rule that begins at or before each; a document has few rules."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 90).alias("page"))
    rules = "array(named_struct('start', 0, 'prefix', '', 'style', 'r', 'first', 1), named_struct('start', 40, 'prefix', '', 'style', 'D', 'first', 7), named_struct('start', 60, 'prefix', 'A-', 'style', 'a', 'first', 1))"
    r = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("doc"), F.expr(rules).alias("rules"))
    rule = F.get(F.sort_array(F.filter("rules", lambda x: x["start"] <= F.col("page")), asc=False), F.lit(0))
    j = p.join(r, "doc", "left").withColumn("rule", rule)
    n = (F.col("page") - F.col("rule.start") + F.col("rule.first")).cast("int")
    return j.select("id", F.coalesce(F.concat("rule.prefix", X.label_number(n, F.col("rule.style"))), F.lit("")).alias("label"))


@query("printed_pages", "R16", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'iv' WHEN o_orderkey % 2 = 0 AND o_orderkey % 20 + 1 <= 16 THEN (345 + o_orderkey % 20)::VARCHAR END AS printed FROM orders""")
def printed_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    printed = X.printed_page(k % 20 + 1, F.when(k % 5 == 0, " iv ").otherwise(""), F.when(k % 2 == 0, "345–360").otherwise("360-345"), F.lit(16))
    return table(spark, sf_dir, "orders").select(k.alias("id"), printed.alias("printed"))


_FLAT = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
_CLOSED = r"regexp_replace(text, '-\s*\n\s*', '', 'g')"
_START = lambda n: f"array_to_string(string_split(w, ' ')[1:{n}], ' ')"
_TIMES = lambda n: f"((length(p) - length(replace(p, lower({_START(n)}), ''))) / greatest(length({_START(n)}), 1))"


@query("passage_locate", "R18", rf"""
WITH d AS (SELECT doc_id, lower({_FLAT(_CLOSED)}) AS p, array_to_string(string_split({_FLAT('text')}, ' ')[3:20], ' ') AS w FROM documents)
SELECT doc_id, {"".join(f"CASE WHEN length({_START(n)}) >= 16 AND {_TIMES(n)} = 1 THEN {_START(n)} WHEN length({_START(n)}) >= 16 AND {_TIMES(n)} > 1 THEN NULL ELSE " for n in (12, 8, 5))} NULL END END END AS start FROM d""")
def passage_locate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), " ")
    return d.select("doc_id", S.locate(F.array_join(F.slice(words, 3, 18), " "), F.col("text")).alias("start"))


@query("file_titles", "D9", f"WITH {PAPERS} SELECT id, 'A Study of Things ' || id AS title FROM papers")
def file_titles(spark, sf_dir):
    n = F.col("id").cast("string")
    shapes = ["/a.b/Smith et al. - 2019 - A Study of Things %s.pdf", "2019_A_Study-of Things %s (1).pdf", "Smith_2019_A_Study_of_Things_%s.x.pdf", "A  Study of Things %s"]
    name = F.replace(F.replace(_PICK(shapes, F.col("id")), F.lit("%s"), n), F.lit(".x.pdf"), F.lit(".pdf"))
    return papers(spark, sf_dir).select("id", X.file_title(name).alias("title"))


@query("reference_pieces", "T3")
def reference_pieces(spark, sf_dir):
    return R.pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("prefetch_works", "G5", f"""
WITH {EDGES}, n AS (SELECT target, count(DISTINCT source) AS n FROM edges GROUP BY target), s AS (SELECT count(*) AS held FROM n WHERE n >= 2),
o AS (SELECT target, n, row_number() OVER (ORDER BY target) AS place FROM n WHERE n < 2) SELECT target, n FROM n WHERE n >= 2 UNION ALL SELECT target, n FROM o, s WHERE place <= 100 - held""")
def prefetch_works(spark, sf_dir):
    return G.prefetch(edges(spark, sf_dir))


@query("seeded_refs", "G6", f"""
WITH {EDGES}, s AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25)
SELECT source, CASE WHEN t.id IS NOT NULL THEN target END AS target, CASE WHEN t.id IS NULL THEN p_name END AS title FROM edges JOIN s ON s.id = source LEFT JOIN s t ON t.id = target LEFT JOIN part ON p_partkey = target WHERE t.id IS NOT NULL OR coalesce(p_name, '') <> ''""")
def seeded_refs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_size")
    return G.seeded(edges(spark, sf_dir), part, part.filter("p_size <= 25"))


@query("first_of_work", "W12", f"""
WITH {PAPERS}, k AS (SELECT id, doi, title, length(coalesce(text, '')) AS cited, coalesce(nullif(doi, ''), nullif(lower(title), '')) AS k FROM papers)
SELECT id, doi, title, cited FROM k WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY cited DESC, id) = 1""")
def first_of_work(spark, sf_dir):
    return G.first_of_work(papers(spark, sf_dir).withColumn("cited", F.length(F.coalesce("text", F.lit("")))))


@query("next_position", "A9", "SELECT c_custkey AS id, coalesce(max(o_orderkey), 0) + 1 AS next FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def next_position(spark, sf_dir):
    """The next index of a parent: one above its largest, 1 where it has none."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("m"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(m, "id", "left").select("id", (F.coalesce("m", F.lit(0)) + 1).alias("next"))


@query("tag_order", "A14", """
WITH t AS (SELECT doc_id, unnest([source, lang]) AS tag, unnest([0, 1]) AS i FROM documents) SELECT tag, count(*) AS n, min(doc_id * 2 + i) AS first FROM t WHERE tag <> '' GROUP BY tag""")
def tag_order(spark, sf_dir):
    """Distinct tags over all items, with the place at which each first stands."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array("source", "lang")).alias("i", "tag")).filter("tag <> ''")
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id") * 2 + F.col("i")).alias("first"))


@query("import_counts", "A16 A20", f"""
WITH {PAPERS} SELECT count(*) FILTER (title = '') AS errors, count(*) FILTER (title <> '' AND doi <> '') AS matched, count(*) FILTER (title <> '' AND doi = '') AS created, count(*) - count(nullif(doi, '')) AS keyless FROM papers""")
def import_counts(spark, sf_dir):
    named, keyed = F.col("title") != "", F.col("doi") != ""
    return papers(spark, sf_dir).agg(F.count_if(~named).alias("errors"), F.count_if(named & keyed).alias("matched"), F.count_if(named & ~keyed).alias("created"), (F.count(F.lit(1)) - F.count(F.nullif("doi", F.lit("")))).alias("keyless"))


@query("abstract_candidates", "Z2", f"WITH {PAPERS} SELECT id FROM papers WHERE doi <> '' AND trim(coalesce(text, ''), {BLANKS}) = '' OR doi <> '' AND venue IN (SELECT min(venue) FROM papers)")
def abstract_candidates(spark, sf_dir):
    """Papers with a DOI and no abstract, or of a chosen venue."""
    p = papers(spark, sf_dir).filter("doi <> ''")
    chosen = papers(spark, sf_dir).agg(F.min("venue").alias("venue"))
    empty = p.filter(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) == "").select("id")
    return empty.union(p.join(chosen, "venue", "left_semi").select("id")).distinct()


@query("undo_import", "C9", f"WITH {PAPERS} SELECT id, CASE WHEN id % 3 = 1 THEN '' ELSE filename END AS filename FROM papers WHERE id % 4 <> 2")
def undo_import(spark, sf_dir):
    """The library as it was before run 2: what it created goes, what it attached is detached."""
    p = papers(spark, sf_dir).select("id", "filename", F.pmod("id", F.lit(4)).alias("run_id"), F.pmod("id", F.lit(3)).alias("attached_by"))
    return C.undo(p, 2).select("id", F.when(F.col("attached_by") == 1, "").otherwise(F.col("filename")).alias("filename"))


@query("import_analysis", "J18", f"""
WITH {PAPERS}, w AS (SELECT lower(doi) AS doi, min(id) AS id FROM papers WHERE doi <> '' GROUP BY 1)
SELECT p.id AS ref_id, w.id AS matched_id, 'doi' AS strategy, (w.id % 4 <> 0) AS has_file FROM papers p JOIN w ON w.doi = lower(p.doi)""")
def import_analysis(spark, sf_dir):
    """All papers with a DOI, as an import would meet them again: their match and whether it has a file."""
    p = papers(spark, sf_dir)
    return M.analyse(p.filter("doi <> ''").select(F.col("id").alias("ref_id"), "doi", "title"), p)


@query("rematch_new", "J17", f"WITH {PAPERS}, w AS (SELECT max(id) AS id, max_by(doi, id) AS doi FROM papers WHERE doi <> '') SELECT p.id AS ref_id, w.id AS matched_id, 'doi' AS strategy FROM papers p JOIN w ON p.doi = w.doi")
def rematch_new(spark, sf_dir):
    """References by DOI against the item added last only."""
    p = papers(spark, sf_dir).filter("doi <> ''")
    new = p.agg(F.max_by(F.struct("id", "doi", "title"), "id").alias("n")).select("n.*")
    return M.rematch(p.select(F.col("id").alias("ref_id"), "doi", F.lit("").alias("title")), new)


@query("clean_records", "C2", f"""
WITH {PAPERS} SELECT id, nullif(year, 0) AS year, CASE WHEN id % 3 = 0 OR id % 3 = 1 AND year > 0 AND year <> 2000 THEN '' WHEN id % 3 = 1 THEN '2000-05' ELSE coalesce(nullif(year, 0), 1999)::VARCHAR END AS pub_date,
  CASE WHEN id % 2 = 0 THEN 'patent' ELSE '' END AS item_type FROM papers""")
def clean_records(spark, sf_dir):
    date = F.when(F.col("id") % 3 == 0, "2000-02-30").when(F.col("id") % 3 == 1, "2000/5").otherwise(F.coalesce(F.nullif("year", F.lit(0)), F.lit(1999)).cast("string"))
    return C.clean_records(papers(spark, sf_dir).select("id", "year", date.alias("pub_date"), F.when(F.col("id") % 2 == 0, " patent ").otherwise("poem").alias("item_type")))


@query("metadata_dois", "F5", f"WITH {PAPERS} SELECT id, CASE WHEN id % 3 = 0 THEN '10.1234/x(' || id || ')' WHEN id % 3 = 1 THEN '10.5678/s' || id END AS doi FROM papers")
def metadata_dois(spark, sf_dir):
    n, k = F.col("id").cast("string"), F.col("id") % 3
    xmp = F.when(k == 0, F.concat(F.lit("<x><prism:doi> doi:10.1234/x("), n, F.lit(")</prism:doi></x>")))
    subject = F.when(k < 2, F.concat(F.lit("Rivers 3 (2020). doi:10.5678/s"), n, F.lit("., p. 1")))
    return papers(spark, sf_dir).select("id", I.metadata_doi(xmp, F.lit(None).cast("string"), subject).alias("doi"))
