"""Queries on identifiers, names, dates and small text functions, over literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import fields as X
from scriptoria.functions import identifiers as I
from scriptoria.functions import text as T
from scriptoria.plans.base import PAPERS, papers
from scriptoria.plans.registry import Fixture, literal, query
from scriptoria.session import table

DOIS = Fixture("id long, doi string", [(1, "https://doi.org/10.1000/ABC."), (2, "doi: 10.5/x.."), (3, "http://dx.doi.org/10.7/y"), (4, " 10.9/Z "), (5, ""), (6, None), (7, "https://www.doi.org/10.1/q"), (8, "no doi")])


@query("doi_normalize", "F1", f"SELECT id, rtrim(regexp_replace(lower(trim(coalesce(doi, ''))), '{I.DOI_PREFIX}', ''), '.') AS doi FROM {DOIS.sql}")
def doi_normalize(spark, sf_dir):
    return DOIS.frame(spark).select("id", I.doi_key(F.col("doi")).alias("doi"))


TEXTS = Fixture("id long, text string", [
    (1, "See doi: 10.1000/xyz123. Published 2019, revised 2019 and 2021. ISBN 978-3-16-148410-0"), (2, "https://doi.org/10.5555/(abc)).\n2004 2003 2004 2003"), (3, "arXiv:2101.01234v2 from 1999"),
    (4, "Nothing here"), (5, "https://arxiv.org/abs/hep-th/9901001 in 1998; 10.1234/plain,next"), (6, None), (7, "intro\nReferences\n10.1/a doi:10.4444/late"),
])
_FIRST = lambda ps: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {literal(p)}, 1), '')" for p in ps) + ")"


@query("isbn_extract", "F6 F29", f"SELECT id, translate({_FIRST(I.ISBN_PATTERNS)}, '- ', '') AS isbn FROM {TEXTS.sql}")
def isbn_extract(spark, sf_dir):
    return TEXTS.frame(spark).select("id", I.isbn_in_text(F.col("text")).alias("isbn"))


@query("arxiv_extract", "F7", f"SELECT id, {_FIRST(I.ARXIV_PATTERNS)} AS arxiv, '10.48550/arXiv.' || regexp_replace({_FIRST(I.ARXIV_PATTERNS)}, '(?i)v\\d+$', '') AS doi FROM {TEXTS.sql}")
def arxiv_extract(spark, sf_dir):
    a = I.arxiv_in_text(F.col("text"))
    return TEXTS.frame(spark).select("id", a.alias("arxiv"), I.arxiv_doi(a).alias("doi"))


FOUND_DOIS = Fixture("id long, doi string, labelled string", [(1, "10.1000/xyz123", "10.1000/xyz123"), (2, "10.5555/(abc)", "10.5555/(abc)"), (3, None, None), (4, None, None), (5, "10.1234/plain", None), (6, None, None), (7, "10.4444/late", None)])


@query("doi_extract", "F2 F3 F4 F8", f"SELECT * FROM {FOUND_DOIS.sql}")
def doi_extract(spark, sf_dir):
    """The SQL side states the expected values: trailing brackets are trimmed in steps, which SQL has no word for."""
    return TEXTS.frame(spark).select("id", I.doi_in_text(F.col("text")).alias("doi"), I.labelled_doi(F.col("text")).alias("labelled"))


@query("year_mode", "A15 F6", f"""
WITH y AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{I.YEAR}')) AS y, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{I.YEAR}'), 1) AS i FROM (SELECT doc_id, substr(text, 1, 3000) AS text FROM documents UNION ALL SELECT -id, text FROM {TEXTS.sql})),
c AS (SELECT doc_id, y, count(*) AS n, min(i) AS first FROM y GROUP BY ALL)
SELECT doc_id, y::INT AS year, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1""")
def year_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 3000).alias("text")).union(TEXTS.frame(spark).select(-F.col("id"), "text"))
    y = d.select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(I.YEAR), F.lit(0))).alias("i", "y"))
    c = y.groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    best = c.groupBy("doc_id").agg(F.min_by(F.struct("y", "n"), F.struct(-F.col("n"), "first")).alias("b"))
    return best.select("doc_id", F.col("b.y").cast("int").alias("year"), F.col("b.n").alias("n"))


DATES = Fixture("id long, d string", [(1, "2024"), (2, "2024-3"), (3, "2024/03/15"), (4, "2024-02-30"), (5, "2024-13"), (6, "15.3.2024"), (7, None), (8, "2023-02-29"), (9, "2024-02-29T10:00:00"), (10, " 1999- ")])
WANT_DATES = {1: "2024", 2: "2024-03", 3: "2024-03-15", 4: "", 5: "", 6: "", 7: "", 8: "", 9: "2024-02-29", 10: "1999"}


@query("partial_date", "F18", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}', {v[:4] if k in (1, 2, 3, 4, 5, 8, 9, 10) and v else {4: 2024, 5: 2024, 8: 2023}.get(k, 'NULL')})" for k, v in WANT_DATES.items()) + ") AS v(id, iso, year)")
def partial_date(spark, sf_dir):
    return DATES.frame(spark).select("id", I.partial_date(F.col("d")).alias("iso"), I.year_number(F.col("d")).alias("year"))


MISC = Fixture("id long, a string, n long", [(1, "=SUM(A1)", 50), (2, "+1", -5), (3, "-1", 120), (4, "@x", 33), (5, "plain, \"quoted\"", 0), (6, "", 100), (7, "Größe & Maß_50%", 7), (8, None, None)])


@query("csv_guard", "K3 F26", rf"""
SELECT id, CASE WHEN regexp_matches(a, '^[=+@\t\r]') THEN '''' || a ELSE coalesce(a, '') END AS cell, greatest(0, least(100, coalesce(n, 0))) AS percent FROM {MISC.sql}""")
def csv_guard(spark, sf_dir):
    return MISC.frame(spark).select("id", X.csv_cell(F.col("a")).alias("cell"), X.percent(F.col("n")).alias("percent"))


@query("tex_escape", "F17 K1", rf"""
SELECT id, replace(replace(replace(replace(coalesce(a, ''), '&', '\&'), '%', '\%'), '_', '\_'), '#', '\#') AS tex FROM {MISC.sql}""")
def tex_escape(spark, sf_dir):
    return MISC.frame(spark).select("id", X.tex(F.col("a")).alias("tex"))


TAGS = Fixture("id long, tags string", [(1, '["a", "b", "a"]'), (2, "x; y, x"), (3, ""), (4, None), (5, "[]"), (6, "one")])


@query("tag_normalize", "F21", "SELECT * FROM (VALUES (1, 'a|b'), (2, 'x|y'), (3, ''), (4, ''), (5, ''), (6, 'one')) AS v(id, tags)")
def tag_normalize(spark, sf_dir):
    return TAGS.frame(spark).select("id", F.array_join(X.tags(F.col("tags")), "|").alias("tags"))


_NAME = r"regexp_replace({c}, '[^\p{{L}}\p{{N}}_]', '', 'g')"
_PEOPLE = "CASE id % 4 WHEN 0 THEN 'O''Brien-' || coalesce(lang, 'X') || ' Ü., Jo' WHEN 1 THEN '' WHEN 2 THEN 'van der Berg' || id ELSE authors END"
_LONG = "CASE WHEN id % 3 = 0 THEN replace(title, ' ', ' - ') WHEN id % 3 = 1 THEN 'non-linear_x: ' || title ELSE title END"


@query("file_name", "F11", rf"""
WITH {PAPERS.replace("AS venue,", "AS venue, lang,")}, p AS (SELECT id, year, {_PEOPLE} AS authors, {_LONG} AS title, (id % 50) || ['-', ' – ', '--', ' '][(id % 4 + 1)::INT] || (id % 50 + 9) AS pages FROM papers)
SELECT id, coalesce(nullif(year, 0)::VARCHAR, 'XXXX') || '_' || CASE WHEN authors = '' THEN 'Unknown' ELSE {_NAME.format(c="split_part(authors, ',', 1)")} END || '_' ||
  replace(array_to_string(list_filter(string_split_regex(regexp_replace(title, '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+'), lambda x: x <> '')[1:5], '_'), '-', '') || '.pdf' AS name, regexp_replace(pages, '\s*[-–—]+\s*', '--', 'g') AS pages FROM p""")
def file_name(spark, sf_dir):
    """All papers, with authors of marks, hyphens and several words, and titles whose words are parted by hyphens."""
    i = F.col("id")
    p = papers(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    authors = F.when(i % 4 == 0, F.concat(F.lit("O'Brien-"), F.coalesce("lang", F.lit("X")), F.lit(" Ü., Jo"))).when(i % 4 == 1, "").when(i % 4 == 2, F.concat(F.lit("van der Berg"), i.cast("string"))).otherwise(F.col("authors"))
    title = F.when(i % 3 == 0, F.replace("title", F.lit(" "), F.lit(" - "))).when(i % 3 == 1, F.concat(F.lit("non-linear_x: "), "title")).otherwise(F.col("title"))
    between = F.get(F.array(*map(F.lit, ("-", " – ", "--", " "))), (i % 4).cast("int"))
    pages = F.concat((i % 50).cast("string"), between, (i % 50 + 9).cast("string"))
    return p.select("id", X.file_name(authors, F.col("year"), title).alias("name"), X.page_range(pages).alias("pages"))


@query("html_text", "F23", r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?i)</?(p|br|div|li|h[1-6]|tr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g')) AS text FROM pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("json_lookup", "F28 F22", "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events")
def json_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_field(F.col("props"), "missing", "k").alias("k"))


COLOURS = Fixture("id long, c array<double>", [(1, [0.5]), (2, [1.0, 0.0, 0.2]), (3, [0.0, 1.0, 1.0, 0.0]), (4, [])])


@query("colour_hex", "F27", "SELECT * FROM (VALUES (1, '#808080'), (2, '#ff0033'), (3, '#ff0000'), (4, NULL)) AS v(id, hex)")
def colour_hex(spark, sf_dir):
    return COLOURS.frame(spark).select("id", X.colour(F.col("c")).alias("hex"))


PDF_DATES = Fixture("id long, d string", [(1, "D:20240315101112+02'00'"), (2, "D:20240315"), (3, "D:20240315101112Z"), (4, "junk"), (5, None)])


@query("pdf_date", "F20", "SELECT * FROM (VALUES (1, '2024-03-15T10:11:12+02:00'), (2, '2024-03-15'), (3, '2024-03-15T10:11:12Z'), (4, NULL), (5, NULL)) AS v(id, iso)")
def pdf_date(spark, sf_dir):
    return PDF_DATES.frame(spark).select("id", X.pdf_date(F.col("d")).alias("iso"))


@query("next_due", "F25", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 30 AS overdue FROM orders")
def next_due(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.date_add(d, 30), "yyyy-MM-dd").alias("due"), (F.datediff(F.lit("1998-01-01"), d) > 30).alias("overdue"))


LATEX = Fixture("id long, t string", [(1, r"As \cite{a,b} and \citep[p. 3]{ c } % \cite{no}"), (2, "none"), (3, r"\textcite{a}\nocite{*}")])


@query("cited_keys", "F16", "SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (1, 'c'), (3, 'a')) AS v(id, key)")
def cited_keys(spark, sf_dir):
    return X.cited_keys(LATEX.frame(spark), "id", "t")


@query("usable_title", "P15 P16", f"""
WITH l AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10))[1:15], lambda x: trim(x))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10))[1:15], 1) AS i FROM documents),
g AS (SELECT * FROM l WHERE length(line) >= 10 AND NOT regexp_matches(line, '(?i)doi|https?:|@') AND 3 * length(regexp_replace(line, '[^0-9]', '', 'g')) <= length(line) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 3)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS guesses FROM g GROUP BY doc_id""")
def usable_title(spark, sf_dir):
    g = X.title_guesses(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(g, "\n").alias("guesses")).filter("guesses <> ''")
