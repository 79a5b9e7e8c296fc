"""Queries on item types, entries in both dialects, RDF exports, snapshots and project keys, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptoria.functions import item_types as Y
from scriptoria.operators import catalogue as C
from scriptoria.operators import reconcile as R
from scriptoria.plans.base import KEY, PAPERS, keyed, papers
from scriptoria.plans.registry import query
from scriptoria.session import checkpoint_folder, table
from scriptoria.sources import attachments as A
from scriptoria.sources import entries as E
from scriptoria.sources import rdf, snapshot

KINDS = list(Y.ITEM_TYPES)
_KIND = f"{KINDS}[doc_id % {len(KINDS)} + 1]"
_PICKED = lambda: F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
_LACKS = " ".join(
    f"WHEN '{k}' THEN list_filter([{', '.join('CASE WHEN ' + ('year = 0' if g == 'year' else 'true') + f''' THEN '{g.split('|')[0]}' END''' for g in t.required.split() if g != 'title')}], lambda x: x IS NOT NULL)" for k, t in Y.ITEM_TYPES.items()
)


@query("required_fields", "P11 P12", f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2000 END AS year, CASE WHEN doc_id % 17 < 13 THEN {KINDS}[doc_id % 17 + 1] WHEN doc_id % 17 = 13 THEN 'thesis' WHEN doc_id % 17 = 14 THEN 'chapter' WHEN doc_id % 17 = 15 THEN 'conference' ELSE 'misc' END AS type FROM documents),
m AS (SELECT doc_id, type, CASE type {_LACKS} END AS missing FROM d)
SELECT doc_id, type, array_to_string(list_filter(missing, lambda x: NOT (doc_id % 17 = 13 AND x = 'thesis_type' OR doc_id % 17 IN (14, 15) AND x = 'booktitle')), ',') AS missing FROM m""")
def required_fields(spark, sf_dir):
    """Items of all types, stored or told by their columns, with nothing but a title and perhaps a year."""
    k = F.col("doc_id") % 17
    stored = F.when(k < 13, F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int"))).when(k == 14, "poem")
    own = {
        "item_type": stored, "title": F.lit("T"), "year": F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2000), "pub_date": F.lit(" "), "authors": F.lit(" ; ,"), "editors": F.when(k == 14, "Roe, R."),
        "thesis_type": F.when(k == 13, "phdthesis"), "booktitle": F.when(k.isin(14, 15), "B"), "journal": F.lit(""), "isbn": F.when(k == 16, "1"), "publisher": F.lit(None).cast("string"),
    }
    own |= {n: F.lit("") for n in E.COLUMNS if n not in own}
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in own.items()]).select("doc_id", Y.effective_type().alias("type"), F.array_join(Y.missing_fields(), ",").alias("missing"))


def _items(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    even, odd = F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1
    year = F.lit(2000) + F.col("doc_id") % 20
    own = {
        "cite_key": F.concat(F.lit("k"), n), "item_type": _PICKED(), "title": F.concat(F.lit("T & "), n), "authors": F.lit("Jane Doe and {River Institute}"), "editors": F.lit(" , ;"), "year": year,
        "pub_date": F.when(even, F.concat(year.cast("string"), F.lit("/5"))).otherwise("1990-01"), "journal": F.lit("J"), "booktitle": F.lit("B_1"), "volume": F.lit("3"), "issue": F.lit("4"), "number": F.lit("5"),
        "pages": F.lit("7 – 9"), "institution": F.lit("Hall GmbH; Roe, R."), "publisher": F.lit("Press"), "place": F.lit("Ül"), "doi": F.concat(F.lit("10.1/"), n), "url": F.lit("http://x/"), "accessed": F.lit("2020-02-03"),
        "thesis_type": F.when(odd, "mastersthesis"), "version": F.lit("2"), "eprint": F.lit("arXiv:2101.00001v2"), "note_bib": F.lit("n"), "tags": F.lit('["a", " b "]'), "event": F.lit("E"),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in own.items()])


def _entry_sql(types: str, middle: list[str]) -> str:
    head = ["'  author = {Doe, Jane and {River Institute}},'", r"'  title = {T \& ' || doc_id || '},'", "CASE WHEN NOT inside THEN '  journal = {J},' END", r"'  booktitle = {B\_1},'"]
    lines = [f"'@' || {types} || '{{k' || doc_id || ','", *head, *middle, "'}'"]
    return f"""
WITH d AS (SELECT doc_id, {_KIND} AS kind, doc_id % 2 = 1 AS odd, 2000 + doc_id % 20 AS year, {_KIND} IN ('chapter', 'conference') AS inside, {_KIND} IN ('preprint', 'webpage', 'patent', 'dataset', 'software') AS as_misc FROM documents)
SELECT doc_id, array_to_string(list_filter([{", ".join(lines)}], lambda x: x IS NOT NULL), chr(10)) AS entry FROM d"""


_NUMBER = "'  number = {' || CASE WHEN kind = 'article' THEN 4 ELSE 5 END || '},'"
_TYPE = lambda thesis: f"CASE WHEN odd AND kind = 'thesis' THEN {thesis} WHEN odd AND kind IN ('report', 'standard') THEN '  type = {{mastersthesis}},' WHEN kind = 'standard' THEN '  type = {{Standard}},' END"
_HELD = "'  ' || CASE kind WHEN 'thesis' THEN 'school' WHEN 'report' THEN 'institution' WHEN 'standard' THEN 'institution' ELSE 'organization' END || ' = {Hall GmbH; Roe, R.},'"
_PLACE = ["'  publisher = {Press},'", r"""'  address = {{\"U}l},'"""]
_DOI = ["'  doi = {10.1/' || doc_id || '},'", "'  eprint = {2101.00001v2},'"]
_LAST = "'  keywords = {a, b},'"


@query("entries_biblatex", "K1", _entry_sql(
    "CASE kind WHEN 'chapter' THEN 'incollection' WHEN 'conference' THEN 'inproceedings' WHEN 'report' THEN CASE WHEN odd THEN 'report' ELSE 'techreport' END WHEN 'standard' THEN 'techreport' WHEN 'preprint' THEN 'online' WHEN 'webpage' THEN 'online' ELSE kind END",
    ["'  eventtitle = {E},'", "'  volume = {3},'", _NUMBER, "'  pages = {7--9},'", _TYPE("'  type = {mathesis},'"), "CASE WHEN kind = 'patent' THEN '  holder = {{Hall GmbH} and Roe, R.},' ELSE " + _HELD + " END", *_PLACE,
     "CASE WHEN odd THEN '  year = {' || year || '},' ELSE '  date = {' || year || '-05},' END", *_DOI, "'  eprinttype = {arxiv},'", "'  url = {http://x/},'", "'  urldate = {2020-02-03},'", "'  version = {2},'", "'  note = {n},'", _LAST],
))
def entries_biblatex(spark, sf_dir):
    return E.entries(_items(spark, sf_dir)).select("doc_id", "entry")


@query("entries_bibtex", "K1", _entry_sql(
    "CASE WHEN as_misc THEN 'misc' WHEN kind = 'chapter' THEN 'incollection' WHEN kind = 'conference' THEN 'inproceedings' WHEN kind = 'thesis' THEN CASE WHEN odd THEN 'mastersthesis' ELSE 'phdthesis' END WHEN kind IN ('report', 'standard') THEN 'techreport' ELSE kind END",
    ["'  volume = {3},'", _NUMBER, "'  pages = {7--9},'", _TYPE("NULL"), _HELD, *_PLACE, "'  year = {' || year || '},'", "CASE WHEN NOT odd THEN '  month = may,' END", *_DOI, "'  archiveprefix = {arXiv},'",
     "CASE WHEN kind = 'patent' THEN '  howpublished = {Patent 5},' WHEN as_misc THEN '  howpublished = {' || chr(92) || 'url{http://x/}},' END", "CASE WHEN kind = 'patent' OR NOT as_misc THEN '  url = {http://x/},' END", "'  note = {n; Accessed 2020-02-03; Version 2},'", _LAST],
))
def entries_bibtex(spark, sf_dir):
    return E.entries(_items(spark, sf_dir), "bibtex").select("doc_id", "entry")


_RDF = (
    '<rdf:RDF xmlns:rdf="r" xmlns:z="z" xmlns:bib="b" xmlns:dc="d" xmlns:dcterms="t" xmlns:foaf="f">'
    '<bib:Article rdf:about="#i%s"><z:itemType>%k</z:itemType><dcterms:isPartOf rdf:resource="#j"/><bib:authors><rdf:Seq><rdf:li><foaf:Person><foaf:surname>M&#252;ller</foaf:surname><foaf:givenName>A.</foaf:givenName></foaf:Person></rdf:li></rdf:Seq></bib:authors>'
    '<dc:subject>x</dc:subject><dc:subject><z:AutomaticTag><rdf:value>y</rdf:value></z:AutomaticTag></dc:subject><dc:title>T %s</dc:title><dc:date>May 2001</dc:date><dc:identifier>DOI 10.1/%s.</dc:identifier><dc:identifier>ISBN 978-1</dc:identifier><dcterms:isReferencedBy rdf:resource="#m"/></bib:Article>'
    '<rdf:Description rdf:about="http://doi.org/10.2/%s"><dc:title>U</dc:title></rdf:Description><bib:Journal rdf:about="#j"><dc:title>Jo</dc:title></bib:Journal><bib:Memo rdf:about="#m"><rdf:value>&lt;p&gt;a&lt;/p&gt;b</rdf:value></bib:Memo>'
    '<z:Collection rdf:about="#c1"><dc:title>Top</dc:title><dcterms:hasPart rdf:resource="#c2"/><dcterms:hasPart rdf:resource="#i%s"/></z:Collection><z:Collection rdf:about="#c2"><dc:title>Low %s</dc:title><dcterms:hasPart rdf:resource="#i%s"/></z:Collection></rdf:RDF>'
)


def _exports(spark, sf_dir):
    """An export a document: an article in two collections, a page, a journal, a note; every fifth breaks off."""
    n = F.col("doc_id").cast("string")
    text = F.replace(F.replace(F.lit(_RDF), F.lit("%s"), n), F.lit("%k"), F.when(F.col("doc_id") % 2 == 0, "bookSection").otherwise("poem"))
    return table(spark, sf_dir, "documents").select(n.alias("file"), F.when(F.col("doc_id") % 5 == 0, F.substring(text, 1, 200)).otherwise(text).alias("text"))


@query("rdf_items", "S14", """
WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id::VARCHAR AS file, 'muller2001' AS key, CASE WHEN doc_id % 2 = 0 THEN 'incollection' ELSE 'article' END AS entry_type, 'T ' || doc_id AS title, 'Müller, A.' AS authors, 2001 AS year, '10.1/' || doc_id AS doi, '978-1' AS isbn, 'Jo' AS journal, 'x|y' AS tags, 'a' || chr(10) || 'b' AS notes FROM d
UNION ALL SELECT doc_id::VARCHAR, 'http___doi_org_10_2_' || doc_id, 'misc', 'U', '', NULL, '10.2/' || doc_id, '', '', '', '' FROM d""")
def rdf_items(spark, sf_dir):
    found = rdf.items(rdf.elements(_exports(spark, sf_dir)))
    return found.select("file", "key", "entry_type", "title", "authors", "year", "doi", "isbn", "journal", F.array_join("tags", "|").alias("tags"), "notes")


@query("rdf_collections", "S15", """
WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id::VARCHAR AS file, 'i' || doc_id AS item, 'Top' AS path, 1 AS place FROM d UNION ALL SELECT doc_id::VARCHAR, 'i' || doc_id, 'Top/Low ' || doc_id, 2 FROM d""")
def rdf_collections(spark, sf_dir):
    return rdf.collection_paths(rdf.elements(_exports(spark, sf_dir))).select("file", "item", F.array_join("path", "/").alias("path"), "place")


@query("backup_manifest", "K5", f"WITH {PAPERS} SELECT 'papers' AS name, count(*) AS items, true AS intact FROM papers UNION ALL SELECT 'labels', count(*), true FROM labels")
def backup_manifest(spark, sf_dir):
    """Two tables written to the shared folder, their manifest, and the files held to it."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/snapshot-{uuid.uuid4().hex}"
    snapshot.write({"papers": papers(spark, sf_dir), "labels": table(spark, sf_dir, "labels")}, folder)
    kept = snapshot.manifest(spark, folder, ["papers", "labels"]).checkpoint()
    return snapshot.verify(kept, snapshot.manifest(spark, folder, ["papers", "labels"]))


@query("project_keys", "Z5", f"""
WITH {PAPERS}, k AS (SELECT venue AS project, {KEY} AS key, min(id) AS first FROM papers GROUP BY ALL) SELECT project, key, row_number() OVER (PARTITION BY project ORDER BY first) AS place FROM k WHERE key <> ''""")
def project_keys(spark, sf_dir):
    return C.project_keys(keyed(papers(spark, sf_dir)).select(F.col("venue").alias("project"), "id", F.col("base").alias("key")))


@query("attachments", "S16", f"""
WITH {PAPERS}, s AS (SELECT id, 'files/f' || id || '.pdf' AS own, filename FROM papers)
SELECT id, 1 AS place, CASE id % 3 WHEN 0 THEN 'Full Text:' || own || ':application/pdf' WHEN 1 THEN own ELSE 'file:///lib/' || own END AS spec, CASE WHEN filename <> '' THEN '/lib/' || own END AS path FROM s
UNION ALL SELECT id, 2, own, NULL FROM s WHERE id % 3 = 2 AND filename = ''""")
def attachments(spark, sf_dir):
    """Fields in three dialects against the library's files; every third names its file twice."""
    p = papers(spark, sf_dir)
    own = F.concat(F.lit("files/f"), F.col("id").cast("string"), F.lit(".pdf"))
    k = F.col("id") % 3
    field = F.when(k == 0, F.concat(F.lit("Full Text:"), own, F.lit(":application/pdf"))).when(k == 1, own).otherwise(F.concat(F.lit("file:///lib/"), own, F.lit("; "), own))
    files = p.filter("filename <> ''").select(F.concat(F.lit("/lib/files/"), F.col("filename")).alias("path"))
    return A.resolve(p.select("id", field.alias("field"), F.lit("/lib").alias("base")), files)


@query("notes_backfill", "C8", f"""
WITH {PAPERS}, v AS (SELECT doc_id AS id, max(quality)::VARCHAR AS q FROM labels GROUP BY 1)
SELECT id, CASE WHEN q IS NULL THEN CASE WHEN id % 2 = 0 THEN ' own ' ELSE '' END WHEN id % 2 = 0 THEN 'own' || chr(10) || chr(10) || q ELSE q END AS notes FROM papers LEFT JOIN v USING (id)""")
def notes_backfill(spark, sf_dir):
    """A custom field of quality marks, named like notes, moves into the notes of all papers."""
    p = papers(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, " own ").otherwise("").alias("notes"))
    v = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("paper_id")).agg(F.max("quality").cast("string").alias("value")).withColumn("field_id", F.lit(1))
    fields = spark.createDataFrame([(1, " Notes ", "text"), (2, "Notes", "progress"), (3, "Other", "text")], "field_id int, name string, field_type string")
    return R.notes_backfill(p, fields, v, spark.createDataFrame([], "key string"))
