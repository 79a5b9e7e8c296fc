"""Entries, item types, RDF exports and snapshots against values written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.functions import item_types as Y
from scriptoria.functions.people import split_holders
from scriptoria.operators import reconcile as R
from scriptoria.session import checkpoint_folder
from scriptoria.sources import attachments as A
from scriptoria.sources import entries as E
from scriptoria.sources import rdf, snapshot


def items(spark, *rows):
    schema = ", ".join(f"{n} string" for n in E.COLUMNS)
    return spark.createDataFrame([tuple(r.get(n) for n in E.COLUMNS) for r in rows], schema)


def test_types_and_gaps(spark):
    rows = items(
        spark, {"item_type": "poem", "journal": "J", "year": "0", "pub_date": "2001-02"}, {"thesis_type": "x", "journal": "J"}, {"booktitle": "B"}, {"booktitle": "B", "isbn": "1"},
        {"isbn": "1", "publisher": "P", "editors": "Roe, R.", "title": "T", "year": "1999"}, {"item_type": "report", "institution": "I"}, {"item_type": "preprint", "url": "u"}, {},
    )
    got = [(r[0], list(r[1])) for r in rows.select(Y.effective_type(), Y.missing_fields()).collect()]
    assert got == [
        ("article", ["authors", "title", "volume", "pages"]), ("thesis", ["authors", "title", "institution", "year"]), ("conference", ["authors", "title", "year"]),
        ("chapter", ["authors", "title", "publisher", "year", "pages"]), ("book", []), ("report", ["title", "year"]), ("preprint", ["authors", "title", "year"]), ("misc", ["title"]),
    ]


def test_entry_dialects(spark):
    patent = {"cite_key": "p", "item_type": "patent", "title": "50 % {x}", "authors": "Hans Mahler", "institution": "Stahl AG; Mahler, Hans", "number": "EP 1", "url": "http://u", "year": "2001", "pub_date": "2001-03-04"}
    bare = {"item_type": "webpage", "title": None, "url": "http://u", "tags": "one, two", "abstract": "a" * 3000}
    rows = items(spark, patent, bare)
    new, old = ([r.entry for r in E.entries(rows, d).collect()] for d in ("biblatex", "bibtex"))
    assert new[0] == "@patent{p,\n  author = {Mahler, Hans},\n  title = {50 \\% \\{x\\}},\n  number = {EP 1},\n  holder = {{Stahl AG} and Mahler, Hans},\n  date = {2001-03-04},\n  url = {http://u},\n}"
    assert old[0] == "@misc{p,\n  author = {Mahler, Hans},\n  title = {50 \\% \\{x\\}},\n  number = {EP 1},\n  organization = {Stahl AG; Mahler, Hans},\n  year = {2001},\n  month = mar,\n  howpublished = {Patent EP 1},\n  url = {http://u},\n}"
    assert new[1] == "@online{,\n  url = {http://u},\n  keywords = {one, two},\n  abstract = {" + "a" * 2000 + "},\n}"
    assert old[1] == "@misc{,\n  howpublished = {\\url{http://u}},\n  keywords = {one, two},\n  abstract = {" + "a" * 2000 + "},\n}"


def test_entry_of_few_columns(spark):
    rows = spark.createDataFrame([("k", "T")], "cite_key string, title string")
    got = E.entries(rows)
    assert got.columns == ["cite_key", "title", "entry"] and got.first().entry == "@misc{k,\n  title = {T},\n}"


def test_holders():
    assert split_holders("{A; B}; Stahl, Werk GmbH; Hans Mahler; ") == [("A; B", "", True), ("Stahl, Werk GmbH", "", True), ("Mahler", "Hans", False)]
    assert split_holders(None) == []


def elements(spark, *bodies):
    head = '<RDF xmlns:rdf="r">'
    return rdf.elements(spark.createDataFrame([(f"f{k}", b and f"{head}{b}</RDF>") for k, b in enumerate(bodies)], "file string, text string"))


def test_rdf_keys_links_and_containers(spark):
    body = (
        '<Book rdf:about="#a"><authors><Seq><li rdf:resource="#p"/><li><Person><name>WHO</name></Person></li></Seq></authors><title>One</title><date>1999</date></Book>'
        '<Book rdf:about="#b"><authors><li rdf:resource="#p"/></authors><title>Two</title><date>1999-04</date><isPartOf><Series><title>S</title></Series></isPartOf></Book>'
        '<Person rdf:about="#p"><surname>Díaz</surname><givenName>E.</givenName></Person><Book rdf:about="#c"><title>Host</title></Book>'
        '<BookSection rdf:about="#d"><title>In</title><isPartOf rdf:resource="#c"/><isReferencedBy><Note><value>n</value></Note></isReferencedBy></BookSection><Book><title>no about</title></Book>'
    )
    got = [tuple(r) for r in rdf.items(elements(spark, body, "<a>", None, "")).orderBy("id").select("key", "entry_type", "title", "authors", "year", "journal", "notes").collect()]
    assert got == [("diaz1999", "book", "One", "Díaz, E.; WHO", 1999, "", ""), ("diaz19992", "book", "Two", "Díaz, E.", 1999, "S", ""), ("d", "incollection", "In", "", None, "Host", "n")]


def test_rdf_collections_nested_and_cyclic(spark):
    body = (
        '<Collection rdf:about="#1"><title>A</title><hasPart><Collection><title> </title><hasPart rdf:resource="#x"/><hasPart><Book rdf:about="#y"/></hasPart></Collection></hasPart></Collection>'
        '<Collection rdf:about="#2"><title>B</title><hasPart rdf:resource="#3"/><hasPart rdf:resource="#x"/></Collection><Collection rdf:about="#3"><title>C</title><hasPart rdf:resource="#2"/></Collection><Collection rdf:about="#4"><title>D</title><hasPart rdf:resource="#x"/></Collection>'
    )
    got = rdf.collection_paths(elements(spark, body)).orderBy("item", "place").collect()
    assert [(r.item, list(r.path), r.place) for r in got] == [("x", ["A"], 1), ("x", ["D"], 2), ("y", ["A"], 1)]


def test_snapshot_notices_a_change(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.write({"a": spark.range(10), "b": spark.range(0)}, folder)
    checkpoint_folder(spark)
    kept = snapshot.manifest(spark, folder, ["a", "b"]).checkpoint()
    assert {r["name"]: (r["items"], r.intact) for r in snapshot.verify(kept, snapshot.manifest(spark, folder, ["a", "b"])).collect()} == {"a": (10, True), "b": (0, True)}
    spark.range(1).select(F.col("id")).write.mode("append").parquet(f"{folder}/a")
    assert [r.intact for r in snapshot.verify(kept, snapshot.manifest(spark, folder, ["a", "b"])).orderBy("name").collect()] == [False, True]


def test_attachment_readings():
    assert A.candidates("Name:C\\:/x.pdf:PDF")[:2] == ["C\\:/x.pdf", "C:/x.pdf"]
    assert A.candidates(r"N:Q\\:\\\\a.pdf:PDF")[2] == r"Q:\a.pdf"
    assert A.candidates("file:///C:/a%20b.pdf") == ["C:/a b.pdf"] and A.candidates("file:///a.pdf") == ["/a.pdf"]
    assert A.candidates("a:b") == ["b", "a", "a:b"] and A.candidates("x.pdf") == ["x.pdf"] and A.candidates(" ") == []


def test_attachments_resolved(spark):
    fields = spark.createDataFrame([(1, r"D\;x:a\;b.pdf:PDF; ../l/a;b.pdf;gone.pdf", "/l"), (2, None, "/l"), (3, "", None)], "id long, field string, base string")
    got = A.resolve(fields, spark.createDataFrame([("/l/a;b.pdf",), ("/l/b.pdf",)], "path string")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(1, 1, r"D\;x:a\;b.pdf:PDF", "/l/a;b.pdf"), (1, 2, "../l/a", None), (1, 3, "b.pdf", "/l/b.pdf"), (1, 4, "gone.pdf", None)]


def test_notes_move_once_and_never_by_guess(spark):
    p = spark.createDataFrame([(1, "a"), (2, None)], "id long, notes string")
    one = spark.createDataFrame([(7, "Notiz", "text"), (8, "Notes", "choice")], "field_id int, name string, field_type string")
    v = spark.createDataFrame([(1, 7, " b "), (2, 7, " "), (2, 8, "x")], "paper_id long, field_id int, value string")
    fresh, done = spark.createDataFrame([], "key string"), spark.createDataFrame([("k",)], "key string")
    notes = lambda f, d: [r.notes for r in R.notes_backfill(p, f, v, d).orderBy("id").collect()]
    assert notes(one, fresh) == ["a\n\nb", None]
    assert notes(one, done) == notes(one.withColumn("field_type", F.lit("text")), fresh) == ["a", None]
