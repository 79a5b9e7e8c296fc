"""Library exports in RDF: whole files as rows of elements, then items and collections by joins on them.

A file that is no well-formed RDF has no elements, hence no items.
"""

from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.fields import html_text
from scriptoria.functions.text import bare_letters
from scriptoria.operators.batches import exploded
from scriptoria.operators.graph import paths
from scriptoria.session import checkpoint_folder

ELEMENTS = "id int, parent int, top int, under string, tag string, about string, resource string, text string, value string"
#: Elements that are no items, and the entry types of item types and of elements.
STRUCTURE = "Collection Attachment Memo Note Journal Series Periodical Person Organization Seq Bag Alt li".split()
ITEM_TYPES = {
    "journalArticle": "article", "magazineArticle": "article", "newspaperArticle": "article", "preprint": "unpublished", "book": "book", "bookSection": "incollection", "document": "misc",
    "conferencePaper": "inproceedings", "thesis": "phdthesis", "report": "techreport", "manuscript": "unpublished", "webpage": "online", "blogPost": "online",
}
ELEMENT_TYPES = {
    "Article": "article", "Book": "book", "Document": "misc", "BookSection": "incollection", "Thesis": "phdthesis", "ConferenceProceedings": "inproceedings", "Report": "techreport", "Manuscript": "unpublished",
}
FIELDS = "title date itemType abstract publisher doi dateSubmitted surname givenName name value type".split()


def _elements(text: str | None) -> list[tuple]:
    """Elements in document order by local names; ``top`` is the element under the root that each is or lies in, ``under`` the
    name of the one below that."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    local = lambda name: name.rsplit("}", 1)[-1] if isinstance(name, str) else ""
    if local(root.tag) != "RDF":
        return []
    own = lambda e: (e.text or "").strip()
    out: list[tuple] = []
    waiting = [(e, 0, 0, "") for e in reversed(root)]
    while waiting:
        e, parent, top, under = waiting.pop()
        at = len(out) + 1
        top, under = (at, "") if parent == 0 else (top, under or local(e.tag))
        attributes = {local(k): v.strip() for k, v in reversed(e.attrib.items())}
        within = (own(s) for s in e.iter() if s is not e and local(s.tag) in ("value", "name", "title"))
        value = own(e) or next(filter(None, within), "")
        out.append((at, parent, top, under, local(e.tag), attributes.get("about", ""), attributes.get("resource", ""), own(e), value))
        waiting += [(c, at, top, under) for c in reversed(e)]
    return out


def elements(files: DataFrame) -> DataFrame:
    """A row an element. files: file, text (whole). Written once, since items and collections join it to itself."""
    checkpoint_folder(files.sparkSession)
    return exploded(files.select("file", F.col("text").alias("whole")), "whole", _elements, ELEMENTS).checkpoint()


def _ident(c: Column | str) -> Column:
    return F.trim(F.ltrim(F.col(c) if isinstance(c, str) else c, F.lit("#")))


def _fields(e: DataFrame) -> DataFrame:
    """file, owner, and of each field the first child's value."""
    first = lambda n: F.coalesce(F.min_by("value", F.when((F.col("tag") == n) & (F.col("value") != ""), F.col("id"))), F.lit("")).alias(n)
    return e.filter("parent > 0").groupBy("file", F.col("parent").alias("owner")).agg(*map(first, FIELDS))


def _targets(e: DataFrame) -> DataFrame:
    """file, key, target, target_tag: what an identifier names, the first element in the document."""
    named = e.select("file", _ident("about").alias("key"), "id", "tag").filter("key <> ''")
    return named.groupBy("file", "key").agg(F.min("id").alias("target"), F.min_by("tag", "id").alias("target_tag"))


def _owned(e: DataFrame, refs: DataFrame, nested: DataFrame, tags: list[str]) -> DataFrame:
    """file, top, rank, node: elements of ``tags`` that top-level elements point at, then those nested in them."""
    linked = refs.select("file", "top", _ident("resource").alias("key"), F.col("id").alias("at")).filter("key <> ''").join(_targets(e), ["file", "key"])
    linked = linked.filter(F.col("target_tag").isin(tags)).select("file", "top", F.struct(F.lit(0).alias("way"), "at").alias("rank"), F.col("target").alias("node"))
    inside = nested.filter(F.col("tag").isin(tags) & (F.col("id") != F.col("top")))
    return linked.unionByName(inside.select("file", "top", F.struct(F.lit(1).alias("way"), F.col("id").alias("at")).alias("rank"), F.col("id").alias("node")))


def _listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """file, top, name: values in order of rank, each once; a list is that of one item."""
    g = rows.select("file", "top", "rank", value.alias("v")).filter("v <> ''").groupBy("file", "top")
    return g.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda s: s["v"])).alias(name))


def items(e: DataFrame) -> DataFrame:
    """file, id, about, key, entry_type, title, authors, year, doi, isbn, abstract, journal, publisher, tags, notes, date_added
    of ``elements``. Items have no key of their own: it is the first family name and the year, repeats numbered from 2."""
    f = _fields(e)
    with_fields = lambda rows, on: rows.join(f.withColumnRenamed("owner", on), ["file", on], "left").na.fill("", FIELDS)
    containers = e.filter("tag = 'isPartOf'").select("file", _ident("resource").alias("ident"), F.lit(True).alias("container")).distinct()
    tops = with_fields(e.filter((F.col("parent") == 0) & (F.col("about") != "") & ~F.col("tag").isin(STRUCTURE)).drop("value", "parent", "under", "resource", "text", "top"), "id")
    tops = tops.withColumn("ident", _ident("about")).join(containers, ["file", "ident"], "left")
    tops = tops.filter("itemType <> '' or (title <> '' and container is null)")

    of_authors = e.filter("under = 'authors'")
    persons = with_fields(_owned(e, of_authors, of_authors, ["Person"]), "node")
    whole = F.concat_ws(", ", F.nullif("surname", F.lit("")), F.nullif("givenName", F.lit("")))
    authors = _listed(persons, F.coalesce(F.nullif(whole, F.lit("")), F.col("name")), "authors")

    direct = e.filter("parent = top and parent > 0")
    memos = with_fields(_owned(e, direct.filter("tag = 'isReferencedBy'"), e, ["Memo", "Note"]), "node")
    memos = memos.join(e.select("file", F.col("id").alias("node"), F.col("value").alias("whole")), ["file", "node"])
    lines = F.transform(F.split(html_text(F.coalesce(F.nullif("value", F.lit("")), F.col("whole"))), "\n"), lambda x: F.trim(x))
    notes = _listed(memos, F.array_join(F.filter(lines, lambda x: x != ""), "\n"), "notes")

    ranked = lambda rows, way: rows.withColumn("rank", F.struct("at", F.lit(way).alias("way"), F.col("node").alias("sub")))
    part = direct.filter("tag = 'isPartOf'").select("file", "top", F.col("id").alias("at"), "text", _ident("resource").alias("key"))
    below = part.join(e.select("file", F.col("parent").alias("at"), F.col("id").alias("node")), ["file", "at"])
    beside = part.join(_targets(e).withColumnRenamed("target", "node"), ["file", "key"])
    titled = [ranked(with_fields(rows, "node"), way).select("file", "top", "rank", F.col("title").alias("v")) for way, rows in enumerate((below, beside))]
    titled.append(ranked(part.withColumn("node", F.lit(0)), 2).select("file", "top", "rank", F.col("text").alias("v")))
    journals = titled[0].unionByName(titled[1]).unionByName(titled[2]).filter("v <> ''").groupBy("file", "top").agg(F.min_by("v", "rank").alias("journal"))

    by_place = lambda tag: direct.filter(F.col("tag") == tag).withColumn("rank", F.col("id"))
    tags = _listed(by_place("subject"), F.col("value"), "tags")
    identifiers = _listed(by_place("identifier"), F.col("value"), "identifiers")

    t = tops.withColumnRenamed("id", "top")
    for extra in (authors, notes, journals, tags, identifiers):
        t = t.join(extra, ["file", "top"], "left")
    none = F.array().cast("array<string>")
    t = t.withColumns({n: F.coalesce(n, none) for n in ("authors", "notes", "tags", "identifiers")})
    bare = lambda c: F.rtrim(F.regexp_replace(F.trim(c), r"(?i)^.*?doi\.org/", ""), F.lit("."))

    def prefixed(p: str) -> Column:
        rest = F.filter(F.transform(F.filter("identifiers", lambda v: F.startswith(F.lower(v), F.lit(p))), lambda v: F.trim(F.ltrim(F.substring(v, len(p) + 1, 1 << 30), F.lit(" :")))), lambda v: v != "")
        return F.coalesce(F.get(rest, F.lit(0)), F.lit(""))

    from_about = F.when(F.lower("ident").contains("doi.org/"), bare(F.col("ident")))
    doi = F.coalesce(F.nullif(bare(F.col("doi")), F.lit("")), F.nullif(bare(prefixed("doi")), F.lit("")), from_about, F.lit(""))
    lookup = lambda table, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    year = F.regexp_extract("date", r"(\d{4})", 1)
    family = F.regexp_replace(bare_letters(F.lower(F.split(F.coalesce(F.get("authors", F.lit(0)), F.lit("")), ",")[0])), "[^a-z0-9]", "")
    of_about = F.trim(F.substring(F.regexp_replace("ident", "[^A-Za-z0-9_]", "_"), 1, 40), F.lit("_"))
    base = F.when(family != "", F.concat(family, year)).otherwise(F.coalesce(F.nullif(of_about, F.lit("")), F.lit("zotero")))
    t = t.withColumns({"base": base, "year": year.try_cast("int"), "doi": doi, "isbn": prefixed("isbn"), "entry_type": F.coalesce(lookup(ITEM_TYPES, F.col("itemType")), lookup(ELEMENT_TYPES, F.col("tag")), F.lit("misc"))})
    n = F.row_number().over(Window.partitionBy("file", "base").orderBy("top"))
    return t.select(
        "file", F.col("top").alias("id"), F.col("ident").alias("about"), F.concat("base", F.when(n > 1, n.cast("string")).otherwise("")).alias("key"), "entry_type", "title", F.array_join("authors", "; ").alias("authors"),
        "year", "doi", "isbn", "abstract", F.coalesce("journal", F.lit("")).alias("journal"), "publisher", "tags", F.array_join("notes", "\n\n").alias("notes"), F.nullif("dateSubmitted", F.lit("")).alias("date_added"),
    )


def collection_paths(e: DataFrame) -> DataFrame:
    """file, item (its identifier), path, place: the collections of each item, names from the outermost in, numbered in
    document order. A collection without a title adds nothing to a path; one that contains itself is left out."""
    f = _fields(e).select("file", F.col("owner").alias("id"), F.col("title").alias("name"))
    ident = F.coalesce(F.nullif(_ident("about"), F.lit("")), F.concat(F.lit("collection:"), F.col("id").cast("string")))
    own = e.filter("tag = 'Collection'").select("file", "id", ident.alias("cid")).join(f, ["file", "id"], "left")
    own = own.groupBy("file", "cid").agg(F.min("id").alias("id"), F.coalesce(F.max_by("name", "id"), F.lit("")).alias("name"))
    child = e.filter("parent > 0").groupBy("file", F.col("parent").alias("at")).agg(F.min_by(F.when(F.col("tag") == "Collection", ident).otherwise(_ident("about")), "id").alias("nested"))
    parts = e.filter("tag = 'hasPart'").select("file", F.col("id").alias("at"), F.col("parent").alias("id"), _ident("resource").alias("ref")).join(child, ["file", "at"], "left")
    holders = e.filter("tag = 'Collection'").select("file", "id", ident.alias("cid"))
    members = parts.join(holders, ["file", "id"]).select("file", "cid", "at", F.coalesce(F.nullif("ref", F.lit("")), F.col("nested"), F.lit("")).alias("ref")).filter("ref <> ''")
    up = members.join(own.select("file", F.col("cid").alias("ref")), ["file", "ref"]).groupBy("file", F.col("ref").alias("cid")).agg(F.max_by("cid", "at").alias("above"))
    whole = lambda c: F.concat_ws("\n", "file", c)
    tree = own.join(up, ["file", "cid"], "left").select(whole("cid").alias("id"), "name", F.when(F.col("above").isNotNull(), whole("above")).alias("parent"))
    full = paths(tree).select("id", F.filter("path", lambda p: F.trim(p) != "").alias("path")).filter(F.size("path") > 0)
    items_in = members.join(own.select("file", F.col("cid").alias("ref")), ["file", "ref"], "left_anti")
    found = items_in.select("file", F.col("ref").alias("item"), whole("cid").alias("id"), "at").join(full, "id")
    found = found.groupBy("file", "item", "path").agg(F.min("at").alias("at"))
    return found.select("file", "item", "path", F.row_number().over(Window.partitionBy("file", "item").orderBy("at")).alias("place"))
