"""Records of bibliographic services, as JSON text, to the columns of the library. Nothing here asks a network."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions import people as P
from scriptoria.functions.fields import month_number

#: Item types by the services' own types.
CROSSREF_TYPES = {
    "journal-article": "article", "book": "book", "monograph": "book", "edited-book": "book", "reference-book": "book", "book-chapter": "chapter", "book-section": "chapter",
    "book-part": "chapter", "reference-entry": "chapter", "proceedings-article": "conference", "dissertation": "thesis", "report": "report", "report-component": "report",
    "posted-content": "preprint", "dataset": "dataset", "standard": "standard",
}
DATACITE_TYPES = {
    "dataset": "dataset", "software": "software", "computationalnotebook": "software", "preprint": "preprint", "journalarticle": "article", "book": "book", "bookchapter": "chapter",
    "conferencepaper": "conference", "dissertation": "thesis", "report": "report", "standard": "standard",
}
#: Dates of a message in order of precedence; titles that name a series; links that repeat the DOI.
DATES = ("published-print", "published-online", "issued", "published")
SERIES = r"(?i)lecture notes|notes in |\bseries\b|studies in |communications in |springer proceedings"
DOI_LINK = r"(?i)^https?://(dx\.)?doi\.org/"

_NAMES = "array<struct<family:string,given:string,name:string>>"
CROSSREF = (
    "title array<string>, `type` string, author " + _NAMES + ", editor " + _NAMES + ", `container-title` array<string>, publisher string, ISBN array<string>, ISSN array<string>, "
    "`issn-type` array<struct<`type`:string,value:string>>, volume string, issue string, page string, abstract string, URL string, language string, `edition-number` string, `publisher-location` string, "
    "event struct<name:string>, institution array<struct<name:string>>, `standards-body` array<struct<name:string>>, degree array<string>, "
    + ", ".join(f"`{d}` struct<`date-parts`:array<array<string>>>" for d in DATES)
)
_PEOPLE = "array<struct<name:string,nameType:string,familyName:string,givenName:string,contributorType:string>>"
DATACITE = (
    f"attributes struct<doi:string,publicationYear:string,types:struct<resourceTypeGeneral:string>,titles:array<struct<title:string,titleType:string>>,creators:{_PEOPLE},contributors:{_PEOPLE},"
    "publisher:string,descriptions:array<struct<description:string,descriptionType:string>>,dates:array<struct<date:string,dateType:string>>,"
    "identifiers:array<struct<identifier:string,identifierType:string>>,container:struct<title:string>,version:string,url:string,language:string>"
)
_NAMED = "array<struct<name:string>>"
OPENLIBRARY = f"title string, subtitle string, authors {_NAMED}, publishers {_NAMED}, publish_places {_NAMED}, series array<string>, publish_date string, edition_name string, identifiers struct<isbn_13:array<string>,isbn_10:array<string>>"


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def without_markup(text: Column) -> Column:
    """Tags out, entities read, one space between words."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return spaced(read(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")))


def _first(values: Column) -> Column:
    """The first that is not blank, else ''."""
    return F.coalesce(F.get(F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""), F.lit(0)), F.lit(""))


def _of(values: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(""))


def _joined(names: Column) -> Column:
    return F.coalesce(F.array_join(F.filter(names, lambda n: n != ""), "; "), F.lit(""))


def _braced(name: Column) -> Column:
    return F.when(name == "", "").otherwise(F.concat(F.lit("{"), name, F.lit("}")))


def _comma(family: Column, given: Column) -> Column:
    return F.concat_ws(", ", F.nullif(family, F.lit("")), F.nullif(given, F.lit("")))


def _numbers(date: Column) -> Column:
    """The leading whole numbers of a date's first list of parts."""
    n = F.transform(F.coalesce(F.get(date["date-parts"], F.lit(0)), F.array().cast("array<string>")), lambda p: p.try_cast("int"))
    bad = F.array_position(F.transform(n, lambda x: x.isNull()), True)
    return F.slice(n, F.lit(1), F.when(bad > 0, bad.cast("int") - 1).otherwise(F.size(n)))


def crossref(messages: DataFrame) -> DataFrame:
    """doi and the columns of a record; '' for what is not there, a null year. messages: doi, message (JSON; unreadable: empty)."""
    m = messages.withColumn("m", F.from_json("message", CROSSREF))
    c = lambda name: F.col("m")[name]
    people = lambda e: _joined(F.transform(e, lambda p: F.coalesce(F.nullif(_comma(spaced(p["family"]), spaced(p["given"])), F.lit("")), _braced(spaced(p["name"])))))
    parts = F.coalesce(*[F.when(F.size(_numbers(c(d))) > 0, _numbers(c(d))) for d in DATES], F.array().cast("array<int>"))
    m = m.withColumns({"item_type": _of(CROSSREF_TYPES, F.lower(F.coalesce(c("type"), F.lit("")))), "parts": parts})
    # an array goes through the markup reader as one text, its members parted by a character that titles do not hold
    books = F.filter(F.split(F.array_join(F.transform(F.coalesce(c("container-title"), F.array().cast("array<string>")), lambda t: spaced(t)), "\x01"), "\x01"), lambda t: t != "")
    m = m.withColumn("books", F.filter(F.split(without_markup(F.array_join(books, "\x01")), "\\s*\x01\\s*"), lambda t: t != ""))
    at = lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    series, plain = F.filter("books", lambda t: t.rlike(SERIES)), F.filter("books", lambda t: ~t.rlike(SERIES))
    inside, whole = F.col("item_type").isin("chapter", "conference"), F.col("item_type").isin("book", "report")
    typed = lambda kind: at(F.transform(F.filter(c("issn-type"), lambda t: t["type"] == kind), lambda t: F.trim(t["value"])))
    degree, url = _first(c("degree")), F.trim(F.coalesce(c("URL"), F.lit("")))
    some = lambda x: F.nullif(x, F.lit(""))
    return m.select(
        "doi", "item_type", without_markup(_first(c("title"))).alias("title"), people(c("author")).alias("authors"), people(c("editor")).alias("editors"), F.get("parts", F.lit(0)).alias("year"),
        F.when(F.size("parts") > 1, I.partial_date(F.array_join(F.slice("parts", 1, 3).cast("array<string>"), "-"))).otherwise("").alias("pub_date"),
        F.regexp_replace(without_markup(c("abstract")), r"(?i)^abstract\s*[:.]?\s+", "").alias("abstract"),
        F.when(inside | whole, "").otherwise(at("books")).alias("journal"), F.when(inside, F.coalesce(some(at(plain)), at("books"))).otherwise("").alias("booktitle"),
        F.when(whole, at("books")).when(inside & (F.size(plain) > 0), at(series)).otherwise("").alias("series"),
        spaced(c("publisher")).alias("publisher"), F.coalesce(F.array_join(c("ISBN"), ", "), F.lit("")).alias("isbn"), F.coalesce(some(typed("print")), some(typed("electronic")), _first(c("ISSN"))).alias("issn"),
        *[F.trim(F.coalesce(c(a), F.lit(""))).alias(b) for a, b in (("volume", "volume"), ("issue", "issue"), ("page", "pages"), ("edition-number", "edition"), ("publisher-location", "place"), ("language", "language"))],
        without_markup(c("event")["name"]).alias("event"),
        F.when(F.col("item_type").isin("thesis", "report", "standard"), F.coalesce(some(_first(c("institution")["name"])), _first(c("standards-body")["name"]))).otherwise("").alias("institution"),
        F.when(F.col("item_type") != "thesis", "").when(degree.rlike(r"(?i)ph\.?\s?d|doctor|dr\."), "phdthesis").when(degree.rlike(r"(?i)master|m\.?\s?sc|m\.?\s?a\b"), "mastersthesis").otherwise(degree).alias("thesis_type"),
        F.when(url.rlike(DOI_LINK), "").otherwise(url).alias("url"),
    )


def datacite(messages: DataFrame) -> DataFrame:
    """doi and the columns of a record, as ``crossref``. messages: doi, message."""
    m = messages.withColumn("m", F.from_json("message", DATACITE)["attributes"])
    c = lambda name: F.col("m")[name]

    def name(p: Column) -> Column:
        whole, kind = spaced(p["name"]), F.lower(spaced(p["nameType"]))
        family, given = spaced(p["familyName"]), spaced(p["givenName"])
        named = F.when((kind != "personal") & P.reads_as_organisation(whole), _braced(whole)).otherwise(whole)
        return F.when((kind == "organizational") & (whole != ""), _braced(whole)).when((family != "") & (given != ""), _comma(family, given)).when(whole != "", named).otherwise(_comma(family, given))

    titles = F.filter(c("titles"), lambda t: spaced(t["title"]) != "")
    main = F.filter(titles, lambda t: F.coalesce(t["titleType"], F.lit("")) == "")
    year = F.nullif(c("publicationYear").try_cast("int"), F.lit(0))
    date = lambda kind: I.partial_date(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(c("dates"), lambda d: F.lower(d["dateType"]) == kind), lambda d: d["date"])), -1))
    usable = lambda d: F.when((F.length(d) > 4) & (year.isNull() | (I.year_number(d) == year)), d)
    doi = F.coalesce(F.nullif(spaced(c("doi")), F.lit("")), F.col("doi"))
    own = _first(F.transform(F.filter(c("identifiers"), lambda i: F.lower(i["identifierType"]) == "arxiv"), lambda i: F.regexp_replace(spaced(i["identifier"]), "(?i)^arxiv:", "")))
    eprint = F.coalesce(F.nullif(own, F.lit("")), F.regexp_extract(F.coalesce(doi, F.lit("")), r"(?i)^10\.48550/arxiv\.(.+)$", 1))
    by_type = _of(DATACITE_TYPES, F.lower(spaced(c("types")["resourceTypeGeneral"])))
    kind = F.when((by_type == "") & (eprint != ""), "preprint").otherwise(by_type)
    publisher = F.when(F.startswith(F.trim(c("publisher")), F.lit("{")), F.get_json_object(c("publisher"), "$.name")).otherwise(c("publisher"))
    abstract = _first(F.transform(F.filter(c("descriptions"), lambda d: F.lower(d["descriptionType"]) == "abstract"), lambda d: spaced(F.regexp_replace(d["description"], "<[^>]+>", " "))))
    return m.select(
        doi.alias("doi"), kind.alias("item_type"), spaced(F.get(F.when(F.size(main) > 0, main).otherwise(titles), F.lit(0))["title"]).alias("title"),
        _joined(F.transform(c("creators"), name)).alias("authors"), _joined(F.transform(F.filter(c("contributors"), lambda p: F.lower(p["contributorType"]) == "editor"), name)).alias("editors"),
        year.alias("year"), F.coalesce(usable(date("issued")), usable(date("available")), F.lit("")).alias("pub_date"), spaced(publisher).alias("publisher"), abstract.alias("abstract"),
        F.when(kind == "article", spaced(c("container")["title"])).otherwise("").alias("journal"), *[spaced(c(n)).alias(n) for n in ("version", "url", "language")], eprint.alias("eprint"),
    )


def publish_date(text: Column) -> tuple[Column, Column]:
    """Year, and the ISO date where more than the year is known: "July 2009", "Sep 15, 2009", "2009-07-31"; a day that is none is left out."""
    t = spaced(text)
    year = F.regexp_extract(t, r"\b(1[5-9]\d\d|20\d\d)\b", 1)
    iso = lambda k: F.regexp_extract(t, r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", k)
    named = F.get(F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-zÄÖÜäöü]+\.?"), F.lit(0)), month_number), lambda m: m.isNotNull()), F.lit(0))
    month = F.when(iso(2) != "", iso(2).try_cast("int")).otherwise(named)
    # the year's own digits are no day
    day = F.when(iso(2) != "", iso(3)).otherwise(F.regexp_extract(F.replace(t, year, F.lit("")), r"\b([0-3]?\d)\b(?!\d)", 1)).try_cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    precise = I.partial_date(F.concat_ws("-", year, two(month), F.when(day > 0, two(day))))
    date = F.when((year == "") | month.isNull() | ~month.between(1, 12), "").otherwise(F.coalesce(F.nullif(precise, F.lit("")), F.concat_ws("-", year, two(month))))
    return year.try_cast("int"), date


def edition(text: Column) -> Column:
    """"3rd ed." -> 3; a named edition as it is."""
    t = spaced(text)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)^(\d+)\s*(?:st|nd|rd|th|\.)?\s*(?:ed|edition|aufl|auflage)\b", 1), F.lit("")), t)


def openlibrary(messages: DataFrame) -> DataFrame:
    """isbn and the columns of a book. messages: isbn, message."""
    m = messages.withColumn("m", F.from_json("message", OPENLIBRARY))
    c = lambda name: F.col("m")[name]
    title, subtitle = spaced(c("title")), spaced(c("subtitle"))
    year, date = publish_date(c("publish_date"))
    return m.select(
        F.coalesce(F.nullif(_first(F.concat(F.coalesce(c("identifiers")["isbn_13"], F.array().cast("array<string>")), F.coalesce(c("identifiers")["isbn_10"], F.array().cast("array<string>")))), F.lit("")), F.col("isbn")).alias("isbn"),
        F.lit("book").alias("item_type"), F.when((title != "") & (subtitle != ""), F.concat(title, F.lit(": "), subtitle)).otherwise(title).alias("title"),
        P.joined(P.people(F.coalesce(F.array_join(F.transform(c("authors")["name"], spaced), ";"), F.lit("")))).alias("authors"), _first(c("publishers")["name"]).alias("publisher"), _first(c("publish_places")["name"]).alias("place"),
        year.alias("year"), date.alias("pub_date"), edition(c("edition_name")).alias("edition"), _first(c("series")).alias("series"),
    )


def abstract_of_index(index: Column) -> Column:
    """The text of an inverted index (JSON: word to its places); null gives ''. Where two words claim a place both stay."""
    places = F.flatten(F.transform(F.map_entries(F.from_json(index, "map<string,array<int>>")), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda s: s["w"]), " "), F.lit(""))


def enrich(papers: DataFrame, works: DataFrame, fields: list[str]) -> DataFrame:
    """``papers`` with empty ``fields`` filled from the work of their DOI; what is stored stays. works: doi, fields; the first in order of its fields where a DOI has several."""
    one = works.select(I.doi_key(F.col("doi")).alias("k"), *[F.coalesce(f, F.lit("")).alias(f"new_{f}") for f in fields]).filter("k <> ''")
    one = one.groupBy("k").agg(F.min(F.struct(*[f"new_{f}" for f in fields])).alias("n"))
    found = papers.withColumn("k", I.doi_key(F.col("doi"))).join(one, "k", "left")
    return found.withColumns({f: F.coalesce(F.nullif(F.trim(f), F.lit("")), F.col("n")[f"new_{f}"], F.lit("")) for f in fields}).drop("k", "n")
