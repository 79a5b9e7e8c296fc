"""BibTeX and RIS: readers over whole files, writers of one text a record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.functions.fields import page_range, tex
from scriptoria.functions.people import joined, people
from scriptoria.sources.record_files import bibtex_entries

def parse_bibtex(files: DataFrame) -> DataFrame:
    """file, key, entry_type, title, authors, year, doi, venue, fields. files: file, text (whole)."""

    @F.pandas_udf("array<struct<entry_type:string,key:string,fields:map<string,string>>>")
    def entries(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(bibtex_entries(t)))

    return bibtex_columns(files.select("file", F.explode(entries("text")).alias("e")).select("file", "e.*"))


def bibtex_columns(e: DataFrame) -> DataFrame:
    """file, key, entry_type, title, authors, year, doi, venue, fields of entries (file, key, entry_type, fields)."""
    get = lambda *names: F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names], F.lit(""))
    year = F.substring(get("year", "date"), 1, 4).try_cast("int")
    return e.select("file", "key", "entry_type", get("title").alias("title"), joined(people(get("author"))).alias("authors"), year.alias("year"), F.lower(get("doi")).alias("doi"), get("journal", "journaltitle", "booktitle").alias("venue"), "fields")


def parse_ris(files: DataFrame) -> DataFrame:
    """file, record, type, tags (map of arrays): TY opens a record, ER ends it, other lines continue the last tag.

    Lines are numbered in their file; records and continued tags are running counts of a window, no Python."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    tagged = lines.withColumns({"tag": F.regexp_extract("line", r"^([A-Z][A-Z0-9])  ?-", 1), "value": F.trim(F.regexp_replace("line", r"^[A-Z][A-Z0-9]  ?-", ""))})
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumns({"record": F.sum((F.col("tag") == "TY").cast("int")).over(w), "ended": F.sum((F.col("tag") == "ER").cast("int")).over(w), "item": F.sum((F.col("tag") != "").cast("int")).over(w)})
    inside = tagged.filter("record > ended and record > 0")
    joined_lines = inside.groupBy("file", "record", "item").agg(F.max("tag").alias("tag"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), lambda v: v != ""), " ").alias("value"))
    by_tag = joined_lines.filter("value <> ''").groupBy("file", "record", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "value"))), lambda s: s["value"]).alias("values"))
    g = by_tag.groupBy("file", "record").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("tags"))
    return g.select("file", "record", F.get(F.try_element_at("tags", F.lit("TY")), F.lit(0)).alias("type"), "tags")


#: Tags of a RIS record by column, the first that is there counts.
RIS_TAGS = {"title": ("TI", "T1", "CT", "BT"), "authors": ("AU", "A1", "A2", "A3", "A4"), "year": ("PY", "Y1", "DA"), "journal": ("JO", "JF", "JA", "T2"), "abstract": ("AB", "N2"), "doi": ("DO",), "publisher": ("PB",), "isbn": ("SN",)}


def ris_items(records: DataFrame) -> DataFrame:
    """Records of ``parse_ris`` with a title, as columns; other holds the tags that no column covers. Authors are of all
    author tags, in the order of tags; the year is the first run of four digits."""
    none = F.array().cast("array<string>")
    values = lambda tags: F.concat(*[F.coalesce(F.try_element_at("tags", F.lit(t)), none) for t in tags])
    first = lambda n: F.coalesce(F.get(F.filter(values(RIS_TAGS[n]), lambda v: v != ""), F.lit(0)), F.lit(""))
    years = F.filter(F.transform(values(RIS_TAGS["year"]), lambda v: F.regexp_extract(v, r"(\d{4})", 1)), lambda y: y != "")
    known = [t for tags in RIS_TAGS.values() for t in tags] + ["TY", "ER"]
    plain = [first(n).alias(n) for n in ("journal", "abstract", "doi", "publisher", "isbn")]
    out = records.select("file", "record", "type", first("title").alias("title"), values(RIS_TAGS["authors"]).alias("authors"), F.get(years, F.lit(0)).cast("int").alias("year"), *plain, F.map_filter("tags", lambda k, _: ~k.isin(*known)).alias("other"))
    return out.filter("title <> ''")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, text: whole files of a folder, searched recursively."""
    t = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    return t.select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, size, file_hash of the files of a folder."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return b.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"))


def ris_text(papers: DataFrame) -> DataFrame:
    """id, ris: always a journal record, one AU a person, the year as "2001///". papers: id, title, authors, year, venue, doi."""
    line = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c))
    authors = F.array_join(F.transform(F.filter(F.transform(F.split("authors", ";"), lambda a: F.trim(a)), lambda a: a != ""), lambda a: F.concat(F.lit("AU  - "), a)), "\n")
    parts = F.array(F.lit("TY  - JOUR"), F.nullif(authors, F.lit("")), line("TI", F.col("title")), F.when(F.col("year") > 0, F.concat(F.lit("PY  - "), F.col("year").cast("string"), F.lit("///"))), line("JO", F.col("venue")), line("DO", F.col("doi")), F.lit("ER  - "))
    return papers.select("id", F.concat_ws("\n", parts).alias("ris"))


def bibtex_text(papers: DataFrame, entry_type: Column | str = "article") -> DataFrame:
    """id, bibtex. papers: id, key, title, authors, year, venue, doi, and pages where there are any."""
    kind = F.lit(entry_type) if isinstance(entry_type, str) else entry_type
    field = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), c, F.lit("}")))
    fields = [field("author", F.replace("authors", F.lit("; "), F.lit(" and "))), field("title", tex(F.col("title"))), field("journal", tex(F.col("venue"))), field("year", F.nullif("year", F.lit(0)).cast("string")), field("doi", F.col("doi"))]
    if "pages" in papers.columns:
        fields.append(field("pages", page_range(F.col("pages"))))
    body = F.array_join(F.array_compact(F.array(*fields)), ",\n")
    return papers.select("id", F.concat(F.lit("@"), kind, F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("\n}")).alias("bibtex"))


def archive_names(papers: DataFrame) -> DataFrame:
    """id, member: file names of an archive, case-insensitive repeats numbered from 2 in order of id."""
    stem = F.regexp_replace("filename", r"\.pdf$", "")
    n = F.row_number().over(Window.partitionBy(F.lower(stem)).orderBy("id"))
    return papers.filter("filename <> ''").select("id", F.concat(stem, F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(".pdf")).alias("member"))
