"""The types of bibliographic items: what each needs, what it is called in either dialect, and a type for items without one."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptoria.functions.identifiers import year_number


class ItemType(NamedTuple):
    required: str  # a|b: either one
    biblatex: str
    bibtex: str


#: The item types, their required fields in order and their entry types.
ITEM_TYPES = {
    "article": ItemType("authors title journal year volume pages", "article", "article"),
    "book": ItemType("authors|editors title publisher year", "book", "book"),
    "chapter": ItemType("authors title booktitle publisher year pages", "incollection", "incollection"),
    "conference": ItemType("authors title booktitle year", "inproceedings", "inproceedings"),
    "thesis": ItemType("authors title thesis_type institution year", "thesis", "phdthesis"),
    "report": ItemType("authors|institution title institution year", "report", "techreport"),
    "preprint": ItemType("authors title year eprint|doi|url", "online", "misc"),
    "webpage": ItemType("title url accessed", "online", "misc"),
    "standard": ItemType("title number institution year", "techreport", "techreport"),
    "patent": ItemType("authors title number year", "patent", "misc"),
    "dataset": ItemType("authors title publisher year doi|url", "dataset", "misc"),
    "software": ItemType("authors title year doi|url", "software", "misc"),
    "misc": ItemType("title", "misc", "misc"),
}


def plain(c: Column) -> Column:
    """As a string without blanks around it; null is empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")), F.lit(" \t\n\x0b\f\r"))


def filled(field: str) -> Column:
    """A list of people must name somebody; a year may come from the date; 0 is no year."""
    if field == "year":
        return year_number(F.col("year").cast("string")).isNotNull() | (plain(F.col("pub_date")) != "")
    if field in ("authors", "editors"):
        return F.regexp_replace(plain(F.col(field)), r"[\s,;]+", "") != ""
    return plain(F.col(field)) != ""


def effective_type() -> Column:
    """The stored ``item_type`` if it is one of the table, else what the filled columns say."""
    stored, has = plain(F.col("item_type")), lambda n: plain(F.col(n)) != ""
    return (
        F.when(stored.isin(*ITEM_TYPES), stored)
        .when(has("thesis_type"), "thesis")
        .when(has("booktitle"), F.when(has("editors") | has("isbn"), "chapter").otherwise("conference"))
        .when(has("journal"), "article")
        .when(has("isbn") & has("publisher"), "book")
        .otherwise("misc")
    )


def missing_fields() -> Column:
    """Required fields of the item's type that are empty, in the table's order; an either-or group by its first field."""
    kind = effective_type()

    def lacks(group: str) -> Column:
        some = F.lit(False)
        for name in group.split("|"):
            some = some | filled(name)
        return F.when(~some, group.split("|")[0])

    by_type = [F.when(kind == t, F.array_compact(F.array(*map(lacks, row.required.split())))) for t, row in ITEM_TYPES.items()]
    return F.coalesce(*by_type)
