"""Expressions for DOIs, ISBNs, arXiv numbers, years, keys and partial dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns by which identifiers are recognised, in the order they are tried.
DOI_PREFIX = r"^(https?://([a-z]+\.)*doi\.org/|doi\.org/|doi:)\s*"
DOI_PATTERNS = (r"(?i)(?:doi[:\s]*)(10\.\d{4,}/[^\s]+)", r"(?i)https?://(?:dx\.)?doi\.org/(10\.\d{4,}/[^\s]+)", r"(10\.\d{4,}/[^\s,;]+)")
LABELLED_DOI = r'(?i)(?:https?://(?:dx\.)?doi\.org/|\bdoi[:\s]\s*)(10\.\d{4,9}/[^\s"<>]+)'
REFERENCE_HEADING = r"(?i)\n\s*(?:\d+\.?\s*)?(?:references|bibliography|literature cited|works cited|literatur(?:verzeichnis)?|quellenverzeichnis)\s*\n"
ISBN_PATTERNS = (r"(?i)ISBN[-:\s]*((?:97[89][-\s]?\d[-\s]?\d{2,4}[-\s]?\d{2,6}[-\s]?\d))", r"(?i)ISBN[-:\s]*([\d-]{10,17})")
ARXIV_PATTERNS = (
    r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)", r"(?i)arXiv[:\s]+(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"(?i)arxiv\.org/(?:abs|pdf)/([\w.-]+/\d{7}(?:v\d+)?)", r"(?i)arXiv[:\s]+([\w.-]+/\d{7}(?:v\d+)?)",
)
XMP_DOI = r'(?i)<(?:prism:doi|crossmark:DOI|pdfx:doi)>\s*(?:doi:|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[^\s"<>]+)\s*<'
ANY_DOI = r'10\.\d{4,9}/[^\s"<>]+'
YEAR = r"\b(19[9]\d|20[0-2]\d)\b"
ISO_DATE = r"^(\d{4})(?:[-/.](\d{1,2})(?:[-/.](\d{1,2}))?)?[-/.]*(?:[T ].*)?$"


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def doi_key(doi: Column) -> Column:
    """Lower case, without resolver or label, without final dots."""
    return F.rtrim(F.regexp_replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), DOI_PREFIX, ""), F.lit("."))


def doi_trimmed(doi: Column, most: int = 24) -> Column:
    """Without final punctuation and final brackets that nothing opens; one character a step."""

    def step(s: Column, _: Column) -> Column:
        last = F.substring(s, -1, 1)
        count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c)))
        loose = F.lit(False)
        for opener, closer in ("()", "[]", "{}"):
            loose = loose | ((last == closer) & (count(closer) > count(opener)))
        return F.when(last.isin(*".,;:'") | loose, F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), doi, step)


def doi_in_text(text: Column, longest: int = 3000) -> Column:
    return F.nullif(doi_trimmed(first_match(F.substring(text, 1, longest), DOI_PATTERNS)), F.lit(""))


def labelled_doi(text: Column, longest: int = 12_000) -> Column:
    """The first DOI that is named as one, before the reference heading."""
    head = F.get(F.split(F.substring(text, 1, longest), REFERENCE_HEADING, 2), F.lit(0))
    return F.nullif(doi_trimmed(first_match(head, (LABELLED_DOI,))), F.lit(""))


def metadata_doi(xmp: Column, *fields: Column) -> Column:
    """The DOI that a file's own metadata names: in the packet's DOI elements, else in the first of the fields that has one; else null."""
    tagged = F.regexp_extract(F.coalesce(xmp, F.lit("")), XMP_DOI, 1)
    found = [doi_trimmed(tagged), *[doi_trimmed(F.regexp_extract(F.coalesce(f, F.lit("")), ANY_DOI, 0)) for f in fields]]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def isbn_in_text(text: Column) -> Column:
    return F.translate(first_match(text, ISBN_PATTERNS), "- ", "")


def arxiv_in_text(text: Column) -> Column:
    return first_match(text, ARXIV_PATTERNS)


def arxiv_doi(arxiv_id: Column) -> Column:
    return F.concat(F.lit("10.48550/arXiv."), F.regexp_replace(arxiv_id, r"(?i)v\d+$", ""))


def key_base(authors: Column, year: Column) -> Column:
    """First author up to the comma, letters and digits only, then the year or XXXX."""
    first = F.when(F.coalesce(authors, F.lit("")) == "", F.lit("Unknown")).otherwise(F.trim(F.get(F.split(authors, ","), F.lit(0))))
    return F.concat(F.regexp_replace(first, r"[^\p{L}\p{N}_]", ""), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("XXXX")))


def key_suffix(n: Column) -> Column:
    """0 -> '', 1 -> a, 26 -> z, 27 -> aa: bijective base 26, of any length."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(a: Column, _: Column) -> Column:
        below = a["left"] - 1
        letter = F.chr(F.lit(97) + (below % 26).cast("int"))
        return F.when(a["left"] <= 0, a).otherwise(F.struct(F.floor(below / 26).cast("long").alias("left"), F.concat(letter, a["out"]).alias("out")))

    # fourteen letters number more than 2**63 keys
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"])


def suffix_number(letters: Column) -> Column:
    """The number that ``key_suffix`` writes so: '' -> 0, a -> 1, z -> 26, aa -> 27."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + F.ascii(c) - 96)


def partial_date(text: Column) -> Column:
    """An ISO date as precise as given; '' for anything else and for days that don't exist."""
    t = F.trim(F.coalesce(text, F.lit("")))
    y, m, d = (F.regexp_extract(t, ISO_DATE, k) for k in (1, 2, 3))
    month, day = F.lpad(m, 2, "0"), F.lpad(d, 2, "0")
    whole = F.concat_ws("-", y, month, day)
    return (
        F.when((y == "") | ((m != "") & ~month.between("01", "12")), F.lit(""))
        .when(m == "", y)
        .when(d == "", F.concat_ws("-", y, month))
        .when(F.try_to_date(whole, "yyyy-MM-dd").isNull(), F.lit(""))
        .otherwise(whole)
    )


def year_number(text: Column) -> Column:
    """The first four characters as a positive year, else null."""
    n = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 4).try_cast("int")
    return F.when(n > 0, n)
