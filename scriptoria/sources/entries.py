"""Items of any type as biblatex or BibTeX entries, one text a row; all but the parting of names are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.identifiers import partial_date, year_number
from scriptoria.functions.item_types import ITEM_TYPES, effective_type, filled, plain
from scriptoria.functions.people import holders, people

COLUMNS = (
    "cite_key item_type title authors editors year doi isbn abstract journal publisher volume issue pages pub_date booktitle edition place "
    "series issn url accessed institution thesis_type number event version language eprint note_bib tags"
).split()
#: Characters and their LaTeX, replaced one after the other.
LATEX = (
    ("\\", r"\textbackslash{}"), ("{", r"\{"), ("}", r"\}"), ("&", r"\&"), ("%", r"\%"), ("#", r"\#"), ("_", r"\_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"),
    ("ä", r'{\"a}'), ("ö", r'{\"o}'), ("ü", r'{\"u}'), ("Ä", r'{\"A}'), ("Ö", r'{\"O}'), ("Ü", r'{\"U}'), ("ß", r"{\ss}"),
)
#: Thesis types below a doctorate, arXiv numbers, thesis types that are keys, month macros, wording.
MASTERS = r"(?i)master|mathesis|magister|diplom|bachelor|\bm\.?\s?(?:a|sc|eng)\b"
ARXIV = r"(?i)^(?:arxiv:)?(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)$"
THESIS_KEYS = {"phdthesis": "phdthesis", "mastersthesis": "mathesis", "mathesis": "mathesis"}
MONTH_MACROS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LABELS = {"standard": "Standard", "patent": "Patent {number}", "accessed": "Accessed {date}", "version": "Version {version}"}


def latex(text: Column) -> Column:
    for character, code in LATEX:
        text = F.replace(text, F.lit(character), F.lit(code))
    return text


def names_field(found: Column) -> Column:
    """Persons as "Family, Given", organisations in braces, between them "and"."""

    def one(p: Column) -> Column:
        last, given = p["last"], p["given"]
        return F.when(p["org"], F.concat(F.lit("{"), latex(last), F.lit("}"))).otherwise(latex(F.when(given == "", last).otherwise(F.concat(last, F.lit(", "), given))))

    return F.array_join(F.filter(F.transform(found, one), lambda n: n != ""), " and ")


def keywords(tags: Column) -> Column:
    """The members of a JSON list; anything else is one keyword."""
    listed = F.filter(F.transform(F.from_json(tags, "array<string>"), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.when(F.startswith(tags, F.lit("[")), F.array_join(listed, ", ")), tags)


def _or(*options: Column) -> Column:
    """The first that is not empty, else ''."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def entries(items: DataFrame, dialect: str = "biblatex", labels: dict[str, str] | None = None) -> DataFrame:
    """All columns and ``entry``. Of ``COLUMNS`` those that ``items`` lacks, and nulls, are empty; empty fields are left out."""
    if dialect not in ("biblatex", "bibtex"):
        raise ValueError(f"no dialect {dialect!r}")
    classic, words = dialect == "bibtex", LABELS | (labels or {})
    lacking = {n: F.lit("") for n in COLUMNS if n not in items.columns}
    t = items.withColumns(lacking) if lacking else items
    t = t.withColumns({"_kind": effective_type(), "_authors": people(F.when(filled("authors"), F.col("authors"))), "_editors": people(F.when(filled("editors"), F.col("editors"))), "_holders": holders(F.col("institution"))})
    kind, get = F.col("_kind"), lambda n: plain(F.col(n))
    none = F.lit("")
    inside = kind.isin("chapter", "conference")
    journal, booktitle = F.when(inside, none).otherwise(get("journal")), F.when(inside, _or(get("booktitle"), get("journal"))).otherwise(get("booktitle"))
    number = F.when(kind == "article", _or(get("issue"), get("number"))).otherwise(_or(get("number"), get("issue")))
    stored_date = partial_date(F.col("pub_date"))
    year = _or(year_number(get("year")).cast("string"), F.substring(stored_date, 1, 4))
    date = F.when(F.substring(stored_date, 1, 4) == year, stored_date).otherwise(none)  # of another year: the year wins

    thesis_type = get("thesis_type")
    key = F.try_element_at(F.create_map(*[F.lit(x) for kv in THESIS_KEYS.items() for x in kv]), F.lower(thesis_type))
    label = F.when((kind == "thesis") & key.isNotNull(), none if classic else key).when(kind == "standard", _or(thesis_type, F.lit(words["standard"]))).when(kind.isin("thesis", "report"), thesis_type).otherwise(none)
    institution = latex(get("institution"))
    if not classic:
        institution = F.when(kind == "patent", names_field(F.col("_holders"))).otherwise(institution)
    held_by = F.when(kind == "thesis", "school").when(kind.isin("report", "standard"), "institution")
    if not classic:
        held_by = held_by.when(kind == "patent", "holder")

    table = F.create_map(*[F.lit(x) for k, row in ITEM_TYPES.items() for x in (k, row.bibtex if classic else row.biblatex)])
    entry_type = F.element_at(table, kind)
    if classic:
        entry_type = F.when((kind == "thesis") & thesis_type.rlike(MASTERS), "mastersthesis").otherwise(entry_type)
    else:
        entry_type = F.when((kind == "report") & (thesis_type == ""), "techreport").otherwise(entry_type)

    eprint = get("eprint")
    arxiv = F.regexp_extract(eprint, ARXIV, 1)
    on_arxiv = (eprint != "") & ((arxiv != "") | F.startswith(F.lower(get("doi")), F.lit("10.48550/")))
    url, accessed, version = get("url"), partial_date(F.col("accessed")), get("version")
    filled_in = lambda name, what, c: F.when(c != "", F.replace(F.lit(words[name]), F.lit("{" + what + "}"), c))
    notes = [F.nullif(get("note_bib"), none)]
    how, plain_url = none, url
    if classic:
        notes += [filled_in("accessed", "date", accessed), filled_in("version", "version", version)]
        as_misc = kind.isin(*[k for k, row in ITEM_TYPES.items() if row.bibtex == "misc" and k != "misc"])
        of_patent = F.when(kind == "patent", latex(filled_in("patent", "number", number)))
        how = F.when(as_misc, F.coalesce(of_patent, F.when(url != "", F.concat(F.lit("\\url{"), url, F.lit("}"))), none)).otherwise(none)
        plain_url = F.when(as_misc & of_patent.isNull(), none).otherwise(url)

    month = F.coalesce(F.get(F.array(*map(F.lit, MONTH_MACROS)), F.substring(date, 6, 2).try_cast("int") - 1), none)
    dated = F.length(date) > 4
    fields: list[tuple[str | Column, Column]] = [
        ("author", names_field(F.col("_authors"))), ("editor", names_field(F.col("_editors"))), ("title", latex(get("title"))), ("journal", latex(journal)), ("booktitle", latex(booktitle)),
        ("eventtitle", none if classic else latex(get("event"))), ("edition", latex(get("edition"))), ("volume", latex(get("volume"))), ("number", latex(number)), ("series", latex(get("series"))),
        ("pages", latex(F.regexp_replace(get("pages"), r"\s*(?:-+|–|—)\s*", "--"))), ("type", latex(label)), (F.coalesce(held_by, F.lit("organization")), institution),
        ("publisher", latex(get("publisher"))), ("address", latex(get("place"))), *([("year", year), ("month", month)] if classic else [(F.when(dated, "date").otherwise("year"), F.when(dated, date).otherwise(year))]),
        ("isbn", get("isbn")), ("issn", get("issn")), ("doi", get("doi")), ("eprint", _or(arxiv, eprint)), ("archiveprefix", F.when(on_arxiv, "arXiv").otherwise(none)) if classic else ("eprinttype", F.when(on_arxiv, "arxiv").otherwise(none)),
        ("howpublished", how), ("url", plain_url), *([] if classic else [("urldate", accessed), ("version", latex(version))]),
        ("language", latex(get("language"))), ("note", latex(F.array_join(F.array_compact(F.array(*notes)), "; "))), ("keywords", latex(keywords(get("tags")))), ("abstract", latex(F.substring(get("abstract"), 1, 2000))),
    ]

    def line(name: str | Column, value: Column) -> Column:
        named = F.lit(name) if isinstance(name, str) else name
        braced = value if isinstance(name, str) and name == "month" else F.concat(F.lit("{"), value, F.lit("}"))
        return F.when(value != "", F.concat(F.lit("  "), named, F.lit(" = "), braced, F.lit(",")))

    head = F.concat(F.lit("@"), entry_type, F.lit("{"), get("cite_key"), F.lit(","))
    entry = F.concat_ws("\n", head, *[line(n, v) for n, v in fields], F.lit("}"))
    return t.withColumn("entry", entry).drop("_kind", "_authors", "_editors", "_holders", *lacking)
