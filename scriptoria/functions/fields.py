"""Small expressions on record fields: cells, tags, names of files, pages, colours, dates, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import bare_letters

#: Names of months and their short forms, English and German.
MONTHS = {
    1: "jan january januar jänner jaenner", 2: "feb february februar", 3: "mar march mär märz maer maerz", 4: "apr april", 5: "may mai", 6: "jun june juni", 7: "jul july juli",
    8: "aug august", 9: "sep sept september", 10: "oct october okt oktober", 11: "nov november", 12: "dec december dez dezember",
}
#: Titles that word processors give, and file names.
NO_TITLE = r"(?i)^(untitled|microsoft word|document\d*)\b|\.(pdf|docx?|tex|indd)$"
#: Author and year in front of a title in a file's name, in the order they are tried.
NAME_PREFIXES = (r"^.{0,80}?\s[-–]\s(?:19|20)\d{2}\s[-–]\s", r"^(?:19|20)\d{2}[_\-\s]+", r"^[A-Za-zÀ-ÿ'\.\- ]{2,40}[_\-\s]+(?:19|20)\d{2}[_\-\s]+")


def month_number(text: Column) -> Column:
    """1 to 12 of a number or a whole month name, else null."""
    t = F.lower(F.trim(F.coalesce(text, F.lit("")), F.lit("{} .")))
    names = F.create_map(*[F.lit(x) for k, words in MONTHS.items() for w in words.split() for x in (w, k)])
    number = t.try_cast("int")
    return F.when(t.rlike("^[0-9]+$"), F.when(number.between(1, 12), number)).otherwise(F.try_element_at(names, t))


def metadata_title(title: Column) -> Column:
    """A file's own title if it reads like one: ten characters, two words, no file name and no placeholder; else ''."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.when((F.length(t) < 10) | ~t.rlike(r"\S\s+\S") | t.rlike(NO_TITLE), "").otherwise(t)


def safe_basename(text: Column, fallback: str = "library", longest: int = 80) -> Column:
    """An ASCII file stem: marks dropped, other characters than word characters, dots and dashes as one underscore."""
    t = F.regexp_replace(bare_letters(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))), r"[^\x00-\x7F]", "")
    stem = F.trim(F.regexp_replace(F.trim(t, F.lit(" \t\n\x0b\f\r")), r"[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.substring(stem, 1, longest), F.lit("")), F.lit(fallback))


def file_title(path: Column) -> Column:
    """A title guessed from a file's path: extension, author and year in front, copy numbers and separators go; a
    prefix goes only if ten characters stay."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"^.*/", ""), r"(?<=[^.])\.[^.]*$", "")
    tried = [F.regexp_replace(stem, p, "") for p in NAME_PREFIXES]
    bare = F.coalesce(*[F.when((t != stem) & (F.length(t) >= 10), t) for t in tried], stem)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s*\(\d+\)$", ""), r"[_\-]+", " "), r"\s+", " "))


def keyword_tags(text: Column) -> Column:
    """Parts between semicolons and commas, without braces, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: F.trim(F.trim(F.trim(p), F.lit("{}"))))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def group_paths(text: Column) -> Column:
    """Paths of a groups field: groups between semicolons and commas, levels between slashes; each once, in order."""
    levels = lambda g: F.filter(F.transform(F.split(g, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), levels), lambda p: F.size(p) > 0))


def collection_name(path: Column) -> Column:
    """A nested collection as the name of a flat one."""
    return F.array_join(F.filter(F.transform(path, lambda p: F.trim(p)), lambda p: p != ""), " / ")


def same_value(field: str, a: Column, b: Column) -> Column:
    """Whether two values of a field say the same: case, blanks, dashes, resolvers and final dots aside; of lists of
    numbers one in common is enough. ``authors`` are compared as people, however parted."""
    from scriptoria.functions.people import joined, people

    text = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    if field in ("isbn", "issn"):
        numbers = lambda c: F.filter(F.transform(F.split(F.upper(text(c)), r"[,;\s]+"), lambda p: F.regexp_replace(p, "[^0-9X]", "")), lambda p: p != "")
        return F.arrays_overlap(numbers(a), numbers(b))
    key = {
        "year": lambda c: F.nullif(F.substring(text(c), 1, 4).try_cast("int"), F.lit(0)),
        "authors": lambda c: F.lower(joined(people(c))),
        "editors": lambda c: F.lower(joined(people(c))),
        "doi": lambda c: F.lower(F.regexp_replace(text(c), r"(?i)^https?://(dx\.)?doi\.org/", "")),
        "pages": lambda c: F.regexp_replace(text(c), r"\s*(?:--|[\u2010-\u2015\u2212-])\s*", "-"),
        "url": lambda c: F.rtrim(text(c), F.lit("/")),
    }.get(field, lambda c: F.rtrim(F.lower(text(c)), F.lit(" .")))
    return key(a).eqNullSafe(key(b))


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive number: strokes, gathered, then the subtractive pairs."""
    out = F.repeat(F.lit("i"), n)
    for many, one in (("iiiii", "v"), ("vv", "x"), ("xxxxx", "l"), ("ll", "c"), ("ccccc", "d"), ("dd", "m"), ("viiii", "ix"), ("iiii", "iv"), ("lxxxx", "xc"), ("xxxx", "xl"), ("dcccc", "cm"), ("cccc", "cd")):
        out = F.replace(out, F.lit(many), F.lit(one))
    return out


def label_number(n: Column, style: Column) -> Column:
    """The number of a page label: D decimal, r R roman, a A letters (a to z, then aa to zz); other styles have none."""
    letters = F.repeat(F.chr(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
    small = F.when(F.lower(style) == "r", roman(n)).when(F.lower(style) == "a", letters)
    return F.when(style == "D", n.cast("string")).when((n < 1) | small.isNull(), "").when(style.isin("R", "A"), F.upper(small)).otherwise(small)


def printed_page(page: Column, label: Column, pages: Column, count: Column) -> Column:
    """The page's own label, else its place in the record's range if that is as long as the file, else null."""
    bound = lambda k: F.regexp_extract(F.coalesce(pages, F.lit("")), r"^\s*(\d+)\s*(?:-{1,2}|–|—)\s*(\d+)\s*$", k).try_cast("long")
    fits = (bound(2) - bound(1) + 1 == count) & (page <= count)
    return F.when(page >= 1, F.coalesce(F.nullif(F.trim(label), F.lit("")), F.when(fits, (bound(1) + page - 1).cast("string"))))


def csv_cell(text: Column) -> Column:
    """A spreadsheet must not run a cell: one that begins like a formula (not with a minus) gets an apostrophe."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(r"^[=+@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)


def percent(n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(n, F.lit(0))))


def tex(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in "&%_#":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def tags(text: Column) -> Column:
    """A JSON list, or parts between semicolons and commas; stripped, each once, in order."""
    listed = F.from_json(text, "array<string>")
    parts = F.coalesce(F.when(F.startswith(F.trim(text), F.lit("[")), listed), F.split(F.coalesce(text, F.lit("")), "[;,]"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def file_name(authors: Column, year: Column, title: Column) -> Column:
    """year_author_title.pdf: the first author's letters and digits, the title's first five words; a word of hyphens counts, but
    hyphens and marks go."""
    known = F.coalesce(authors, F.lit(""))
    first = F.when(known == "", "Unknown").otherwise(F.regexp_replace(F.get(F.split(known, ","), F.lit(0)), r"[^\p{L}\p{N}_]", ""))
    words = F.filter(F.split(F.regexp_replace(F.coalesce(title, F.lit("Untitled")), r"[^\p{L}\p{N}_\s-]", ""), r"\s+"), lambda w: w != "")
    short = F.regexp_replace(F.array_join(F.slice(words, 1, 5), "_"), "-", "")
    return F.concat(F.concat_ws("_", F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("XXXX")), first, short), F.lit(".pdf"))


def page_range(pages: Column) -> Column:
    return F.regexp_replace(pages, r"\s*[-–—]+\s*", "--")


def html_text(html: Column) -> Column:
    """Without scripts, styles and tags; block tags end lines, and the common entities are read."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</?(p|br|div|li|h[1-6]|tr)\b[^>]*>", "\n"), "<[^>]*>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.trim(F.regexp_replace(t, r"[ \t]*\n\s*", "\n"))


def json_field(text: Column, *names: str) -> Column:
    """The first of the named members that is there."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def colour(parts: Column) -> Column:
    """#rrggbb of grey, RGB or CMYK parts from 0 to 1; null for anything else."""
    hex2 = lambda v: F.lower(F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0"))
    at = lambda k: F.get(parts, F.lit(k))
    rgb = lambda r, g, b: F.concat(F.lit("#"), hex2(r), hex2(g), hex2(b))
    ink = lambda k: (1 - at(k)) * (1 - at(3))
    return F.when(F.size(parts) == 1, rgb(at(0), at(0), at(0))).when(F.size(parts) == 3, rgb(at(0), at(1), at(2))).when(F.size(parts) == 4, rgb(ink(0), ink(1), ink(2)))


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDD[HHmmSS[zone]] as ISO, as precise as given; null for anything else."""
    p = r"^D?:?(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}'?\d{2}'?)?)?$"
    part = lambda k: F.regexp_extract(text, p, k)
    day = F.concat_ws("-", part(1), part(2), part(3))
    zone = F.regexp_replace(F.replace(part(7), F.lit("'"), F.lit("")), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(~text.rlike(p), None).when(part(4) == "", day).otherwise(F.concat(day, F.lit("T"), F.concat_ws(":", part(4), part(5), part(6)), zone))


def cited_keys(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key: keys of the cite commands outside comments, each once; the star of \\nocite is none."""
    clean = F.regexp_replace(F.col(text_col), r"(?m)(?<!\\)%.*$", "")
    found = F.regexp_extract_all(clean, F.lit(r"\\[a-zA-Z]*cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    keys = rows.select(F.col(id_col).alias("id"), F.explode(F.flatten(F.transform(found, lambda x: F.split(x, ",")))).alias("key"))
    return keys.select("id", F.trim("key").alias("key")).filter("key <> '' and key <> '*'").distinct()


def title_guesses(text: Column, lines: int = 15, most: int = 3) -> Column:
    """The first lines of ten characters or more that are no boilerplate: no DOI, link or address, a third of digits at most."""
    head = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines), lambda x: F.trim(x))
    good = lambda x: (F.length(x) >= 10) & ~x.rlike(r"(?i)doi|https?:|@") & (3 * F.length(F.regexp_replace(x, "[^0-9]", "")) <= F.length(x))
    return F.slice(F.filter(head, good), 1, most)
