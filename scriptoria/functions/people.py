"""Lists of people: "Family, Given; Family, Given", organisations in braces. One small parser a string, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PEOPLE = "array<struct<last:string,given:string,org:boolean>>"
#: Words that belong to the family name behind them.
PARTICLES = "van von der den de del della di da du la le zu zum zur ter ten dos das".split()
#: Words, endings and legal forms of organisations.
ORGANISATION_WORDS = (
    r"consortium|organi[sz]ation|group|gruppe|arbeitsgruppe|arbeitskreis|institute?|universit(?:y|ät|aet|é|at)|universidad|association|society|"
    r"gesellschaft|committee|komitee|collaboration|team|network|netzwerk|council|agency|foundation|stiftung|ministry|ministerium|department|"
    r"centre|center|zentrum|laborator(?:y|ies)|company|corporation|inc|ltd|gmbh|verband|verein|commission|kommission|academy|akademie|alliance|"
    r"federation|initiative|project|bundesamt|programme|program|nations|office|authority|administration|bureau|board|bundes\w+|"
    r"\w*(?:ministerium|amt|anstalt|verband|verwaltung|behörde|gesellschaft|institut|zentrum|stiftung|agentur)"
)
LEGAL_FORMS = r"AG|SE|KG|GmbH|e\.\s?V\.|LLC|plc|Ltd\.?"
#: A person's name has so many words at most, particles aside.
MOST_WORDS = 4

_ORGANISATION = re.compile(rf"(?<!\w)(?:(?i:{ORGANISATION_WORDS})|{LEGAL_FORMS})(?!\w)")
_INITIALS = re.compile(r"[^\W\d_]|[^\W\d_]\.(?:-?[^\W\d_]\.)*")
_BRACED = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")


def _cut(text: str, separator: str) -> list[str]:
    """Parts of ``text`` between separators outside braces: what braces hold is covered up while looking for them."""
    covered, depth = [], 0
    for c in text:
        depth = max(depth - (c == "}"), 0)
        covered.append("\0" if depth or c in "{}" else c)
        depth += c == "{"
    edges = [0, *[e for m in re.finditer(separator, "".join(covered)) for e in m.span()], len(text)]
    return [" ".join(text[a:b].split()) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def is_organisation(name: str) -> bool:
    """In braces always; with a comma never; else by its words, or if it has more words than a person's name."""
    if _BRACED.fullmatch(name):
        return True
    if not name or "," in name:
        return False
    return bool(_ORGANISATION.search(name)) or sum(w.lower() not in PARTICLES for w in name.split()) > MOST_WORDS


def _is_given(part: str) -> bool:
    """Capitalised words, few enough for a name, that are no organisation: they may follow "Family,"."""
    words = part.split()
    return 0 < len(words) <= MOST_WORDS and not _BRACED.fullmatch(part) and not _ORGANISATION.search(part) and all(w[0].isupper() for w in words)


def _is_family(part: str) -> bool:
    return not _BRACED.fullmatch(part) and (" " not in part or not is_organisation(part))


def _is_whole_name(part: str) -> bool:
    """"Given Family": several words, no particle in front, no initials at the end."""
    words = part.split()
    return len(words) > 1 and words[0].lower() not in PARTICLES and not _INITIALS.fullmatch(words[-1])


def split_people(text: str | None) -> list[str]:
    """Names in order: parted by semicolons, else by "and" unless that stands in an organisation's own name, else by commas.

    Between commas a family name takes the part behind it as its given names, from left to right; only an odd
    number of "Given Family" names, three or more, are names of their own. Braces hold together what is in them.
    """
    t = " ".join((text or "").split())
    for separator in (";", r"\s+and\s+"):
        parts = [p for p in _cut(t, separator) if p]
        if len(parts) > 1:
            own = separator != ";" and not set(t) & set(",{") and is_organisation(t) and any(map(is_organisation, parts))
            return [t] if own else parts
    parts = [p for p in _cut(t, ",") if p]
    people = [p for p in parts if not is_organisation(p)]
    if len(people) > 2 and len(people) % 2 and all(map(_is_whole_name, people)):
        return parts
    found: list[str] = []
    waiting = False  # whether the last name may still take given names
    for p in parts:
        if waiting and _is_given(p):
            found[-1] += f", {p}"
            waiting = False
        else:
            found.append(p)
            waiting = _is_family(p)
    return found


def parse_person(name: str) -> tuple[str, str, bool]:
    """Family name, given names, whether it is an organisation (then all of it is the first)."""
    if is_organisation(name):
        return (name[1:-1].strip() if _BRACED.fullmatch(name) else name), "", True
    if "," in name:
        last, given = name.split(",", 1)
        return last.strip(), given.strip(), False
    words = name.split()
    family = len(words) - 1
    while family > 1 and words[family - 1].lower() in PARTICLES:
        family -= 1
    return " ".join(words[family:]), " ".join(words[:max(family, 0)]), False


def people(text: Column) -> Column:
    @F.pandas_udf(PEOPLE)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("last", "given", "org"), parse_person(p), strict=True)) for p in split_people(t)])

    return parsed(text)


def split_holders(text: str | None) -> list[tuple[str, str, bool]]:
    """Names between semicolons only, since commas and "and" belong to firms; a word of organisations makes one of a name with a comma too."""
    parts = [p for p in _cut(" ".join((text or "").split()), ";") if p]
    firm = lambda p: not _BRACED.fullmatch(p) and _ORGANISATION.search(p)
    return [(p, "", True) if firm(p) else parse_person(p) for p in parts]


def holders(text: Column) -> Column:
    @F.pandas_udf(PEOPLE)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("last", "given", "org"), h, strict=True)) for h in split_holders(t)])

    return parsed(text)


def joined(found: Column) -> Column:
    """Back to one string."""
    one = lambda p: F.when(p["org"], F.concat(F.lit("{"), p["last"], F.lit("}"))).when(p["given"] == "", p["last"]).otherwise(F.concat(p["last"], F.lit(", "), p["given"]))
    return F.array_join(F.transform(found, one), "; ")


def last_names(found: Column) -> Column:
    return F.transform(found, lambda p: p["last"])


def reads_as_organisation(name: Column) -> Column:
    """``is_organisation`` as a column expression."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: (w != "") & ~w.isin(*PARTICLES))
    marked = name.rlike(rf"(?U)(?<!\w)(?:(?iu:{ORGANISATION_WORDS})|{LEGAL_FORMS})(?!\w)")
    return name.rlike(r"^\{.*\}$") | (~name.contains(",") & (name != "") & (marked | (F.size(words) > MOST_WORDS)))
