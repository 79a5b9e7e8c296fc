"""Which references of a document its body cites: by number, by author and year, by author alone, or by title.

The last names and the title phrases of a block of references are one automaton; a body passes through it once,
and only where a name is met is the text around it looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: References of one automaton.
BLOCK = 512
#: Rows of a batch that is given on.
ROWS = 8192
#: A number list in brackets, and what a range in it looks like.
NUMBERS, RANGE = re.compile(r"\[(\d[\d,\s\-–]+)\]"), re.compile(r"(\d+)\s*[-–]\s*(\d+)")
#: Distinct numbers from which on a body counts as numbered, and the longest range that is read.
LEAST_NUMBERS, LONGEST_RANGE = 3, 100
#: How often a name may stand in a body and still be a citation without a year.
MOST_NAMES = 50
#: Words before a name that make it a citation.
BEFORE = ("vgl", "vgl.", "see", "s.", "nach", "laut", "gemaess")


def last_names(people: Column) -> Column:
    """Last names in order: what stands before a comma, else the last word; of letters, hyphens and blanks, two at least."""
    parts = F.split(F.coalesce(people, F.lit("")), r"\s*;\s*|\s+and\s+|\s+und\s+|\s*&\s*")
    last = lambda p: F.when(F.contains(p, F.lit(",")), F.get(F.split(p, ","), F.lit(0))).otherwise(F.element_at(F.split(F.trim(p), r"\s+"), -1))
    names = F.transform(parts, lambda p: F.trim(F.regexp_replace(last(p), r"[^a-zA-ZäöüÄÖÜß\- ]", "")))
    return F.filter(names, lambda n: F.length(n) >= 2)


def phrases(title: Column) -> Column:
    """Runs of three words of three letters or more, or of four if the title has more than six; of titles over 15 characters."""
    title = F.trim(F.coalesce(title, F.lit("")))
    # words are a value of a lambda, so that a title is split once and not for each run
    split = F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) >= 3)
    none = F.array().cast("array<string>")

    def runs(words: Column) -> Column:
        width = F.when(F.size(words) <= 6, 3).otherwise(4)
        some = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
        return F.when(F.size(words) >= width, some).otherwise(none)

    return F.when(F.length(title) > 15, F.get(F.transform(F.array(split), runs), F.lit(0))).otherwise(none)


def cited_numbers(body: str) -> set[int]:
    found: set[int] = set()
    for m in NUMBERS.finditer(body):
        for part in re.split(r"[,;]\s*", m.group(1)):
            part = part.strip()
            if both := RANGE.match(part):
                first, last = int(both[1]), int(both[2])
                found.update(range(first, min(last + 1, first + LONGEST_RANGE)))
            elif part.isdigit():
                found.add(int(part))
    return found


def lowered(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


AND = re.compile(r"\s+(?:und|and|&)\s+", re.I)


@lru_cache(4096)
def _with_year(year: str) -> tuple[re.Pattern, ...]:
    """What follows a name up to the year: a few characters; in brackets; with "et al." in them; a bracket of its own, and
    one without any words between. All but the first must be closed later on."""
    y = re.escape(year)
    forms = (rf".{{0,30}}{y}", rf"[,\s]+{y}", rf"\s+et\s+al\.?,?\s*{y}", rf"\s+(?:et\s+al\.?\s*|(?:und|and|&)\s+\w+\s+)?\({y}", rf"\s+\({y}")
    return tuple(re.compile(f, re.I) for f in forms)


class Body:
    """A text and the places of its brackets."""

    def __init__(self, text: str):
        self.text, self.low = text, lowered(text)
        self.last = {c: text.rfind(c) for c in ")]"}

    def closed(self, m: re.Match | None, c: str = ")") -> bool:
        return m is not None and m.end() <= self.last[c]

    def opened(self, at: int, pair: str) -> bool:
        """A bracket is open at ``at``."""
        return self.text.rfind(pair[0], 0, at) > self.text.rfind(pair[1], 0, at)

    def back(self, at: int) -> int:
        """Where the blanks before ``at`` begin."""
        while at and self.text[at - 1].isspace():
            at -= 1
        return at

    def dated(self, start: int, end: int, second: str, year: str) -> bool:
        """The name at ``start`` stands with the year in one of the forms; ``second`` is the other author's, in lower case."""
        near, plain, others, behind, bracket = _with_year(year)
        t = self.text
        if near.match(t, end) or self.closed(behind.match(t, end)):
            return True
        joined = AND.match(t, end) if second else None
        after = joined.end() + len(second) if joined and self.low.startswith(second, joined.end()) else 0
        if after and self.closed(bracket.match(t, after)):
            return True
        before = self.back(start)
        if t[start - 1 : start] == "[":
            return self.closed(plain.match(t, end), "]")
        first = t[start - 1 : start] == "("
        if first and after and self.closed(plain.match(t, after)):
            return True
        compared = before < start and self.low[max(0, before - 4) : before].endswith(("vgl", "vgl.")) and self._after_bracket(before)
        return (first or compared) and (self.closed(plain.match(t, end)) or self.closed(others.match(t, end)))

    def _after_bracket(self, at: int) -> bool:
        """The word "vgl" that ends at ``at`` follows an opening bracket."""
        at -= 4 if self.text[at - 1] == "." else 3
        at = self.back(at)
        return self.text[at - 1 : at] == "("

    def in_context(self, start: int, end: int) -> bool:
        """The name stands in brackets, or behind a word that introduces a source."""
        for pair in ("()", "[]"):
            if end <= self.last[pair[1]] and self.opened(start, pair):
                return True
        at = self.back(start)
        if at == start:
            return False
        if self.low[max(0, at - 8) : at].endswith(BEFORE):
            return True
        according = self.back(at - 2)
        return self.low[at - 2 : at] == "to" and according < at - 2 and self.low[max(0, according - 9) : according] == "according"


def how_cited(refs: list[dict], text: str) -> list[str | None]:
    """For each reference (ref_index, names, year, phrases): numeric, author_year, author, title or null."""
    body = Body(text)
    numbers = cited_numbers(text)
    how: list[str | None] = ["numeric" if len(numbers) >= LEAST_NUMBERS and r["ref_index"] in numbers else None for r in refs]
    wanted: dict[str, list[int]] = {}
    for i, r in enumerate(refs):
        if how[i] is None and r["names"]:
            wanted.setdefault(lowered(r["names"][0]), []).append(i)
    hits = _hits(wanted, body.low)
    for name, own in wanted.items():
        places = [(e - len(name) + 1, e + 1) for e in hits.get(name, ())]
        apart, end = 0, 0  # occurrences that do not overlap
        for s, e in places:
            if s >= end:
                apart, end = apart + 1, e
        alone = None
        for i in own:
            r = refs[i]
            second = lowered(r["names"][1]) if len(r["names"]) > 1 else ""
            if r["year"] and any(body.dated(s, e, second, str(r["year"])) for s, e in places):
                how[i] = "author_year"
            elif len(name) >= 3 and 1 <= apart <= MOST_NAMES:
                alone = any(body.in_context(s, e) for s, e in places) if alone is None else alone
                how[i] = "author" if alone else None
    open_ = [i for i in range(len(refs)) if how[i] is None]
    runs: dict[str, list[int]] = {}
    for i in open_:
        for p in refs[i]["phrases"]:
            runs.setdefault(p, []).append(i)
    for p in _hits(runs, " ".join(body.low.split()) if runs else ""):
        for i in runs[p]:
            how[i] = "title"
    return how


def _hits(patterns: dict[str, list[int]], text: str) -> dict[str, list[int]]:
    """Last places of each pattern that is met, in order."""
    found: dict[str, list[int]] = {}
    if patterns:
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        for end, p in machine.iter(text):
            found.setdefault(p, []).append(end)
    return found


def usage(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, ref_index, how. refs: doc_id, ref_index, authors, year, title; bodies: doc_id, body.

    A reference counts as cited by number where the body has three distinct numbers in brackets or more; else if its
    first author stands with its year in one of the usual forms; else if the author, met at most 50 times, stands
    in brackets or behind a word such as "see"; else if three or four words of its title stand together. References of
    documents without a body, or with a null one, are not cited. Long lists are split into blocks of ``BLOCK``.
    """
    entry = F.struct(F.col("ref_index").cast("long").alias("ref_index"), last_names(F.col("authors")).alias("names"), F.col("year").cast("string").alias("year"), phrases(F.col("title")).alias("phrases"))
    # numbered by document, so that blocks, too, are made where the one shuffle by document brought the references
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_index"))
    numbered = refs.select("doc_id", "ref_index", "authors", "year", "title", F.floor((place - 1) / BLOCK).alias("block"))
    own = numbered.groupBy("doc_id", "block").agg(F.collect_list(entry).alias("refs"))
    met = own.join(bodies.select("doc_id", "body"), "doc_id", "left").select("doc_id", "refs", F.coalesce("body", F.lit("")).alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i in range(len(batch)):
                found = batch["refs"][i].as_py()
                out[0].extend([batch["doc_id"][i].as_py()] * len(found))
                out[1].extend(r["ref_index"] for r in found)
                out[2].extend(how_cited(found, batch["body"][i].as_py()))
                # not a batch a document, which costs more than to look through it
                if len(out[0]) >= ROWS or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "ref_index", "how"])
                    out = ([], [], [])

    return met.select(F.col("doc_id").cast("long").alias("doc_id"), "refs", "body").mapInArrow(scan, "doc_id long, ref_index long, how string")


def summary(used: DataFrame) -> DataFrame:
    """doc_id, total, used_in_text, not_used_in_text, first_unused (the least index, null if all are used)."""
    cited = F.col("how").isNotNull()
    return used.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(cited).alias("used_in_text"), F.count_if(~cited).alias("not_used_in_text"), F.min(F.when(~cited, F.col("ref_index"))).alias("first_unused")
    )
