"""Text expressions: tokens, titles, excerpts, normalised words, plausibility."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zäöüß0-9]{2,}"
BLANKS = " \t\n\x0b\f\r"


def tokens(text: Column) -> Column:
    """Runs of two or more letters (with German umlauts) or digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def title_of(text: Column, longest: int = 200) -> Column:
    """First line with a visible character, stripped and cut."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, longest)


def excerpt(text: Column, longest: int = 300) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(t) > longest, F.concat(F.rtrim(F.substring(t, 1, longest)), F.lit("…"))).otherwise(t)


def _decomposed() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and marks, and these letters."""
    pairs = []
    for c in map(chr, range(0x80, 0xFFFE)):
        parts = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != c:
            pairs.append((c, parts[0]))
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


_MARKED, _BARE = _decomposed()
#: Letters that decompose to several.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}


def bare_letters(text: Column) -> Column:
    """Letters without their marks, compatibility forms as plain letters; a decomposed mark stays for the caller to drop."""
    t = F.translate(text, _MARKED, _BARE)
    for whole, letters in LIGATURES.items():
        t = F.replace(t, F.lit(whole), F.lit(letters))
    return t


def fold_title(title: Column) -> Column:
    """Lower case, letters without marks, no punctuation, one space between words."""
    t = F.regexp_replace(F.lower(strip(bare_letters(F.coalesce(title, F.lit(""))))), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))  # what ends in punctuation behind a blank


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words over the larger set; 0 where either has none."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(F.least(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / larger)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
