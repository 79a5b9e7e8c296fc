"""Reference sections and page scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import strip, word_set
from scriptoria.operators.batches import exploded


#: What a line with one of these words and perhaps a section number is, the heading of a reference section.
HEADINGS = (
    r"References|Bibliography|Literatur(?:verzeichnis)?|Quellenverzeichnis|Literaturliste|Cited\s+Works|Works\s+Cited|Bibliographie|"
    r"Referenzen|Quellen|Literature|Sources|Bibliograf[ií]a"
)
#: A mark, what it counts and the most that all of its kind count on a page.
MARKS = ((r"10\.\d{4,}/", 2.0, 10.0), (r"\[\d{1,3}\]", 1.5, 10.0), (r"\((?:19|20)\d{2}\)", 1.0, 8.0), (r"(?i)et\s+al\.", 1.5, 6.0))


def page_score(text: Column) -> Column:
    """How much a page looks like references: DOIs, [n] markers, years in parentheses, "et al." and mostly short lines."""
    marks = [F.least(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) * F.lit(each), F.lit(most)) for p, each, most in MARKS]
    lines = F.split(strip(text), "\n")
    short = F.size(F.filter(lines, lambda x: F.length(strip(x)).between(21, 299)))
    return reduce(add, marks) + F.when((F.size(lines) > 5) & (short > 0.5 * F.size(lines)), 3.0).otherwise(0.0)


def section(pages: DataFrame, least: float = 1.5) -> DataFrame:
    """paper_id, page (from 1) of the reference pages. pages: paper_id, page, text.

    A heading starts it: the first one in the second half, else the last one; the pages behind it belong to it
    while their score is ``least`` or more. Without a heading, in three pages or more, if one of the last two
    fifths scores 5: from the start of the last cluster of pages that score 4, two apart at most, to the end.
    Else the last three pages.
    """
    w = Window.partitionBy("paper_id")
    p = pages.withColumns({"score": page_score(F.col("text")), "n": F.max("page").over(w), "at": F.col("page") - 1})
    heading = F.col("text").rlike(rf"(?im)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:{HEADINGS})\s*$")
    behind = F.min(F.when(heading & (F.col("at") >= F.floor(F.col("n") / 2)), F.col("page"))).over(w)
    p = p.withColumn("start", F.coalesce(behind, F.max(F.when(heading, F.col("page"))).over(w)))
    p = p.withColumn("stop", F.min(F.when((F.col("page") > F.col("start")) & (F.col("score") < least), F.col("page"))).over(w))
    late = (F.col("n") >= 3) & (F.col("at") >= F.floor(F.col("n") * 0.6))
    p = p.withColumns({"top": F.max(F.when(late, F.col("score"))).over(w), "high": F.coalesce(late & (F.col("score") >= 4), F.lit(False))})
    before = F.max(F.when(F.col("high"), F.col("page"))).over(w.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("opens", F.col("high") & (F.col("page") - F.coalesce(before, F.lit(-2)) > 2))
    p = p.withColumn("cluster", F.max(F.when(F.col("opens"), F.col("page"))).over(w))
    scored = F.coalesce(F.col("top") >= 5, F.lit(False))
    titled = F.col("start").isNotNull()
    by_heading = titled & (F.col("page") >= F.col("start")) & (F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    by_score = ~titled & scored & (F.col("page") >= F.col("cluster"))
    rest = ~titled & ~scored & (F.col("page") > F.col("n") - 3)
    return p.filter(by_heading | by_score | rest).select("paper_id", "page", F.when(titled, "heading").when(scored, "score").otherwise("last").alias("rule"))


def plausible(title: Column, text: Column, longest: int = 5000) -> Column:
    """Half of a title's words stand in the beginning of the text; a title without words is plausible."""
    w = word_set(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "))
    head = word_set(F.regexp_replace(F.lower(F.substring(text, 1, longest)), r"[^\p{L}\p{N}_\s]", " "))
    return (F.size(w) == 0) | (2 * F.size(F.array_intersect(w, head)) >= F.size(w))


def cut_lines(text: str, longest: int) -> list[str]:
    """Pieces of at most ``longest`` characters that end behind a line feed where one is in reach; together the text."""
    out, at = [], 0
    while len(text) - at > longest:
        end = text.rfind("\n", at + 1, at + longest) + 1 or at + longest
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def pieces(texts: DataFrame, id_col: str, text_col: str, longest: int = 15_000) -> DataFrame:
    """id, piece, text: reference texts in pieces of whole lines; a null text is one empty piece."""

    whole = texts.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("whole"))
    return exploded(whole, "whole", lambda t: list(enumerate(cut_lines(t, longest))), "piece int, text string")
