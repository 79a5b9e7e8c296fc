"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a Column that is true where a text fails, and has another that says what it costs there: the words and
characters that it touches, each at the price of the function that touches them. A bounded sample from files all over
the table tells what a rule costs on these texts and how often it rejects; rules then run in order of rejections per
cost inside one CASE over the text itself, whose later branches are not evaluated once one rejects: a text that is
too short is never split into windows. Costs are counted and not timed, so one table gives one order on any machine
and in any run. The order changes the time, never the verdict. ``features`` measures texts whatever the verdict and
stands apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.text import fresh, let, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Documents of the sample on which costs and rejections are estimated; texts of more bytes stay out of it.
SAMPLE_DOCS, SAMPLE_BYTES = 500, 1 << 16
#: Files, spread evenly over the table, that the sample is drawn from.
SAMPLE_FILES = 32
#: Nanoseconds that a function takes for a word or a character, as timed once on one core: windows and their sorting, joining
#: words, replacing symbols, splitting lines. Only their ratios matter.
WINDOW_PRICE, JOIN_PRICE, SYMBOL_PRICE, LINE_PRICE, TEXT_PRICE = 1100.0, 65.0, 14.0, 6.0, 25.0


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(found: Column, width: int = WINDOW) -> Column:
    """Words inside any ``width``-word window that the array holds twice or more, first occurrences included.

    Sorting (hash, position) brings equal windows together; each flagged start then adds at most ``width``
    new words to what is covered. Linear memory and n log n time for a text of any length.
    """

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, k: (e["x"] == F.get(s, k - 1)["x"]) | (e["x"] == F.get(s, k + 1)["x"])
            return F.sort_array(F.filter(F.transform(s, lambda e, k: F.when(same(e, k), e["i"]).otherwise(F.lit(-1))), lambda v: v >= 0))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).cast("long").alias("n"), i.alias("last"))
        return F.aggregate(let(ordered, starts), zero, step, lambda a: a["n"])

    def windows(h: Column) -> Column:
        g = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return let(g, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))

    hashed = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) <= width, F.lit(0).cast("long")).otherwise(let(hashed, windows))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), of whole texts.

    Null and blank texts measure 0. Rows pass one by one: repeated rows, other columns and empty tables need no
    care; columns of the names above are replaced.
    """
    text, m = F.col(text_col), fresh(docs, "measured")
    measured = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        ),
    )
    out = docs.withColumn(m, measured)
    return out.withColumns(
        {
            "n_words": F.col(f"{m}.n_words"),
            "word_chars": F.col(f"{m}.word_chars"),
            "n_symbols": n_symbols(text),
            "n_dup_lines": n_dup_lines(text),
            "n_repeat_words": F.col(f"{m}.n_repeat_words"),
        }
    ).drop(m)


@dataclass(frozen=True)
class Rule:
    """``fails(text, words)`` is a boolean Column, ``cost(text, words)`` a number of nanoseconds; words is the text's array of
    words, computed once a row."""

    name: str
    fails: Callable[[Column, Column], Column]
    cost: Callable[[Column, Column], Column] = lambda t, w: F.lit(TEXT_PRICE) + SYMBOL_PRICE * F.length(t)


def default_rules() -> list[Rule]:
    """The first two are the base rules; the others reject symbol soup, odd word lengths and repeated lines."""
    chars = lambda w: F.length(F.array_join(w, ""))
    price = lambda each, n: F.lit(TEXT_PRICE) + each * n
    return [
        Rule("too_short", lambda t, w: F.size(w) < 10, lambda t, w: F.lit(TEXT_PRICE)),
        Rule("repeats", lambda t, w: 100 * n_repeat_words(w) > 20 * F.size(w), lambda t, w: price(WINDOW_PRICE, F.size(w))),
        Rule("symbols", lambda t, w: n_symbols(t) * 4 > F.size(w), lambda t, w: price(SYMBOL_PRICE, F.length(t))),
        Rule("word_length", lambda t, w: (chars(w) > 20 * F.size(w)) | (chars(w) < 2 * F.size(w)), lambda t, w: price(JOIN_PRICE, F.size(w))),
        Rule("dup_lines", lambda t, w: n_dup_lines(t) * 10 > F.size(w), lambda t, w: price(LINE_PRICE, F.length(t))),
    ]


def sample_of(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """At most ``sample_docs`` texts of at most ``SAMPLE_BYTES``: those of the least hashes, of ``SAMPLE_FILES`` files that are
    spread evenly over the table. A table that comes from no files, or joins such, is sampled whole. Repeated calls agree."""
    files = sorted(docs.inputFiles())
    if len(files) > SAMPLE_FILES:
        chosen = [files[k * len(files) // SAMPLE_FILES].rsplit("/", 1)[-1] for k in range(SAMPLE_FILES)]
        try:
            some = docs.filter(F.col("_metadata.file_name").isin(chosen))
        except AnalysisException:  # the plan has more than one scan, or hides it
            some = docs
        if some.limit(1).count():
            docs = some
    short = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    return short.orderBy(F.xxhash64("text"), "text").limit(sample_docs)


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """``rules`` by rejections per cost on the sample, best first; equals, and all rules of an empty table, stay as given."""
    sample = sample_of(docs, text_col, sample_docs)
    found = []
    for i, r in enumerate(rules):
        found += [F.count_if(_failing("text", r.fails)).alias(f"r{i}"), F.sum(_failing("text", r.cost)).cast("double").alias(f"c{i}")]
    seen = sample.agg(F.count(F.lit(1)).alias("n"), *found).first()
    gain = [(seen[f"r{i}"] + 0.5) / max(seen[f"c{i}"] or 0.0, 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def _failing(text_col: str, body: Callable[[Column, Column], Column]) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return let(words(text), lambda w: body(text, w))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with kept (boolean) and failed_rule (string, null where kept).

    Null and blank texts fail as too short. Rows pass one by one: repeated rows and extra columns stay,
    columns named kept or failed_rule are replaced. Which of several failing rules is named depends on
    the order chosen; ``kept`` does not.
    """
    rules = order_rules(docs, rules or default_rules(), text_col, sample_docs)

    def first(text: Column, found: Column) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(rules):
            out = F.when(F.coalesce(r.fails(text, found), F.lit(False)), F.lit(r.name)).otherwise(out)
        return out

    judged = docs.withColumn("failed_rule", _failing(text_col, first))
    return judged.withColumn("kept", F.col("failed_rule").isNull())
