"""Queries on what bodies cite: references made of a document's own words, cited in every form in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import citations as C
from scriptoria.plans.registry import query
from scriptoria.session import table

PER_DOCUMENT = 8
#: The text around a name (N), a second name (S), a year (Y) or an index (K); one form a reference.
FORMS = (
    "(N, Y)", "(N et al., Y, p. 3)", "[N, Y]", "N\n(Y)", "N et al.\n\n(Y, S. 2)", "N und Smith\n(Ya)", "(vgl. N,\nY)", "(vgl N\net al., Y)", "N in the year of Y", "(the N line)", "laut N", "[K]", "(N\nand S,\n Y)", "",
)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FORM = "[" + ", ".join(map(_sql, FORMS)) + f"][((doc_id + k) % {len(FORMS)} + 1)::INT]"
_TITLE = "array_to_string(w[(k * 9 + 1)::INT : (k * 9 + 9)::INT], ' ')"
MADE = f"""words AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda x: length(x) >= 4) AS names, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
),
made AS (
  SELECT doc_id, text, k, names[((k * 13) % len(names) + 1)::INT] AS name, names[((k * 29 + 5) % len(names) + 1)::INT] AS second, (1950 + (doc_id * 7 + k * 11) % 70)::VARCHAR AS year,
    CASE WHEN k % 2 = 0 THEN {_TITLE} ELSE array_to_string(list_reverse(w[(k * 9 + 1)::INT : (k * 9 + 9)::INT]), ' ') END AS title
  FROM words, range(1, {PER_DOCUMENT + 1}) t(k) WHERE len(names) >= 40
),
refs AS (
  SELECT *, [name || ', A.; ' || second || ', B.', 'Ann ' || name || ' and Bob ' || second, name || ', C.', 'D. ' || name][(k % 4 + 1)::INT] AS authors, CASE WHEN k % 4 < 2 THEN second END AS other,
    replace(replace(replace(replace({_FORM}, 'K', k::VARCHAR), 'S', '{{2}}'), 'N', '{{1}}'), 'Y', year) AS form FROM made
),
bodies AS (
  SELECT doc_id, any_value(text) || chr(10) || string_agg(replace(replace(form, '{{1}}', name), '{{2}}', second), chr(10) ORDER BY k) || CASE WHEN doc_id % 5 = 0 THEN ' [1, 3-5]' ELSE '' END AS body FROM refs GROUP BY doc_id
)"""
_ESC = r"regexp_replace(x, '([!-/:-@\[-`{-~])', '\\\1', 'g')"
USED = rf"""
WITH {MADE},
marks AS (SELECT doc_id, body, list_filter(flatten(list_transform(regexp_extract_all(body, '\[(\d[\d,\s\-–]+)\]', 1), lambda m: string_split_regex(m, '[,;]\s*'))), lambda p: true) AS parts FROM bodies),
numbers AS (
  SELECT doc_id, body, list_distinct(flatten(list_transform(list_transform(parts, lambda p: trim(p)), lambda p: CASE
    WHEN regexp_matches(p, '^\d+\s*[-–]\s*\d+') THEN range(regexp_extract(p, '^(\d+)', 1)::BIGINT, least(regexp_extract(p, '^\d+\s*[-–]\s*(\d+)', 1)::BIGINT + 1, regexp_extract(p, '^(\d+)', 1)::BIGINT + 100))
    WHEN regexp_matches(p, '^\d+$') THEN [p::BIGINT] ELSE []::BIGINT[] END))) AS numbers FROM marks
),
j AS (
  SELECT r.*, body, numbers, '(?i)' AS i, '\((?:\s*vgl\.?\s+)?' AS o, '[a-z]?[^)]*\)' AS z, list_filter(string_split_regex(trim(title), '\s+'), lambda x: length(x) >= 3) AS tw FROM refs r JOIN numbers USING (doc_id)
),
p AS (SELECT *, CASE WHEN len(tw) <= 6 THEN 3 ELSE 4 END AS width FROM j)
SELECT doc_id, k AS ref_index, CASE
  WHEN len(numbers) >= 3 AND list_contains(numbers, k) THEN 'numeric'
  WHEN regexp_matches(body, i || o || name || '[,\s]+' || year || z) OR regexp_matches(body, i || o || name || '\s+et\s+al\.?,?\s*' || year || z)
    OR regexp_matches(body, i || '\[' || name || '[,\s]+' || year || '[a-z]?[^\]]*\]') OR regexp_matches(body, i || name || '\s+\(' || year || z)
    OR regexp_matches(body, i || name || '\s+et\s+al\.?\s*\(' || year || z) OR regexp_matches(body, i || name || '\s+(?:und|and|&)\s+[\p{{L}}\p{{N}}_]+\s+\(' || year || z)
    OR regexp_matches(body, i || name || '.{{0,30}}' || year)
    OR (other IS NOT NULL AND (regexp_matches(body, i || '\(' || name || '\s+(?:und|and|&)\s+' || other || '[,\s]+' || year || z) OR regexp_matches(body, i || name || '\s+(?:und|and|&)\s+' || other || '\s+\(' || year || z))) THEN 'author_year'
  WHEN len(regexp_extract_all(body, i || name)) BETWEEN 1 AND 50 AND (regexp_matches(body, i || '\([^)]*' || name || '[^)]*\)') OR regexp_matches(body, i || '\[[^\]]*' || name || '[^\]]*\]')
    OR regexp_matches(body, i || '(?:vgl\.?|see|s\.)\s+' || name) OR regexp_matches(body, i || '(?:nach|laut|gemaess|according\s+to)\s+' || name)) THEN 'author'
  WHEN length(trim(title)) > 15 AND len(tw) >= width AND len(list_filter(range(1, len(tw) - width + 2), lambda b: regexp_matches(body, i || array_to_string(list_transform(tw[b : b + width - 1], lambda x: {_ESC}), '\s+')))) > 0 THEN 'title'
END AS how FROM p"""


def made(spark, sf_dir):
    """refs (doc_id, ref_index, authors, year, title) and bodies (doc_id, body)."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    names, w = F.filter(F.split("text", "[^a-zA-Z]+"), lambda x: F.length(x) >= 4), F.filter(F.split("text", r"\s+", 9 * PER_DOCUMENT + 12), lambda x: x != "")
    # a generated row: a filter on the names themselves would be pushed down and split each text once more
    d = d.select("doc_id", "text", F.inline(F.filter(F.array(F.struct(names.alias("names"), w.alias("w"))), lambda x: F.size(x["names"]) >= 40)))
    year = lambda k: (1950 + (F.col("doc_id") * 7 + k * 11) % 70).cast("string")
    at = lambda i: F.get("names", i % F.size("names"))
    # a row a reference first, so that its parts are computed from columns and once
    r = d.select("doc_id", "names", "w", F.explode(F.sequence(F.lit(1), F.lit(PER_DOCUMENT))).alias("k"))
    k = F.col("k")
    r = r.select("doc_id", "k", at(k * 13).alias("name"), at(k * 29 + 5).alias("second"), year(k).alias("year"), F.slice("w", k * 9 + 1, 9).alias("own"))
    name, second = F.col("name"), F.col("second")
    authors = F.get(F.array(F.concat(name, F.lit(", A.; "), second, F.lit(", B.")), F.concat(F.lit("Ann "), name, F.lit(" and Bob "), second), F.concat(name, F.lit(", C.")), F.concat(F.lit("D. "), name)), k % 4)
    title = F.array_join(F.when(k % 2 == 0, F.col("own")).otherwise(F.reverse("own")), " ")

    def form(k):
        out = F.get(F.array(*map(F.lit, FORMS)), ((F.col("doc_id") + k) % len(FORMS)).cast("int"))
        for mark, text in (("K", k.cast("string")), ("S", F.lit("{2}")), ("N", F.lit("{1}")), ("Y", year(k)), ("{1}", at(k * 13)), ("{2}", at(k * 29 + 5))):
            out = F.replace(out, F.lit(mark), text)
        return out

    # a body's forms stand in one row with its text, which so moves once and meets no rows of references here
    forms = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(PER_DOCUMENT)), form), "\n")
    tail = F.when(F.col("doc_id") % 5 == 0, " [1, 3-5]").otherwise("")
    bodies = d.select("doc_id", F.concat("text", F.lit("\n"), forms, tail).alias("body"))
    return r.select("doc_id", k.alias("ref_index"), authors.alias("authors"), "year", title.alias("title")), bodies


@query("citation_usage", "T4 F14", USED)
def citation_usage(spark, sf_dir):
    return C.usage(*made(spark, sf_dir))


@query("citation_summary", "A18", f"""
WITH used AS ({USED})
SELECT doc_id, count(*) AS total, count(how) AS used_in_text, count(*) - count(how) AS not_used_in_text, min(CASE WHEN how IS NULL THEN ref_index END) AS first_unused FROM used GROUP BY doc_id""")
def citation_summary(spark, sf_dir):
    return C.summary(C.usage(*made(spark, sf_dir)))
