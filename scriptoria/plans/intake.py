"""Queries on what comes into the library by DOI."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators import catalogue as C
from scriptoria.operators.intake import NO_DOI, find_or_create
from scriptoria.plans.base import KEY, PAPERS, papers
from scriptoria.plans.registry import query
from scriptoria.session import table


def suffix_sql(n: str) -> str:
    return f"""CASE WHEN {n} = 0 THEN '' WHEN {n} <= 26 THEN chr((96 + {n})::INT) WHEN {n} <= 702 THEN chr((97 + ({n} - 27) // 26)::INT) || chr((97 + ({n} - 27) % 26)::INT)
    ELSE chr((97 + ({n} - 703) // 676)::INT) || chr((97 + ({n} - 703) // 26 % 26)::INT) || chr((97 + ({n} - 703) % 26)::INT) END"""


def keys_sql(wanted: str, taken: str, name: str) -> str:
    """CTEs ending in ``name`` (pos, cite_key): every number up to wanted and taken ones, those that are taken out. wanted: pos, authors, year."""
    base = KEY.replace("WHEN authors = ''", "WHEN coalesce(authors, '') = ''")
    return f"""
{name}_w AS (SELECT pos, {base} AS base, row_number() OVER (PARTITION BY {base} ORDER BY pos) AS n FROM {wanted}),
{name}_b AS (SELECT base, max(n) + (SELECT count(*) FROM {taken} WHERE starts_with(cite_key, base)) AS most FROM {name}_w GROUP BY base),
{name}_k AS (SELECT base, k, base || {suffix_sql("k")} AS cite_key FROM (SELECT base, unnest(range(0, most)) AS k FROM {name}_b)),
{name}_f AS (SELECT base, cite_key, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM {name}_k WHERE cite_key NOT IN (SELECT cite_key FROM {taken})),
{name} AS (SELECT pos, cite_key FROM {name}_w JOIN {name}_f USING (base, n))"""


ITEMS = """items AS (
  SELECT o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.5555/w.' || (o_custkey % 70) WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE '  ' END WHEN 2 THEN '10.5555/N.' || (o_custkey % 40) ELSE 'doi:10.5555/O.' || o_orderkey || '.' END AS doi,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ', A.' ELSE ' ' END AS authors, CASE WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) ELSE 0 END AS year, o_orderstatus AS title FROM orders)"""
WORKS = """works AS (SELECT DISTINCT '10.5555/o.' || o_orderkey AS doi, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Found, ' || o_orderpriority END AS authors, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 1990 + o_custkey % 3 END AS year FROM orders WHERE o_orderkey % 11 <> 0)"""


@query("doi_intake", "X9 W7", f"""
WITH {PAPERS}, {ITEMS}, {WORKS},
library AS (SELECT id, doi, filename, CASE WHEN id % 5 = 0 THEN 'Unknown' || CASE WHEN id % 2 = 0 THEN 'XXXX' ELSE '1991' END || {suffix_sql("(id % 100)")} ELSE {KEY} END AS cite_key FROM papers),
asked AS (SELECT pos, trim(coalesce(doi, '')) AS given, rtrim(regexp_replace(lower(trim(coalesce(doi, ''))), '^(https://doi.org/|doi:)', ''), '.') AS key, nullif(trim(title), '') AS title, nullif(trim(authors), '') AS authors, nullif(year, 0) AS year FROM items),
stored AS (SELECT lower(doi) AS key, min(id) AS id, arg_min(cite_key, id) AS cite_key, arg_min(filename, id) AS filename FROM library WHERE doi <> '' GROUP BY 1),
new AS (SELECT a.*, w.authors AS found_authors, w.year AS found_year, row_number() OVER (ORDER BY pos) AS n FROM (SELECT * FROM asked WHERE key <> '' AND key NOT IN (SELECT key FROM stored) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1) a LEFT JOIN works w ON w.doi = key),
again AS (SELECT pos, coalesce(authors, found_authors) AS authors, coalesce(year, found_year) AS year FROM new WHERE authors IS NULL AND year IS NULL AND (found_authors IS NOT NULL OR found_year IS NOT NULL)),
taken AS (SELECT DISTINCT cite_key FROM library), {keys_sql("new", "taken", "early")},
held AS (SELECT cite_key FROM taken UNION SELECT cite_key FROM early), {keys_sql("again", "held", "late")},
keys AS (SELECT pos, coalesce(late.cite_key, early.cite_key) AS cite_key FROM early LEFT JOIN late USING (pos)),
made AS (SELECT key, new.pos AS first, (SELECT max(id) FROM library) + n AS id, cite_key, title, coalesce(authors, found_authors) AS authors, coalesce(year, found_year) AS year FROM new JOIN keys USING (pos))
SELECT pos, key AS doi, coalesce(first = pos, false) AS created, coalesce(s.id, m.id) AS paper_id, coalesce(s.cite_key, m.cite_key) AS cite_key, CASE WHEN coalesce(filename, '') <> '' THEN 'fetched' ELSE 'none' END AS pdf, NULL AS error,
  CASE WHEN first = pos THEN m.title END AS title, CASE WHEN first = pos THEN m.authors END AS authors, CASE WHEN first = pos THEN m.year END AS year, CASE WHEN first = pos THEN sha256('doi:' || key) END AS file_hash
FROM asked a LEFT JOIN stored s USING (key) LEFT JOIN made m USING (key) WHERE key <> ''
UNION ALL SELECT pos, given, false, NULL, '', 'none', '{NO_DOI}', NULL, NULL, NULL, NULL FROM asked WHERE key = ''""")
def doi_intake(spark, sf_dir):
    """Orders stand for what a reader hands in: DOIs of the library, new ones, new ones more than once, and none."""
    p = papers(spark, sf_dir)
    number, base = (F.col("id") % 100).alias("n"), F.concat(F.lit("Unknown"), F.when(F.col("id") % 2 == 0, "XXXX").otherwise("1991"))
    held = F.when(F.col("id") % 5 == 0, F.concat(base, C.I.key_suffix(number))).otherwise(C.I.key_base(F.col("authors"), F.col("year")))
    o, key, text = table(spark, sf_dir, "orders"), F.col("o_orderkey"), lambda c: c.cast("string")
    doi = F.when(key % 4 == 0, F.concat(F.lit("https://doi.org/10.5555/w."), text(F.col("o_custkey") % 70))).when(key % 4 == 1, F.when(F.col("o_custkey") % 2 != 0, "  "))
    doi = doi.when(key % 4 == 2, F.concat(F.lit("10.5555/N."), text(F.col("o_custkey") % 40))).otherwise(F.concat(F.lit("doi:10.5555/O."), text(key), F.lit(".")))
    items = o.select(key.alias("pos"), doi.alias("doi"), F.when(key % 3 == 0, F.concat("o_orderpriority", F.lit(", A."))).otherwise(" ").alias("authors"), F.when(key % 5 == 0, F.year("o_orderdate")).otherwise(0).alias("year"), F.col("o_orderstatus").alias("title"))
    works = o.filter(key % 11 != 0).select(F.concat(F.lit("10.5555/o."), text(key)).alias("doi"), F.when(key % 7 != 0, F.concat(F.lit("Found, "), "o_orderpriority")).alias("authors"), F.when(key % 6 != 0, 1990 + F.col("o_custkey") % 3).alias("year"))
    return find_or_create(items, p.select("id", "doi", held.alias("cite_key"), "filename"), works)
