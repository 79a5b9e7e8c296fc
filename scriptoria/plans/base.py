"""Tables that the queries share: papers derived from documents, the category tree, citation edges; each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions import text as T
from scriptoria.session import table

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TITLE = f"substr(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '')[1], ''), 1, 200)"
PAPERS = f"""papers AS (
  SELECT doc_id AS id, {TITLE} AS title, coalesce(source, '') || ', ' || coalesce(lang, '') AS authors, coalesce(source, '') AS venue,
    CASE WHEN doc_id % 3 = 0 THEN '10.5555/W.' || (doc_id % 50) ELSE '' END AS doi,
    CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1980 + doc_id % 45 END AS year,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'f' || doc_id || '.pdf' END AS filename, text
  FROM documents)"""
KEY = r"CASE WHEN authors = '' THEN 'Unknown' ELSE regexp_replace(trim(split_part(authors, ',', 1)), '[^\p{L}\p{N}_]', '', 'g') END || coalesce(nullif(year, 0)::VARCHAR, 'XXXX')"
FOLD = rf"trim(regexp_replace(regexp_replace(lower(trim(strip_accents(title), {BLANKS})), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, authors, venue, doi, year (0: none), filename ('': none), text; identifiers follow from doc_id."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), T.title_of(F.col("text")).alias("title"), F.concat(F.coalesce("source", F.lit("")), F.lit(", "), F.coalesce("lang", F.lit(""))).alias("authors"),
        F.coalesce("source", F.lit("")).alias("venue"), F.when(i % 3 == 0, F.concat(F.lit("10.5555/W."), (i % 50).cast("string"))).otherwise("").alias("doi"),
        F.when(i % 10 == 0, 0).otherwise(1980 + i % 45).alias("year"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf"))).alias("filename"), "text",
    )


def keyed(p: DataFrame) -> DataFrame:
    return p.withColumn("base", I.key_base(F.col("authors"), F.col("year")))


TREE = """tree AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, parent: regions above nations."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    top = r.select(named("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    return top.unionByName(n.select(named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), named("r", "n_regionkey").alias("parent")))


EDGES = "edges AS (SELECT DISTINCT l_partkey AS source, l_orderkey % (SELECT count(*) FROM part) AS target FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: parts that cite parts."""
    n = F.broadcast(table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")))  # one row
    return table(spark, sf_dir, "lineitem").crossJoin(n).select(F.col("l_partkey").alias("source"), (F.col("l_orderkey") % F.col("n")).alias("target")).distinct()
