"""Papers found or made by DOI, with keys that wait for what a look-up finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.operators.catalogue import allocate_keys
from scriptoria.operators.running import running_sum
from scriptoria.session import checkpoint_folder

NO_DOI = "DOI is empty"


def find_or_create(items: DataFrame, papers: DataFrame, works: DataFrame) -> DataFrame:
    """pos, doi, created, paper_id, cite_key, pdf, error, and of what is created title, authors, year, file_hash.

    items: pos (long, unique), doi, title, authors, year; papers: id, doi, cite_key, filename; works, as a look-up found them:
    doi, authors, year. A DOI that the library has is that paper (the least id of several); else its first item makes one and
    the later ones find it. Without a DOI an item is an answer with an error. New ids follow the greatest one in the items'
    order. What an item leaves empty (null, blank, year 0) is taken from the works (of several the least row).

    Keys are given in the items' order, past those that are taken. An item with neither authors nor year first holds a
    placeholder; where the works know either, it gets its key anew, after all others, and every item of the DOI
    reports that one. Extra columns are left out; empty tables give what the others say.
    """
    checkpoint_folder(items.sparkSession)
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    year = F.nullif(F.col("year"), F.lit(0)).cast("int")
    asked = items.select("pos", F.trim(F.coalesce("doi", F.lit(""))).alias("given"), I.doi_key(F.col("doi")).alias("key"), blank("title").alias("title"), blank("authors").alias("authors"), year.alias("year"))
    wrong = asked.filter("key = ''")
    stored = papers.select(F.lower(F.trim("doi")).alias("key"), F.struct("id", "cite_key", "filename").alias("paper")).filter("key <> ''").groupBy("key").agg(F.min_by("paper", "paper.id").alias("paper"))
    first = asked.filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("pos", "title", "authors", "year"), "pos").alias("i"))
    new = first.join(stored, "key", "left_anti").select("key", "i.*")
    known = works.select(I.doi_key(F.col("doi")).alias("key"), blank("authors").alias("found_authors"), year.alias("found_year"))
    known = known.filter("key <> ''").groupBy("key").agg(F.min(F.struct("found_authors", "found_year")).alias("w")).select("key", "w.*")
    new = new.join(known, "key", "left")
    bare = F.col("authors").isNull() & F.col("year").isNull()
    new = new.withColumn("bare", bare).withColumn("last_authors", F.coalesce("authors", "found_authors")).withColumn("last_year", F.coalesce("year", "found_year"))
    last = I.key_base(F.col("last_authors"), F.col("last_year"))
    new = new.withColumn("again", F.col("bare") & (last != I.key_base(F.lit(""), F.lit(None).cast("int")))).checkpoint()  # numbered, keyed twice and joined
    taken = papers.select("cite_key").filter("cite_key <> ''")
    at_first = allocate_keys(new.select(F.col("pos").alias("id"), "authors", "year"), taken)
    again = new.filter("again").select(F.col("pos").alias("id"), F.col("last_authors").alias("authors"), F.col("last_year").alias("year"))
    others = taken.unionByName(at_first.select("cite_key"))
    keys = at_first.join(again.select("id"), "id", "left_anti").unionByName(allocate_keys(again, others)).withColumnRenamed("id", "pos")
    top = F.broadcast(papers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")))  # one row
    made = running_sum(new.withColumn("all", F.lit(0)), "n", F.lit(1), ["all"], "pos").join(keys, "pos").crossJoin(top)
    made = made.select("key", F.col("pos").alias("first"), (F.col("top") + F.col("n")).alias("new_id"), F.col("cite_key").alias("new_key"), F.struct("title", F.col("last_authors").alias("authors"), F.col("last_year").alias("year"), F.sha2(F.concat(F.lit("doi:"), "key"), 256).alias("file_hash")).alias("m"))
    met = asked.filter("key <> ''").select("pos", "key").join(stored, "key", "left").join(made, "key", "left")
    created = F.coalesce(F.col("first") == F.col("pos"), F.lit(False))
    of_new = [F.when(created, F.col(f"m.{c}")).alias(c) for c in ("title", "authors", "year", "file_hash")]
    done = met.select(
        "pos", F.col("key").alias("doi"), created.alias("created"), F.coalesce("paper.id", "new_id").cast("long").alias("paper_id"), F.coalesce("paper.cite_key", "new_key", F.lit("")).alias("cite_key"),
        F.when(F.coalesce("paper.filename", F.lit("")) != "", "fetched").otherwise("none").alias("pdf"), F.lit(None).cast("string").alias("error"), *of_new,
    )
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("authors", "string"), ("year", "int"), ("file_hash", "string"))]
    return done.unionByName(wrong.select("pos", F.col("given").alias("doi"), F.lit(False).alias("created"), F.lit(None).cast("long").alias("paper_id"), F.lit("").alias("cite_key"), F.lit("none").alias("pdf"), F.lit(NO_DOI).alias("error"), *nothing))
