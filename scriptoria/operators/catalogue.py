"""Look-ups, scopes, memberships and statistics of a library of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions import text as T
from scriptoria.operators.running import running_sum


def lookup(papers: DataFrame, q: str, key_col: str = "key", limit: int = 20, offset: int = 0) -> DataFrame:
    """Papers with ``q``, taken literally, in title, authors, key or DOI; keys that begin with it come first, then authors."""
    has = lambda c: F.contains(F.lower(c), F.lit(q.lower()))
    found = papers.filter(has("title") | has("authors") | has(key_col) | has("doi"))
    rank = F.when(F.startswith(F.lower(key_col), F.lit(q.lower())), 0).when(has("authors"), 1).otherwise(2)
    return found.withColumn("class", rank).orderBy("class", F.desc_nulls_last("year"), "title", "id").offset(offset).limit(limit)


def resolve(papers: DataFrame, ids: list[int]) -> DataFrame:
    """Papers of the requested ids, each once, with pos: the place of its first mention."""
    wanted = papers.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "id")).groupBy("id").agg(F.min("pos").alias("pos"))
    return papers.join(F.broadcast(wanted), "id")  # as many rows as the caller names


def allocate_keys(papers: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """id, cite_key: base, then a, b, .. z, aa for the later ids of one base. ``taken``: cite_key of others, skipped.

    A base ends in a digit or X, so a taken key tells its base and number. Before the j-th taken number t of a base (from 0)
    lie t - j free ones, so a paper's n-th place moves on by the taken numbers with t - j <= n: one running count over
    papers and taken keys together. Ids are unique; no base, however common, is one window.
    """
    p = running_sum(papers.select("id", I.key_base(F.col("authors"), F.col("year")).alias("base")), "n", F.lit(1), ["base"], "id").withColumn("n", F.col("n") - 1)
    if taken is not None:
        split = lambda group: F.regexp_extract("cite_key", r"(?s)^(.*?)([a-z]{0,13})$", group)
        t = taken.filter("cite_key is not null").select(split(1).alias("base"), I.suffix_number(split(2)).alias("t")).distinct()
        t = t.join(p.select("base").distinct(), "base", "left_semi")
        t = running_sum(t, "j", F.lit(1), ["base"], "t").select(F.lit(None).cast(p.schema["id"].dataType).alias("id"), "base", (F.col("t") - F.col("j") + 1).alias("n"), F.lit(1).alias("held"))
        both = t.unionByName(p.select("id", "base", "n", F.lit(0).alias("held"))).withColumn("free_first", 1 - F.col("held"))
        p = running_sum(both, "moved", F.col("held"), ["base"], "n", "free_first").filter("held = 0").withColumn("n", F.col("n") + F.col("moved"))
    return p.select("id", F.concat("base", I.key_suffix(F.col("n"))).alias("cite_key"))


def summary(collections: DataFrame, items: DataFrame, papers: DataFrame, archived: str = "false") -> DataFrame:
    """id, name, n_items, n_files of collections that are not deleted; archived: 'false', 'true' or 'all'."""
    c = collections.filter(F.col("deleted_at").isNull())
    c = c.filter({"false": F.col("archived_at").isNull(), "true": F.col("archived_at").isNotNull(), "all": F.lit(True)}[archived])
    has = items.join(papers.select(F.col("id").alias("paper_id"), "filename"), "paper_id").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("filename") != "").alias("n_files"))
    return c.join(has, c["id"] == has["collection_id"], "left").select("id", "name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_items", "n_files")])


def statistics(papers: DataFrame) -> DataFrame:
    """One row: n, first and last year (0 is none), papers with a DOI, with a file."""
    y = F.when(F.col("year") > 0, F.col("year"))
    return papers.agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count_if(F.col("doi") != "").alias("with_doi"), F.count_if(F.col("filename") != "").alias("with_file"))


def top_values(papers: DataFrame, column: str, k: int = 10) -> DataFrame:
    g = papers.filter(F.col(column) != "").groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), F.lower("name"), "name").limit(k)


#: Either-or groups of fields that an item type needs.
REQUIRED = {"article": ["authors", "title", "venue|publisher", "year"], "book": ["authors|editors", "title", "publisher", "year"], "thesis": ["authors", "title", "school", "year"], "webpage": ["title", "url"]}


def is_empty(value: Column, kind: str = "text") -> Column:
    """A year is empty at 0; names are empty if they hold nothing but separators; texts if blank."""
    if kind == "year":
        return F.coalesce(value, F.lit(0)) == 0
    kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"[,;\s]" if kind == "names" else r"\s", "")
    return kept == ""


def item_type(venue: Column, publisher: Column, school: Column, url: Column) -> Column:
    some = lambda c: ~is_empty(c)
    return F.when(some(school), "thesis").when(some(venue), "article").when(some(publisher), "book").when(some(url), "webpage").otherwise("article")


def missing_fields(papers: DataFrame, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """``papers`` with missing: the either-or groups of its ``type`` of which every field is empty."""
    kinds = {"year": "year", "authors": "names", "editors": "names"}

    def lacking(group: str) -> Column:
        out = F.lit(True)
        for f in group.split("|"):
            out = out & is_empty(F.col(f), kinds.get(f, "text"))
        return F.when(out, F.lit(group))

    by_type = F.lit(None).cast("array<string>")
    for name, needs in required.items():
        by_type = F.when(F.col("type") == name, F.array_compact(F.array(*map(lacking, needs)))).otherwise(by_type)
    return papers.withColumn("missing", by_type)


def pivot_fields(papers: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """One column a custom field beside the papers (values: paper_id, field, value)."""
    wide = values.groupBy("paper_id").pivot("field", fields).agg(F.max("value"))
    return papers.join(wide, papers["id"] == wide["paper_id"], "left").drop("paper_id")


def as_of(rows: DataFrame, marks: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of the last mark at or before it in its group: one union and one window, no join."""
    extra = [c for c in rows.columns if c not in (by, on)]
    left = rows.select(by, on, F.lit(1).alias("_late"), F.struct(*extra).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias(value))
    right = marks.select(by, on, F.lit(0).alias("_late"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), value)
    w = Window.partitionBy(by).orderBy(on, "_late").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return both.filter("_late = 1").select(by, on, "_row.*", value)


def islands(rows: DataFrame, by: str, on: str, gap: int = 2) -> DataFrame:
    """``rows`` with island: runs in which neighbours are at most ``gap`` apart."""
    w = Window.partitionBy(by).orderBy(on)
    new = F.coalesce((F.col(on) - F.lag(on).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def assignments(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed (paper_id, category_id, confidence, pos) that are known, each once (the first), finite and within 0..1."""
    ok = proposed.filter(~F.isnan("confidence") & F.col("confidence").isNotNull() & (F.abs("confidence") < F.lit(float("inf"))))
    first = ok.join(known.select(F.col("id").alias("category_id")), "category_id", "left_semi").groupBy("paper_id", "category_id").agg(F.min_by("confidence", "pos").alias("c"))
    return first.select("paper_id", "category_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")).alias("confidence"))


def project_keys(members: DataFrame) -> DataFrame:
    """project, key, place: the distinct keys of each project's papers in order of id. members: project, id, key."""
    first = members.filter("key <> ''").groupBy("project", "key").agg(F.min("id").alias("id"))
    return first.select("project", "key", F.row_number().over(Window.partitionBy("project").orderBy("id")).alias("place"))
