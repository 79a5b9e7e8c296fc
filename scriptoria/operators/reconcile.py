"""Records from several sources, reviewed changes, memberships, index maintenance and table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions.fields import same_value


def unpivot(rows: DataFrame, fields: list[str], name: str = "value") -> DataFrame:
    """id, field, value (text) of the named columns."""
    return rows.select("id", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot("id", fields, "field", name)


def answer(asked: DataFrame, found: DataFrame, sources: list[str]) -> DataFrame:
    """id, source, status: the first source in order of precedence that has a record.

    asked: id, identifier; found: id, source. Status: found, not_found, or no_identifier."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    best = found.withColumn("rank", rank).filter("rank > 0").groupBy("id").agg(F.min_by("source", "rank").alias("source"))
    a = asked.join(best, "id", "left")
    blank = F.coalesce(F.trim("identifier"), F.lit("")) == ""
    return a.select("id", F.when(~blank, F.col("source")).alias("source"), F.when(blank, "no_identifier").when(F.col("source").isNull(), "not_found").otherwise("found").alias("status"))


def compare(stored: DataFrame, found: DataFrame, fields: list[str], fill_only: tuple[str, ...] = ()) -> DataFrame:
    """id, field, stored, found, kind: fill where nothing is stored (a year of 0 is none), conflict where both say
    something else by the field's own rule (``same_value``). Fields of ``fill_only`` are never in conflict.

    A found pub_date of another year than the stored one is dropped, as the year carries that conflict; one that fills an
    item without a year fills the year too, unless a year was found.
    """
    s, f = unpivot(stored, fields, "stored"), unpivot(found, fields, "found")
    field = F.col("field")
    empty = lambda c: (F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r")) == "") | ((field == "year") & (F.coalesce(c, F.lit("0")) == "0"))
    both = f.join(s, ["id", "field"]).filter(~empty(F.col("found")))
    dated = {"year", "pub_date"} <= set(fields)
    if dated:
        own = stored.select(F.col("id").alias("_id"), F.nullif(F.col("year").cast("int"), F.lit(0)).alias("_year"))
        other = (field == "pub_date") & F.col("_year").isNotNull() & ~I.year_number(F.col("found")).eqNullSafe(F.col("_year"))
        both = both.join(own, F.col("id") == F.col("_id")).filter(~other)
    same = F.lit(None).cast("boolean")
    for name in fields:
        same = F.when(field == name, F.coalesce(same_value(name, F.col("stored"), F.col("found")), F.lit(False))).otherwise(same)
    kind = F.when(empty(F.col("stored")), "fill").when(~same & ~field.isin(*fill_only), "conflict")
    out = both.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    if dated:
        years = out.filter("field = 'year'").select(F.col("id").alias("_has"))
        follow = out.filter("field = 'pub_date' and kind = 'fill' and _year is null").join(years, F.col("id") == F.col("_has"), "left_anti")
        out = out.unionByName(follow.withColumns({"field": F.lit("year"), "stored": F.lit(None).cast("string"), "found": I.year_number(F.col("found")).cast("string")}))
    return out.select("id", "field", "stored", "found", "kind")


def write_rules(changes: DataFrame) -> DataFrame:
    """id, year, pub_date: a date sets its year; a year that a stored date contradicts clears the date.

    changes: id, year, pub_date (new, or null), old_year, old_date."""
    of = lambda c: F.substring(c, 1, 4).try_cast("int")
    year = F.coalesce(of("pub_date"), "year", "old_year")
    date = F.when(F.coalesce("pub_date", F.lit("")) != "", F.col("pub_date")).when(F.col("year").isNotNull() & (of("old_date") != F.col("year")), "").otherwise(F.col("old_date"))
    return changes.select("id", year.alias("year"), date.alias("pub_date"))


def stale_apply(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """row_id, outcome of reviewed rows (row_id, id, field, before, after, accepted) against what is stored now (id, field, value)."""
    r = rows.join(stored, ["id", "field"], "left").join(stored.select("id").distinct().withColumn("exists", F.lit(True)), "id", "left")
    now, text = F.coalesce("value", F.lit("")), lambda c: F.coalesce(c, F.lit(""))
    out = (
        F.when(~F.col("accepted"), "not_accepted").when(F.col("exists").isNull(), "no_item").when(text("after") == "", "nothing_to_write")
        .when(now == text("after"), "already_there").when(now != text("before"), "stale").otherwise("apply")
    )
    return r.select("row_id", out.alias("outcome"))


def membership_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """collection_id, paper_id, change: new, gone or kept."""
    keys = ["collection_id", "paper_id"]
    a, b = current.select(*keys).distinct().withColumn("a", F.lit(1)), wanted.select(*keys).distinct().withColumn("b", F.lit(1))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("kept").alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """The next version of a table: of rows with one key the new one wins (``replace``) or the old one."""
    first, second = (new, old) if replace else (old, new)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def index_plan(papers: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """id, plan of every paper: skip (has a vector of the model), replace (of another), pending (of none)."""
    v = vectors.groupBy("id").agg(F.max(F.col("model") == model).alias("own"))
    return papers.select("id").join(v, "id", "left").select("id", F.when(F.col("own"), "skip").when(F.col("own").isNotNull(), "replace").otherwise("pending").alias("plan"))


def stale_model(levels: list[DataFrame], model: str) -> DataFrame:
    """model, n: the most frequent other model over all levels; ties by name."""
    every = levels[0].select("model")
    for x in levels[1:]:
        every = every.unionByName(x.select("model"))
    return every.filter(F.col("model") != model).groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "model").limit(1)


def undo(rows: DataFrame, run_id: int) -> DataFrame:
    """``rows`` without what a run created (column run_id, null for none)."""
    return rows.filter(~F.col("run_id").eqNullSafe(F.lit(run_id)))


#: The item types of the library.
ITEM_TYPES = ("article", "book", "chapter", "conference", "thesis", "report", "preprint", "webpage", "standard", "patent", "dataset", "software", "misc")


def clean_records(found: DataFrame, longest: int = 5000) -> DataFrame:
    """``found`` without what may not be written: unknown item types, dates that are none or, of publication, of
    another year than the record's; years as numbers; abstracts cut. '' (a year: null) is no value."""
    out = found
    for date in ("pub_date", "accessed"):
        if date in found.columns:
            out = out.withColumn(date, I.partial_date(F.col(date)))
    rules = {
        "year": I.year_number(F.col("year").cast("string")) if "year" in found.columns else None,
        "item_type": F.when(F.trim("item_type").isin(*ITEM_TYPES), F.trim("item_type")).otherwise(""),
        "abstract": F.substring(F.trim(F.coalesce("abstract", F.lit(""))), 1, longest) if "abstract" in found.columns else None,
    }
    out = out.withColumns({k: v for k, v in rules.items() if k in found.columns})
    if {"year", "pub_date"} <= set(found.columns):
        other = F.col("year").isNotNull() & (I.year_number(F.col("pub_date")) != F.col("year"))
        out = out.withColumn("pub_date", F.when(other, "").otherwise(F.col("pub_date")))
    return out


#: Names of custom fields that are notes.
NOTES_NAMES = ("notes", "note", "notizen", "notiz")


def notes_backfill(papers: DataFrame, fields: DataFrame, values: DataFrame, done: DataFrame) -> DataFrame:
    """All papers, with the values of the one text field named like notes behind their own notes, a blank line between.

    Nothing moves if several fields have such names or ``done``, the marker table, has a row: the one-off work is not
    repeated. papers: id, notes, ...; fields: field_id, name, field_type; values: paper_id, field_id, value (one a paper).
    """
    own = lambda c: F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    named = fields.filter((F.col("field_type") == "text") & F.lower(own(F.col("name"))).isin(*NOTES_NAMES))
    # one row at most, whatever the tables hold
    only = named.agg(F.count(F.lit(1)).alias("n"), F.first("field_id").alias("field_id")).crossJoin(done.agg(F.count(F.lit(1)).alias("done"))).filter("n = 1 and done = 0").select("field_id")
    moved = values.join(only, "field_id").select(F.col("paper_id").alias("id"), own(F.col("value")).alias("_moved")).filter("_moved <> ''")
    both = F.concat_ws("\n\n", F.nullif(own(F.col("notes")), F.lit("")), F.col("_moved"))
    return papers.join(moved, "id", "left").withColumn("notes", F.when(F.col("_moved").isNotNull(), both).otherwise(F.col("notes"))).drop("_moved")
