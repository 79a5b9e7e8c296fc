"""Marks in documents: threads of replies, double marks, reading order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptoria.operators.components import components
from scriptoria.session import checkpoint_folder

#: Boxes whose tops are no further apart stand on one line.
SAME_LINE = 3.0
#: Width and height of the grid cells in which boxes meet, in points.
CELL_WIDTH, CELL_HEIGHT = 100.0, 24.0
#: Marks that a task joins together.
PACK = 2000
#: Marks of a document that is walked through in one piece.
LARGEST = 100_000
#: Marks of one kind that are compared with each other.
TOGETHER = 1000


def homes(marks: DataFrame, largest: int = LARGEST) -> DataFrame:
    """doc, xref, home: the mark that starts the thread a mark belongs to. marks: doc, xref, irt (what it answers), grouped.

    A mark without a parent that is there, and a grouped one, is its own home; so is every mark of a loop, and answers to
    it hang on it. (doc, xref) is taken to be unique; a null xref answers for itself only.
    """
    return _resolved(marks, [], largest).select("doc", "xref", "home")


def _resolved(marks: DataFrame, of: list[str], largest: int = LARGEST) -> DataFrame:
    """The marks with home, and of a grouped one the columns ``of`` of what it answers as p_...

    A document of at most ``largest`` marks is walked through in one piece, so its marks move once; of larger ones
    the marks jump by joins.
    """
    checkpoint_folder(marks.sparkSession)
    large = marks.groupBy("doc").count().filter(F.col("count") > largest).select(F.col("doc").alias("whole")).checkpoint()
    kind = StructType([*marks.schema.fields, StructField("home", marks.schema["xref"].dataType), *[StructField(f"p_{c}", marks.schema[c].dataType) for c in of]])
    if large.isEmpty():
        return marks.groupBy("doc").applyInArrow(lambda t: _walked(t, of), kind)
    small = marks.join(large, F.col("doc").eqNullSafe(F.col("whole")), "left_anti").groupBy("doc").applyInArrow(lambda t: _walked(t, of), kind)
    rest = marks.join(large, F.col("doc").eqNullSafe(F.col("whole")), "left_semi")
    answered = rest.select(F.col("doc").alias("d"), F.col("xref").alias("x"), *[F.col(c).alias(f"p_{c}") for c in of])
    filled = rest.join(answered, (F.col("doc") == F.col("d")) & (F.col("irt") == F.col("x")) & F.coalesce("grouped", F.lit(False)), "left").drop("d", "x")
    far = _far_homes(rest).select(F.col("doc").alias("d"), F.col("xref").alias("x"), "home")
    return small.unionByName(filled.join(far, F.col("doc").eqNullSafe(F.col("d")) & F.col("xref").eqNullSafe(F.col("x"))).select(small.columns))


def _walked(t: pa.Table, of: list[str]) -> pa.Table:
    """One document's marks; each is passed once."""
    xref, irt, grouped = (t[c].to_pylist() for c in ("xref", "irt", "grouped"))
    there = t["doc"][0].as_py() is not None
    at = {x: i for i, x in enumerate(xref) if x is not None and there}
    answers = [at.get(u) for u in irt]
    to = [None if g or x is None else u for g, x, u in zip(grouped, xref, answers, strict=True)]
    home: list[int | None] = [None] * len(xref)
    for start in range(len(xref)):
        path, cur = [], start
        while home[cur] is None and to[cur] is not None and to[cur] != cur:
            home[cur] = -1
            path.append(cur)
            cur = to[cur]
        if home[cur] is None:
            home[cur] = cur
        elif home[cur] == -1:  # a loop: its marks stand for themselves
            for i in path[path.index(cur) :]:
                home[i] = i
        for i in path:
            home[i] = home[cur] if home[i] == -1 else home[i]
    # a mark without a name of its own has what it answers for a home, as far as that is there
    names = [xref[h] if x is not None or g or u is None else xref[u] for h, x, g, u in zip(home, xref, grouped, answers, strict=True)]
    primary = pa.array([u if g else None for g, u in zip(grouped, answers, strict=True)], pa.int64())
    t = t.append_column("home", pa.array(names, t["xref"].type))
    for c in of:
        t = t.append_column(f"p_{c}", t[c].take(primary))
    return t


def _far_homes(marks: DataFrame) -> DataFrame:
    """``homes`` by pointer jumping: in every round each mark learns the answer of the one it points to, so a thread of n
    replies takes log2(n) rounds. Loops are found as what unsettled marks point to after as many steps as there are
    of them, cut, and the rest is jumped anew.
    """
    own = marks.select("doc", "xref", F.when(~F.coalesce("grouped", F.lit(False)), F.col("irt")).alias("irt"))
    there = marks.select(F.col("doc").alias("d"), F.col("xref").alias("x")).distinct()
    first = own.join(there, (F.col("doc") == F.col("d")) & (F.col("irt") == F.col("x")), "left").select("doc", "xref", F.coalesce("x", "xref").alias("up"))
    settled, loops = _jumped(first)
    if loops is None:
        return settled.select("doc", "xref", F.col("up").alias("home"))
    cut = loops.select(F.col("doc").alias("d"), F.col("up").alias("x")).distinct()
    again = first.join(cut, (F.col("doc") == F.col("d")) & (F.col("xref") == F.col("x")), "left").select("doc", "xref", F.when(F.col("x").isNotNull(), F.col("xref")).otherwise(F.col("up")).alias("up"))
    return _jumped(again)[0].select("doc", "xref", F.col("up").alias("home"))


def _jumped(start: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Marks with the root they lead to, and those that lead into a loop (a mark of the loop as up), null if there are none."""
    state = start.withColumn("done", F.coalesce(F.col("up") == F.col("xref"), F.lit(True))).checkpoint()
    before, steps = None, 1
    while True:
        to = state.select(F.col("doc").alias("d"), F.col("xref").alias("x"), F.col("up").alias("next"), F.col("done").alias("ended"))
        moved = state.join(to, (F.col("doc") == F.col("d")) & (F.col("up") == F.col("x")), "left")
        state = moved.select("doc", "xref", F.when(F.col("done"), F.col("up")).otherwise(F.col("next")).alias("up"), (F.col("done") | F.col("ended")).alias("done")).checkpoint()
        steps *= 2
        left = state.filter("not done").groupBy("doc").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
        if not left["n"]:
            return state, None
        # depths have no gaps, so a round that settles nobody leaves only what leads into loops
        if left["n"] == before and steps >= left["most"]:
            return state, state.filter("not done")
        before = left["n"]


def threads(marks: DataFrame) -> DataFrame:
    """The entries: marks that are their own home, with replies (array of author, created, text, in order of seq).

    marks: doc, xref, irt, grouped, seq, author, created, comment. A grouped mark takes the author and time that it
    lacks from its primary; a reply without text is none.
    """
    blank = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    own = _resolved(marks, ["author", "created"])
    full = own.select("doc", "xref", "home", "seq", F.coalesce(blank(F.col("author")), blank(F.col("p_author"))).alias("author"), F.coalesce(blank(F.col("created")), blank(F.col("p_created"))).alias("created"), blank(F.col("comment")).alias("comment"))
    first, reply = F.struct("seq", "author", "created", "comment"), F.struct("seq", "author", "created", F.col("comment").alias("text"))
    # a thread is one group: its first mark and the answers with a text
    used = full.filter("xref = home or comment is not null").filter("home is not null and xref is not null")
    g = used.groupBy("doc", "home").agg(F.max(F.when(F.col("xref") == F.col("home"), first)).alias("e"), F.array_sort(F.collect_list(F.when(F.col("xref") != F.col("home"), reply))).alias("r"))
    entries = g.filter("e is not null").select("doc", F.col("home").alias("xref"), "e.*", "r")
    kept = F.transform("r", lambda x: F.struct(x["author"].alias("author"), x["created"].alias("created"), x["text"].alias("text")))
    return entries.withColumn("replies", F.coalesce(kept, F.array().cast(f"array<struct<author:{_kind(marks, 'author')},created:{_kind(marks, 'created')},text:string>>"))).drop("r")


def _kind(d: DataFrame, column: str) -> str:
    return d.schema[column].dataType.simpleString()


def overlapping(marks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Links (a, b) that join all marks of one kind whose boxes overlap on a line. marks: id, and the columns that must
    agree in a struct ``like``; boxes: id, x0, y0, x1, y1, any number a mark.

    Boxes meet in the cells of a grid. Equal boxes of one kind are one box, whose marks are joined in a star.
    """
    b = boxes.join(marks.select("id", F.to_json("like").alias("like")), "id")
    rect = ["x0", "y0", "x1", "y1"]
    kinds = b.groupBy("like", *rect).agg(F.min("id").alias("id"))
    star = b.select("like", *rect, F.col("id").alias("b")).join(kinds.withColumnRenamed("id", "a"), ["like", *rect]).filter("a <> b and x1 > x0").select("a", "b")
    cells = lambda low, high, size: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))
    one = kinds.select("*", cells("x0", "x1", CELL_WIDTH).alias("cx")).select("*", cells("y0", "y1", CELL_HEIGHT).alias("cy"))
    two = one.select("like", "cx", "cy", F.col("id").alias("b"), *[F.col(c).alias(f"{c}b") for c in rect])
    common = F.least("y1", "y1b") - F.greatest("y0", "y0b")
    same_line = common > 0.5 * F.greatest(F.lit(0.1), F.least(F.col("y1") - F.col("y0"), F.col("y1b") - F.col("y0b")))
    met = one.join(two, ["like", "cx", "cy"]).filter((F.col("id") < F.col("b")) & same_line & (F.least("x1", "x1b") > F.greatest("x0", "x0b")))
    return met.select(F.col("id").alias("a"), "b").unionByName(star).distinct()


def joined(rows: list[dict]) -> list[tuple[int, int]]:
    """(id, home) of marks in order: each joins the first one kept before whose area, with what it took in, it overlaps,
    unless both have comments that differ. rows: id, comment, boxes (x0, y0, x1, y1)."""
    kept: list[dict] = []
    out = []
    for r in rows:
        fits = lambda k, r=r: not (k["comment"] and r["comment"] and k["comment"] != r["comment"]) and _overlap(k["boxes"], r["boxes"])
        home = next(filter(fits, kept), None)
        if home is None:
            kept.append(home := dict(r))
        else:
            home["comment"], home["boxes"] = home["comment"] or r["comment"], home["boxes"] + r["boxes"]
        out.append((r["id"], home["id"]))
    return out


def _overlap(a: list, b: list) -> bool:
    for p in a:
        for q in b:
            if min(p["x1"], q["x1"]) > max(p["x0"], q["x0"]) and min(p["y1"], q["y1"]) - max(p["y0"], q["y0"]) > 0.5 * max(0.1, min(p["y1"] - p["y0"], q["y1"] - q["y0"])):
                return True
    return False


def double_marks(marks: DataFrame, boxes: DataFrame, most: int = TOGETHER) -> DataFrame:
    """id, home: of marks over the same words the first in order (``seq``) is the home of the others.

    marks: id, seq, comment, like (struct of document, page, kind, colour, author: all must agree); boxes: id, x0, y0,
    x1, y1.
    """
    own = boxes.groupBy("id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    return double_marks_of(marks.join(own, "id", "left"), most)


def double_marks_of(marks: DataFrame, most: int = TOGETHER) -> DataFrame:
    """As ``double_marks``, of marks with an array ``boxes``.

    Marks whose comments differ stay apart, so who joins whom depends on the order; that is settled mark by mark among marks
    of one kind, of which many kinds share a task. Where more than ``most`` marks may be of one kind it is settled within
    each connected group of overlapping boxes, which nothing outside it can change.
    """
    rows = marks.select("id", "seq", "comment", "like", "boxes", F.xxhash64(F.to_json("like")).alias("of"))
    sizes = rows.groupBy("of").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    packs = max(1, (sizes["n"] or 0) // PACK)
    if (sizes["most"] or 0) <= most:
        return _settled(rows, F.col("like"), packs)
    checkpoint_folder(marks.sparkSession)
    large = rows.groupBy("of").count().filter(F.col("count") > most).select("of").checkpoint()
    small, rest = rows.join(large, "of", "left_anti"), rows.join(large, "of", "left_semi")
    group = components(overlapping(rest.select("id", "like"), rest.select("id", F.explode("boxes").alias("b")).select("id", "b.*")))
    connected = rest.join(group, "id").withColumn("of", F.xxhash64("root"))
    alone = rest.join(group, "id", "left_anti").select("id", F.col("id").alias("home"))
    return _settled(small, F.col("like"), packs).unionByName(_settled(connected, F.struct("root"), packs)).unionByName(alone)


def _settled(rows: DataFrame, kind: Column, packs: int) -> DataFrame:
    """id, home: marks of one ``kind`` (a struct; a null one is of its own kind) joined in order, packs of kinds by the hash ``of``."""
    id_kind = rows.schema["id"].dataType

    def settle(t: pa.Table) -> pa.Table:
        met = _met(t)
        home = t["id"].to_numpy().copy() if not t["id"].null_count else np.array(t["id"].to_pylist(), object)
        kinds: dict[str, list[dict]] = {}
        for r in t.append_column("at", pa.array(np.arange(len(t)))).filter(pa.array(met)).to_pylist():
            if r["kind"] is not None:
                kinds.setdefault(str(r["kind"]), []).append({"seq": r["seq"], "of": r["id"], "id": r["at"], "comment": r["comment"] or "", "boxes": r["boxes"]})
        for own in kinds.values():
            for i, h in joined(sorted(own, key=lambda r: (r["seq"], r["of"]))):
                home[i] = t["id"][h].as_py()
        return pa.table({"id": t["id"], "home": pa.array(home, t["id"].type)})

    packed = rows.select("id", "seq", "comment", "boxes", "of", kind.alias("kind"), F.pmod("of", F.lit(packs)).alias("pack"))
    return packed.groupBy("pack").applyInArrow(settle, StructType([StructField("id", id_kind), StructField("home", id_kind)]))


def _met(t: pa.Table) -> np.ndarray:
    """Which marks (of, boxes) overlap another one with the same ``of``: boxes in order of their left ends, each with the next, the one after that and so on, as far as any reach."""
    lists = t["boxes"].combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x0, y0, x1, y1 = (lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
    owner, of = np.repeat(np.arange(len(t)), sizes), np.repeat(t["of"].to_numpy(), sizes)
    order = np.lexsort((x0, of))
    x0, y0, x1, y1, owner, of = (v[order] for v in (x0, y0, x1, y1, owner, of))
    out, left, step = np.zeros(len(t), bool), np.arange(len(order)), 0
    while len(left):
        step += 1
        left = left[left + step < len(order)]
        left = left[(of[left] == of[left + step]) & (x0[left + step] < x1[left])]
        a, b = left, left + step
        common = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        hit = (x1[b] > x0[b]) & (owner[a] != owner[b]) & (common > 0.5 * np.maximum(0.1, np.minimum(y1[a] - y0[a], y1[b] - y0[b])))
        out[owner[a[hit]]] = out[owner[b[hit]]] = True
    return out


def reading_order(boxes: DataFrame) -> DataFrame:
    """doc, page, id, line, place (both from 1): the boxes of a page line by line, each line from left to right.

    boxes: doc, page, id, x0, y0. A line begins with the topmost box left and holds all boxes at most 3 points below
    it. Tops more than 3 points apart from the next above never share a line, so a page falls into stretches
    that are cut into lines on their distinct tops; boxes of a line that begin at one place stand by top, then by id.
    """
    tops = boxes.select("doc", "page", "y0").distinct()
    down = Window.partitionBy("doc", "page").orderBy("y0")
    gap = F.coalesce(F.col("y0") - F.lag("y0").over(down) > SAME_LINE, F.lit(True))
    stretch = F.sum(gap.cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    of = tops.withColumn("stretch", stretch).groupBy("doc", "page", "stretch").agg(F.array_sort(F.collect_list("y0")).alias("ys"))
    start = F.struct(F.array().cast("array<struct<y0:double,top:double>>").alias("rows"), F.lit(None).cast("double").alias("top"))

    def step(acc, y):
        top = F.when(acc["top"].isNull() | (y - acc["top"] > SAME_LINE), y).otherwise(acc["top"])
        return F.struct(F.array_append(acc["rows"], F.struct(y.alias("y0"), top.alias("top"))).alias("rows"), top.alias("top"))

    lines = of.select("doc", "page", F.explode(F.aggregate("ys", start, step, lambda a: a["rows"])).alias("r")).select("doc", "page", "r.y0", "r.top")
    line = F.dense_rank().over(Window.partitionBy("doc", "page").orderBy("top"))
    place = F.row_number().over(Window.partitionBy("doc", "page", "top").orderBy("x0", "y0", "id"))
    numbered = lines.withColumn("line", line.cast("long"))
    return boxes.join(numbered, ["doc", "page", "y0"]).select("doc", "page", "id", "line", place.cast("long").alias("place"))
