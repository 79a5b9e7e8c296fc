"""Ranking: BM25, cosine, two-stage cosine, reciprocal rank fusion, the hybrid ladder, context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions.text import tokens

K1, B, RRF_K = 1.5, 0.75, 60


def query_terms(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """term, qtf of the query text(s): as many rows as a query has words."""
    return texts.select(F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(pool: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """id, score (> 0, to ten decimals, so that the order of summing decides no tie) of the pool's texts; N, mean length and frequencies are those of the pool.

    The texts are split once: the query is broadcast (a query text's words) and texts meet it in the scan, so what is shuffled is (text,
    term) pairs of query terms and one row a text, by which N and the mean length are counted. Frequencies and
    scores both read that one shuffle; a filter on terms above it would make two of it, hence none.
    """
    t = pool.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    p = t.select("id", F.size("t").alias("len"), F.explode(F.array_append("t", F.lit(""))).alias("term")).join(F.broadcast(terms), "term", "left").filter("qtf is not null or term = ''")
    p = p.groupBy("id", "term", "len", "qtf").agg(F.count(F.lit(1)).alias("tf"))
    of_text = lambda v: F.sum(F.when(F.col("qtf").isNull(), v))
    facts = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), of_text(F.col("tf")).alias("texts"), of_text(F.col("len") * F.col("tf")).alias("words"))
    facts = facts.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs"), F.max("texts").alias("n"), (F.max("words") / F.max("texts")).alias("mean"))
    p = p.crossJoin(F.broadcast(facts)).withColumn("df", F.try_element_at("dfs", F.col("term")))  # one row, a query's words
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return p.groupBy("id").agg(F.round(F.sum(part), 10).alias("score")).filter("score > 0")


def cosine(a: Column, b: Column) -> Column:
    """In double; 0 for empty, unequal or zero vectors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    usable = (F.size(x) > 0) & (F.size(x) == F.size(y))
    return F.when(usable & (norm > 0), dot(x, y) / norm).otherwise(F.lit(0.0))


def cosine_rank(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, score, rank: scores rounded to four places first, ties by id. ``query``: one row, vector."""
    return top(cosine_scores(vectors, query, id_col, vector_col), k)


def cosine_scores(vectors: DataFrame, query: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, score (to four places) of every row."""
    q = query.select(F.col("vector").alias("_q"))
    return vectors.crossJoin(F.broadcast(q)).select(F.col(id_col).alias("id"), F.round(cosine(F.col(vector_col), F.col("_q")), 4).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, then id, with rank from 1; ranks are given to k rows only."""
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(rankings: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, rank): score rounded after the sort; ties by list, then rank."""
    every = None
    for i, r in enumerate(rankings):
        part = r.select("id", "rank", F.lit(i).alias("list"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy("id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("raw"), F.min(F.struct("list", "rank")).alias("seen"))
    best = summed.withColumn("raw", F.round("raw", 12)).orderBy(F.desc("raw"), "seen").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("raw"), "seen"))
    return best.select("id", F.round("raw", 6).alias("score"), place.alias("rank"))


def places(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """id, rank of the given ids among all of ``scored`` (id, score; by score, then id); ids without a score have none.

    No ranking is sorted: the few ids' keys go to every task as one row, each row counts below which of them it falls,
    and the counts, one a key at most, are added up. ``ids`` is small, as its keys are one array.
    """
    key = F.struct((-F.col("score")).alias("s"), "id")
    found = scored.join(F.broadcast(ids.select("id")), "id", "left_semi").select(key.alias("k"))
    marks = found.agg(F.sort_array(F.collect_list("k")).alias("marks"))  # one row
    before = F.size(F.filter("marks", lambda m: m <= key))  # the keys from here on have this row before them
    counts = scored.crossJoin(F.broadcast(marks)).groupBy(before.alias("j")).agg(F.count(F.lit(1)).alias("n"))
    keys = marks.select(F.posexplode("marks").alias("j", "k")).join(counts, "j", "left")
    rank = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)) + 1
    return keys.select(F.col("k.id").alias("id"), rank.alias("rank"))


def fuse_whole(scores: list[DataFrame], k: int, constant: int = RRF_K) -> DataFrame:
    """id, score, rank: reciprocal rank fusion of whole rankings (id, score; ids unique and not null), exact and without
    sorting any of them as a whole.

    Of m rankings, what stands in none of their first m * (constant + k) - constant places sums to less than
    1 / (constant + k), and k ids have that much or more, unless no ranking is as long and these places are all there is. So the heads hold
    the k best, and only the exact places of what stands in another's head are looked for (``places``).
    """
    depth = len(scores) * (constant + k) - constant
    heads = [top(s.select("id", "score"), depth).select("id", "rank") for s in scores]
    every = heads[0].select("id")
    for h in heads[1:]:
        every = every.unionByName(h.select("id"))
    every = every.distinct()  # at most depth rows a ranking
    ranks = [h.unionByName(places(s.select("id", "score"), every.join(F.broadcast(h), "id", "left_anti"))) for s, h in zip(scores, heads)]
    return fuse(ranks, k, constant)


def two_stage(groups: DataFrame, members: DataFrame, query: DataFrame, k_groups: int = 20, k: int = 10) -> DataFrame:
    """Top groups by their vector, then top members of those groups only (groups, members: id, group, vector)."""
    chosen = cosine_rank(groups, query, k_groups).select(F.col("id").alias("group"))
    return cosine_rank(members.join(F.broadcast(chosen), "group", "left_semi"), query, k)


def context(hits: DataFrame) -> DataFrame:
    """Sources in the order of their best hit: number, pages (distinct, ascending), preview of 300 characters.

    hits: rank, paper_id, page, text."""
    g = hits.groupBy("paper_id").agg(F.min("rank").alias("first"), F.sort_array(F.collect_set("page")).alias("pages"), F.min_by("text", "rank").alias("text"))
    return g.select(F.row_number().over(Window.orderBy("first")).alias("number"), "paper_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.substring("text", 1, 300).alias("preview"))
