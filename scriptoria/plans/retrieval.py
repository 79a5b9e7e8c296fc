"""Queries on ranking, over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators import retrieval as R
from scriptoria.operators import search as S
from scriptoria.plans.base import TITLE
from scriptoria.plans.registry import query
from scriptoria.session import table

TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}')"


def bm25_sql(pool: str, terms: str, name: str) -> str:
    """CTEs ending in ``name`` (id, score); pool: id, text; terms: term, qtf."""
    return f"""
{name}_t AS (SELECT id, {TOKENS} AS t FROM {pool}),
{name}_p AS (SELECT id, term, len, qtf, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM {name}_t) JOIN {terms} USING (term) GROUP BY ALL),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {name}_t),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name} AS (
  SELECT id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 10) AS score
  FROM {name}_p JOIN {name}_d USING (term), {name}_s GROUP BY id HAVING score > 0)"""


def terms_sql(where: str) -> str:
    return f"terms AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({TOKENS}) AS term FROM benchmark WHERE {where}) GROUP BY term)"


def cosine_sql(a: str, b: str) -> str:
    return f"CASE WHEN list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) IS NULL THEN 0 ELSE round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 4) END"


def terms(spark: SparkSession, sf_dir: str, item: int = 0) -> DataFrame:
    return R.query_terms(table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item))


@query("bm25_topk", "S2 R1 R2 W2 A10", f"""
WITH {terms_sql("item_id = 0")}, pool AS (SELECT doc_id AS id, text FROM documents), {bm25_sql("pool", "terms", "scored")}
SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top(R.bm25(table(spark, sf_dir, "documents"), terms(spark, sf_dir)), 10)
    return best.select("id", F.round("score", 4).alias("score"), "rank")


@query("bm25_best_chunk_per_doc", "W3 S8", f"""
WITH {terms_sql("item_id = 1")},
pool AS (SELECT {{'d': doc_id, 'i': i}} AS id, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) WHERE trim(line) <> ''),
{bm25_sql("pool", "terms", "scored")},
best AS (SELECT id.d AS id, max(score) AS score FROM scored GROUP BY ALL)
SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM best QUALIFY rank <= 20""")
def bm25_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are the chunks; documents rank by their best one."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).filter(F.trim("text") != "")
    scored = R.bm25(chunks.withColumn("chunk_id", F.struct("doc_id", "i")), terms(spark, sf_dir, 1), "chunk_id")
    best = scored.groupBy(F.col("id.doc_id").alias("id")).agg(F.max("score").alias("score"))
    return R.top(best, 20).select("id", F.round("score", 4).alias("score"), "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    return e, e.filter("id = 7").select("vector")


@query("cosine_topk", "R3 W1 R15 S4", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT vec_id AS id, {cosine_sql("embedding", "q.v")} AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
FROM embeddings, q QUALIFY rank <= 20""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    return R.cosine_rank(e, q, 20)


GROUPS_SQL = """
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
groups AS (SELECT label AS id, list(m ORDER BY k) AS v FROM (SELECT label, k, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k) GROUP BY label)"""


@query("two_stage_cosine", "W5", f"""
WITH {GROUPS_SQL},
g AS (SELECT id, {cosine_sql("groups.v", "q.v")} AS s FROM groups, q ORDER BY s DESC, id LIMIT 3)
SELECT vec_id AS id, {cosine_sql("embedding", "q.v")} AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
FROM embeddings, q WHERE label IN (SELECT id FROM g) QUALIFY rank <= 10""")
def two_stage_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for papers (mean vector), embeddings for their chunks."""
    e, q = _vectors(spark, sf_dir)
    means = e.select("group", F.posexplode("vector").alias("k", "x")).groupBy("group", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    groups = means.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("vector"))
    return R.two_stage(groups.withColumnRenamed("group", "id"), e, q, 3, 10)


HYBRID = f"""
WITH {terms_sql("item_id = 0")}, pool AS (SELECT doc_id AS id, text FROM documents), {bm25_sql("pool", "terms", "scored")},
lexical AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 50),
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
semantic AS (SELECT vec_id AS id, {cosine_sql("embedding", "q.v")} AS s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM embeddings, q QUALIFY rank <= 50),
every AS (SELECT id, rank, 0 AS list FROM semantic UNION ALL SELECT id, rank, 1 FROM lexical),
summed AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS raw, min(list * 1000 + rank) AS seen FROM every GROUP BY id)
"""


@query("rrf_fusion", "W4", HYBRID + "SELECT id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw DESC, seen) AS rank FROM summed QUALIFY rank <= 20")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = _vectors(spark, sf_dir)
    semantic = R.cosine_rank(e, q, 50)
    lexical = R.top(R.bm25(table(spark, sf_dir, "documents"), terms(spark, sf_dir)), 50)
    return R.fuse([semantic, lexical], 20)


@query("hybrid_mode", "R4 R5", HYBRID + """
, fused AS (SELECT id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw DESC, seen) AS rank FROM summed QUALIFY rank <= 10)
SELECT CASE WHEN (SELECT count(*) FROM semantic) = 0 THEN 'bm25' WHEN (SELECT count(*) FROM lexical) = 0 THEN 'semantic' ELSE 'hybrid' END AS mode, id, score, rank FROM fused""")
def hybrid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder: without vectors lexical, without lexical hits semantic, else both fused."""
    from scriptoria.operators.search import hybrid

    e, q = _vectors(spark, sf_dir)
    return hybrid(table(spark, sf_dir, "documents"), terms(spark, sf_dir), e, q, 10)


@query("chosen_search", "R6 R7", f"""
WITH {terms_sql("item_id = 0")}, pool AS (SELECT doc_id AS id, text FROM documents WHERE lang = 'en'), {bm25_sql("pool", "terms", "scored")}
SELECT 'bm25' AS mode, id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 8""")
def chosen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the English documents, of which the model asked for has no vectors; the tests hold the other modes."""
    from scriptoria.operators.search import within

    e, q = _vectors(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    return within(d, terms(spark, sf_dir), e.filter("false"), q, d.filter("lang = 'en'").select(F.col("doc_id").alias("id")))


@query("search_context", "R8 P18", f"""
WITH {terms_sql("item_id = 2")},
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS text FROM documents),
pool AS (SELECT {{'d': doc_id, 'i': page}} AS id, text FROM lines WHERE trim(text) <> ''), {bm25_sql("pool", "terms", "scored")},
hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 30),
g AS (SELECT id.d AS paper_id, min(rank) AS first, list_sort(list(DISTINCT id.i)) AS pages, arg_min(text, rank) AS text FROM hits JOIN pool USING (id) GROUP BY ALL)
SELECT row_number() OVER (ORDER BY first) AS number, paper_id, array_to_string(pages, ',') AS pages, substr(text, 1, 300) AS preview FROM g""")
def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).filter(F.trim("text") != "")
    chunks = chunks.withColumn("id", F.struct("doc_id", "page"))
    hits = R.top(R.bm25(chunks, terms(spark, sf_dir, 2), "id"), 30)
    return R.context(chunks.join(F.broadcast(hits.select("id", "rank")), "id").select("rank", F.col("doc_id").alias("paper_id"), "page", "text"))


@query("bm25_corpus_stats", "A10", f"""
WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM t) AS n, (SELECT round(avg(len(t)), 6) FROM t) AS mean_length FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term""")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("t"))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("t")), 6).alias("mean_length"))
    df = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", "n", "mean_length")


@query("last_n_turns", "W14", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 6")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))
    return table(spark, sf_dir, "conversations").withColumn("place", place).filter("place <= 6").select("conv_id", "turn", "role")


@query("embedding_text", "R11 R12", """
WITH d AS (SELECT doc_id, trim(split_part(text, chr(10), 1)) AS title, lang, source, text FROM documents)
SELECT doc_id, substr(title, 1, 200) || CASE WHEN coalesce(lang, '') <> '' OR coalesce(source, '') <> '' THEN ' (' || concat_ws(', ', nullif(lang, ''), nullif(source, '')) || ')' ELSE '' END AS header, length(substr(text, 1, 1500)) AS substitute_length FROM d""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header "Title (year, journal)" that leaves out what is missing, and the substitute for a missing abstract."""
    title = F.substring(F.trim(F.get(F.split("text", "\n"), F.lit(0))), 1, 200)
    both = F.concat_ws(", ", F.nullif("lang", F.lit("")), F.nullif("source", F.lit("")))
    header = F.concat(title, F.when(both != "", F.concat(F.lit(" ("), both, F.lit(")"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", header.alias("header"), F.length(F.substring("text", 1, 1500)).alias("substitute_length"))


LADDER = f"""
WITH {terms_sql("item_id = 3")},
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS text FROM documents),
chunks AS (SELECT {{'p': doc_id, 'c': i}} AS id, doc_id, i, text FROM lines WHERE trim(text) <> ''),
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
near AS (SELECT doc_id AS id, {cosine_sql("embedding", "q.v")} AS score FROM documents JOIN embeddings ON vec_id = doc_id, q),"""


def fused_sql(semantic: str, lexical: str, name: str, k: int) -> str:
    """CTEs ending in ``name`` (id, score, rank) from whole rankings (id, score)."""
    return f"""
{name}_r AS (SELECT id, 0 AS l, row_number() OVER (ORDER BY score DESC, id) AS r FROM {semantic} UNION ALL SELECT id, 1, row_number() OVER (ORDER BY score DESC, id) FROM {lexical}),
{name}_s AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS raw, min({{'l': l, 'r': r}}) AS seen FROM {name}_r GROUP BY id),
{name} AS (SELECT id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw DESC, seen) AS rank FROM {name}_s QUALIFY rank <= {k})"""


def _best_sql(scored: str, k: int) -> str:
    return f"SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {scored} QUALIFY rank <= {k}"


def _shelf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """Papers, their lines as chunks, vectors of papers (not of all) and of chunks (two of three), the query's vector and text."""
    d = table(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("id"), T.title_of(F.col("text")).alias("title"), F.col("text").alias("abstract"))
    chunks = d.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("chunk_id", "text")).filter(F.trim("text") != "")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = F.broadcast(e.agg(F.count(F.lit(1)).alias("n")))  # one row
    keyed = chunks.filter("chunk_id % 3 <> 2").crossJoin(n).select("paper_id", "chunk_id", ((F.col("paper_id") * 31 + F.col("chunk_id")) % F.col("n")).alias("id"))
    q = table(spark, sf_dir, "benchmark").filter("item_id = 3").select("text").first()
    return papers, chunks, e, keyed.join(e, "id").drop("id"), e.filter("id = 7").select("vector"), q["text"] if q else ""


def _steps(answers: dict[str, DataFrame]) -> DataFrame:
    every = None
    for step, found in answers.items():
        found = found.select(F.lit(step).alias("step"), "*")
        every = found if every is None else every.unionByName(found)
    return every


@query("paper_search", "R4", f"""{LADDER}
whole AS (SELECT doc_id AS id, {TITLE} || chr(10) || coalesce(text, '') AS text FROM documents WHERE coalesce(text, '') <> ''), {bm25_sql("whole", "terms", "plain")},
{bm25_sql("chunks", "terms", "passages")}, best AS (SELECT id.p AS id, max(score) AS score FROM passages GROUP BY 1), {fused_sql("near", "best", "fused", 20)},
lexical AS ({_best_sql("plain", 20)}), semantic AS ({_best_sql("near", 20)})
SELECT 'whole' AS step, 'hybrid' AS mode, '' AS note, * FROM fused
UNION ALL SELECT c.c, 'bm25', c.n, lexical.* FROM lexical, (VALUES ('no model', ''), ('no vectors', 'no_vectors'), ('not embedded', 'not_embedded')) AS c(c, n)
UNION ALL SELECT 'no words', 'semantic', '', * FROM semantic""")
def paper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the ladder over all documents; a query of marks alone has no words."""
    papers, chunks, e, _, v, q = _shelf(spark, sf_dir)
    ask = lambda text, vectors, query: S.search_papers(papers, chunks, text, vectors, query, 20)
    return _steps({"whole": ask(q, e, v), "no model": ask(q, None, v), "no vectors": ask(q, e.filter("false"), v), "not embedded": ask(q, e, None), "no words": ask("?!", e, v), "blank": ask(" ", e, v)})


@query("passage_search", "R5", f"""{LADDER}
papers20 AS (SELECT id FROM near ORDER BY score DESC, id LIMIT 20),
ranked AS (SELECT c.id, {cosine_sql("embedding", "q.v")} AS score FROM chunks c JOIN papers20 n ON n.id = doc_id JOIN embeddings ON vec_id = (doc_id * 31 + i) % (SELECT count(*) FROM embeddings), q WHERE i % 3 <> 2),
pool AS (SELECT * FROM chunks WHERE doc_id IN (SELECT id.p FROM ranked)), {bm25_sql("pool", "terms", "within")}, {fused_sql("ranked", "within", "fused", 20)},
{bm25_sql("chunks", "terms", "passages")}, lexical AS ({_best_sql("passages", 20)}), semantic AS ({_best_sql("ranked", 20)}),
found AS (
  SELECT 'whole' AS step, 'hybrid' AS mode, '' AS note, * FROM fused
  UNION ALL SELECT c.c, 'bm25', c.n, lexical.* FROM lexical, (VALUES ('no model', ''), ('no index', 'no_index'), ('not embedded', 'not_embedded')) AS c(c, n)
  UNION ALL SELECT 'no words', 'semantic', '', * FROM semantic)
SELECT step, mode, note, id.p AS paper_id, id.c AS chunk_id, score, rank FROM found""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the ladder over all lines of all documents."""
    papers, chunks, e, ce, v, q = _shelf(spark, sf_dir)
    ask = lambda text, vectors, parts, query: S.search_passages(papers, chunks, text, vectors, parts, query, 20)
    found = _steps({"whole": ask(q, e, ce, v), "no model": ask(q, None, ce, v), "no index": ask(q, e, ce.filter("false"), v), "not embedded": ask(q, e, ce, None), "no words": ask("?!", e, ce, v), "blank": ask("", e, ce, v)})
    return found.select("step", "mode", "note", "id.*", "score", "rank")
