"""Search ladders over papers and passages, built from the ranking operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.functions.text import tokens
from scriptoria.operators import retrieval as R
from scriptoria.session import checkpoint_folder


def hybrid(pool: DataFrame, terms: DataFrame, vectors: DataFrame | None, query: DataFrame | None, k: int = 10, depth: int = 50) -> DataFrame:
    """mode, id, score, rank. No vectors (none stored, no model, no query vector): BM25 alone.

    The mode depends on whether either ranking has a row, so it is a column of the one plan, not a branch
    of the driver; only a missing frame is decided beforehand.
    """
    lexical = R.top(R.bm25(pool, terms), depth)
    if vectors is None or query is None:
        return lexical.limit(k).select(F.lit("bm25").alias("mode"), "id", F.round("score", 4).alias("score"), "rank")
    semantic = R.cosine_rank(vectors, query, depth)
    has = semantic.agg((F.count(F.lit(1)) > 0).alias("s")).crossJoin(lexical.agg((F.count(F.lit(1)) > 0).alias("l")))
    mode = F.when(~F.col("s"), F.lit("bm25")).when(~F.col("l"), F.lit("semantic")).otherwise(F.lit("hybrid"))
    return R.fuse([semantic, lexical], k).crossJoin(F.broadcast(has)).select(mode.alias("mode"), "id", "score", "rank")


#: Words of the starts of a passage that are looked for, the longest first; a start shorter than this is no place.
STARTS, LEAST_START = (12, 8, 5), 16


def locate(passage: Column, page: Column) -> Column:
    """The longest start of the passage that stands on the page, folded, if it stands there once; else null. Line-end
    hyphens of the page are closed. One that stands there more often is no answer, nor is any shorter one."""
    flat = lambda t: F.trim(F.regexp_replace(F.replace(F.coalesce(t, F.lit("")), F.lit("\u00ad"), F.lit("")), r"\s+", " "))
    words, on = F.split(flat(passage), " "), F.lower(flat(F.regexp_replace(page, r"-\s*\n\s*", "")))
    out = F.lit(None).cast("string")
    for n in reversed(STARTS):
        start = F.array_join(F.slice(words, 1, n), " ")
        times = (F.length(on) - F.length(F.replace(on, F.lower(start), F.lit("")))) / F.greatest(F.length(start), F.lit(1))
        out = F.when((F.length(start) < LEAST_START) | (times == 0), out).when(times == 1, start)
    return out


def within(pool: DataFrame, terms: DataFrame, vectors: DataFrame, query: DataFrame, ids: DataFrame, k: int = 8) -> DataFrame:
    """mode, id, score, rank: one-stage search in what a reader chose (ids: id). Both rankings are of the whole
    choice, and their statistics are the choice's own. Without vectors lexical alone,
    without lexical hits semantic alone. pool: doc_id, text; vectors: id, vector."""
    chosen = ids.select("id").distinct()
    texts, known = pool.join(chosen.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), vectors.join(chosen, "id", "left_semi")
    lexical = R.bm25(texts, terms)
    if known.isEmpty():
        return R.top(lexical, k).select(F.lit("bm25").alias("mode"), "id", "score", "rank")
    if not _met(texts, terms):
        return R.cosine_rank(known, query, k).select(F.lit("semantic").alias("mode"), "id", "score", "rank")
    return R.fuse_whole([R.cosine_scores(known, query), lexical], k).select(F.lit("hybrid").alias("mode"), "id", "score", "rank")


#: Papers whose passages a search looks at.
NEAR_PAPERS = 20


def _met(pool: DataFrame, terms: DataFrame) -> bool:
    """Whether a text of the pool has a word of the query; a text that has one scores above 0. Ends at the first such text."""
    words = F.broadcast(terms.agg(F.collect_set("term").alias("_words")))  # the words of one query
    return not pool.select("text").crossJoin(words).filter(F.arrays_overlap(tokens(F.col("text")), "_words")).isEmpty()


def _answer(ranked: DataFrame, mode: str, note: str = "") -> DataFrame:
    return ranked.select(F.lit(mode).alias("mode"), F.lit(note).alias("note"), "id", F.round("score", 6).alias("score"), "rank")


def search_papers(papers: DataFrame, chunks: DataFrame, q: str, vectors: DataFrame | None, query: DataFrame | None, k: int = 10) -> DataFrame:
    """mode, note, id, score, rank of the k best papers for the text ``q``.

    papers: id, title, abstract; chunks: paper_id, chunk_id, text; vectors: id, vector of one model, None without a model;
    query: one row, vector, None where it could not be made. Without model, vectors or query vector: BM25 over title and
    abstract, and the note says which. Else the papers' vectors and, where a chunk has a word of ``q``, their best chunks by
    BM25, both rankings whole, are fused. A blank ``q`` finds nothing. Vectors of papers that are not there, and chunks
    without an id or paper, are left out; null title or abstract is empty; k is at least 1; ties go to the lower id.
    """
    if not (q or "").strip():
        return _nothing(papers)
    k, terms = max(1, k), R.query_terms(papers.sparkSession.range(1).select(F.lit(q).alias("text")))
    known = None if vectors is None else vectors.join(papers.select("id"), "id", "left_semi")
    if known is None or query is None or vectors.isEmpty():
        whole = papers.select("id", F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text")).filter("text <> '\\n'")
        note = "" if vectors is None else "not_embedded" if query is None and not vectors.isEmpty() else "no_vectors"
        return _answer(R.top(R.bm25(whole, terms, "id"), k), "bm25", note)
    there = _whole_chunks(chunks, papers)
    if not _met(there, terms):
        return _answer(R.cosine_rank(known, query, k), "semantic")
    lexical = R.bm25(there, terms, "id").groupBy(F.col("id.paper_id").alias("id")).agg(F.max("score").alias("score"))
    return _answer(R.fuse_whole([R.cosine_scores(known, query), lexical], k), "hybrid")


def search_passages(papers: DataFrame, chunks: DataFrame, q: str, vectors: DataFrame | None, chunk_vectors: DataFrame | None, query: DataFrame | None, k: int = 10, n_papers: int = NEAR_PAPERS) -> DataFrame:
    """mode, note, id (paper_id, chunk_id), score, rank of the k best passages for the text ``q``.

    First the ``n_papers`` nearest papers by their vectors, then their chunks by theirs. BM25 runs over all chunks of those
    papers that have a ranked one, so both rankings are of one pool, whole, and are fused. Without model (vectors None), without vectors
    of papers or of chunks, or without query vector: BM25 over all chunks, and the note says which. Near papers without
    any chunk vector: semantic, no rows. Tables as for ``search_papers``; chunk_vectors: paper_id, chunk_id, vector.
    """
    every = chunks.filter("paper_id is not null and chunk_id is not null").select(F.struct("paper_id", "chunk_id").alias("id"), "paper_id", "chunk_id", "text")
    if not (q or "").strip():
        return _nothing(every)
    k, terms = max(1, k), R.query_terms(papers.sparkSession.range(1).select(F.lit(q).alias("text")))
    lexical = lambda note: _answer(R.top(R.bm25(every, terms, "id"), k), "bm25", note)
    if vectors is None or chunk_vectors is None:
        return lexical("" if vectors is None else "no_index")
    if query is None:
        some = [r["id"] for r in vectors.select("id").filter("id is not null").limit(n_papers).collect()]
        indexed = not chunk_vectors.filter(F.col("paper_id").isin(some)).isEmpty() or _indexed(vectors, chunk_vectors)
        return lexical("not_embedded" if indexed else "no_index")
    # the ids of n_papers papers, as values: with them tables are read where they lie, before texts are cut or joined
    near = [r["id"] for r in R.cosine_rank(vectors.join(papers.select("id"), "id", "left_semi"), query, n_papers).collect()]
    checkpoint_folder(papers.sparkSession)
    stored = chunk_vectors.filter(F.col("paper_id").isin(near)).select("paper_id", "chunk_id", "vector").checkpoint()
    if stored.isEmpty() and not _indexed(vectors, chunk_vectors):
        return lexical("no_index")
    own = every.filter(F.col("paper_id").isin(near)).checkpoint()
    ranked = stored.join(own.select("paper_id", "chunk_id"), ["paper_id", "chunk_id"], "left_semi").select(F.struct("paper_id", "chunk_id").alias("id"), "paper_id", "vector")
    if ranked.isEmpty():
        return _answer(R.cosine_rank(ranked, query, k), "semantic")
    pool = own.join(F.broadcast(ranked.select("paper_id").distinct()), "paper_id", "left_semi")
    if not _met(pool, terms):
        return _answer(R.cosine_rank(ranked, query, k), "semantic")
    return _answer(R.fuse_whole([R.cosine_scores(ranked, query), R.bm25(pool, terms, "id")], k), "hybrid")


def _nothing(rows: DataFrame) -> DataFrame:
    """The answer to a blank text, for which no text is read. rows: id."""
    return _answer(rows.filter("false").select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")), "bm25")


def _indexed(vectors: DataFrame, chunk_vectors: DataFrame) -> bool:
    return not vectors.isEmpty() and not chunk_vectors.isEmpty()


def _whole_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """id (paper_id, chunk_id), text of the chunks of papers that are there."""
    c = chunks.filter("paper_id is not null and chunk_id is not null").join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return c.select(F.struct("paper_id", "chunk_id").alias("id"), "text")


def semantic_or_lexical(semantic: DataFrame | None, lexical: DataFrame) -> DataFrame:
    """mode, id: the semantic list, also an empty one; the lexical list only where there is none at all (None: no vectors of the model)."""
    if semantic is None:
        return lexical.select(F.lit("lexical").alias("mode"), "id")
    return semantic.select(F.lit("semantic").alias("mode"), "id")
