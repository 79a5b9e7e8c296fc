"""Substring dedup by fixed-block anchors: exact, without pairs of documents.

Any ``WINDOW`` = 13 consecutive words of a document hold one whole block of its non-overlapping 7-word
blocks, as 13 = 2 * 7 - 1. So a window that two documents share makes the blocks of one of them equal to
7-word windows of the other, whatever the offsets.

1. Every chunk of documents sends each distinct rolling 7-word hash once, marked where it is an aligned
   block: the blocks are the index, the rolling windows probe it.
2. Hash buckets answer a chunk with those hashes that are a block of some document and stand in two or more.
3. Hits are extended: all 13-word windows around a hit go out, once a chunk, with the chunk's least doc_id;
   buckets answer with the windows that stand in a document with a smaller id than any of the chunk's.
   Overlapping windows join to maximal repeats.
4. The chunk removes what the answers and its own documents cover.

A passage that millions of documents share is sent once a chunk, never once a document, and answers are
as large as questions at most. Step 1 keeps 30 bits of a hash besides its bucket: a false hit only costs
an extension. Step 3 compares 64 bits besides the bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.text import by_bucket, chunks_for, hash_texts, split_words, unique_hashes, window_hashes, with_chunk

BLOCK = 7
WINDOW = 2 * BLOCK - 1
_NO_ID = (1 << 63) - 1


class Chunk:
    """Words of a chunk's documents in one array of hashes; documents too short for a window are left out."""

    def __init__(self, texts: list[str | None], ids: np.ndarray, block: int):
        self.block, self.window = block, 2 * block - 1
        flat, sizes = hash_texts(texts)
        self.long = np.flatnonzero(sizes >= self.window)
        self.hashes = flat[np.repeat(sizes >= self.window, sizes)]
        self.sizes = sizes[self.long]
        self.at = np.cumsum(self.sizes) - self.sizes
        self.ids = np.asarray(ids, np.int64)[self.long]

    def starts(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a window of ``width`` words begins within one document, and that document."""
        doc = np.repeat(np.arange(len(self.long)), self.sizes)
        left = np.repeat(self.at + self.sizes, self.sizes) - np.arange(len(self.hashes))
        at = np.flatnonzero(left >= width)
        return at, doc[at]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, doc = self.starts(self.block)
        return window_hashes(self.hashes, self.block, 1)[at], at, doc

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, doc = self.starts(self.window)
        return window_hashes(self.hashes, self.window, 2)[at], at, doc


def _ids(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["_id"].to_numpy(np.int64)


def _probe(pdf: pd.DataFrame, block: int, n: int) -> pd.DataFrame:
    c = Chunk(pdf["_text"].tolist(), _ids(pdf), block)
    h, at, doc = c.blocks()
    aligned = (at - c.at[doc]) % block == 0
    u, first, order = unique_hashes(h)
    if not len(u):
        return pd.DataFrame({"bucket": [], "chunk": [], "found": []})
    d = doc[order]
    marks = np.maximum.reduceat(aligned[order], first).astype(np.uint32) + np.uint32(2) * (np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first))
    _, cuts = by_bucket(u, n)
    packed = ((u & np.uint64(0x3FFFFFFF)).astype(np.uint32) << np.uint32(2)) | marks
    full = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"bucket": full, "chunk": int(pdf["chunk"].iloc[0]), "found": [packed[cuts[b] : cuts[b + 1]].tobytes() for b in full]})


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(x, np.uint32) for x in pdf["found"]]
    value = np.concatenate(parts)
    chunk = np.repeat(pdf["chunk"].to_numpy(), [len(p) for p in parts])
    key = value >> np.uint32(2)
    order = np.argsort(key, kind="stable")
    key, chunk, mark = key[order], chunk[order], value[order] & np.uint32(3)
    first = np.append(True, key[1:] != key[:-1])
    begins = np.flatnonzero(first)
    both = np.bitwise_or.reduceat(mark, begins)
    size = np.diff(np.append(begins, len(key)))
    wanted = ((both & 1) > 0) & ((size > 1) | ((both & 2) > 0))
    keep = wanted[np.cumsum(first) - 1]
    key, chunk = key[keep], chunk[keep]
    order = np.lexsort((key, chunk))
    key, chunk = key[order], chunk[order]
    who, at = np.unique(chunk, return_index=True)
    cuts = np.append(at, len(key))
    return pd.DataFrame({"chunk": who, "bucket": int(pdf["bucket"].iloc[0]), "found": [key[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def _extend(docs: pd.DataFrame, hits: pd.DataFrame, block: int, n: int) -> pd.DataFrame:
    none = pd.DataFrame({"bucket": [], "chunk": [], "found": [], "ids": []})
    if not len(docs) or not len(hits):
        return none
    c = Chunk(docs["_text"].tolist(), _ids(docs), block)
    h, at, _ = c.blocks()
    bucket = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    wanted = np.sort(np.concatenate([np.frombuffer(f, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, f in zip(hits["bucket"], hits["found"], strict=True)]))
    mine = (h & np.uint64(0x3FFFFFFF)) | (bucket << np.uint64(32))
    where = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
    hit = np.zeros(len(c.hashes) + c.window, np.int64)
    hit[at] = wanted[where] == mine
    total = np.concatenate([[0], np.cumsum(hit)])
    g, start, doc = c.windows()
    near = total[start + block] > total[start]  # a block within the window begins at start .. start + block - 1
    g, doc = g[near], doc[near]
    u, first, order = unique_hashes(g)
    if not len(u):
        return none
    least = np.minimum.reduceat(c.ids[doc[order]], first)
    _, cuts = by_bucket(u, n)
    full = np.flatnonzero(np.diff(cuts))
    cut = [(cuts[b], cuts[b + 1]) for b in full]
    return pd.DataFrame({"bucket": full, "chunk": int(docs["chunk"].iloc[0]), "found": [u[a:b].tobytes() for a, b in cut], "ids": [least[a:b].tobytes() for a, b in cut]})


def _earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(x, np.uint64) for x in pdf["found"]]
    g, ids = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    chunk = np.repeat(pdf["chunk"].to_numpy(), [len(p) for p in parts])
    order = np.argsort(g, kind="stable")
    g, ids, chunk = g[order], ids[order], chunk[order]
    first = np.append(True, g[1:] != g[:-1])
    least = np.minimum.reduceat(ids, np.flatnonzero(first))[np.cumsum(first) - 1]
    late = least < ids
    g, chunk = g[late], chunk[late]
    order = np.lexsort((g, chunk))
    g, chunk = g[order], chunk[order]
    who, at = np.unique(chunk, return_index=True)
    cuts = np.append(at, len(g))
    return pd.DataFrame({"chunk": who, "found": [g[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})


def _remove(docs: pd.DataFrame, late: pd.DataFrame, block: int) -> pd.DataFrame:
    c = Chunk(docs["_text"].tolist(), _ids(docs), block)
    g, start, doc = c.windows()
    gone = np.zeros(len(g), bool)
    if len(g):
        u, first, order = unique_hashes(g)
        least = np.minimum.reduceat(c.ids[doc[order]], first)
        which = np.empty(len(g), np.int64)
        which[order] = np.repeat(np.arange(len(u)), np.diff(np.append(first, len(g))))
        gone = c.ids[doc] > least[which]
        if len(late):
            asked = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in late["found"]]))
            if len(asked):
                where = np.minimum(np.searchsorted(asked, u), len(asked) - 1)
                gone |= (asked[where] == u)[which]
    change = np.zeros(len(c.hashes) + 1, np.int64)
    np.add.at(change, start[gone], 1)
    np.add.at(change, start[gone] + c.window, -1)
    covered = np.cumsum(change)[:-1] > 0
    place = {int(i): k for k, i in enumerate(c.long)}
    kept, removed, sizes = [], [], []
    for i, words in enumerate(map(split_words, docs["_text"])):
        sizes.append(len(words))
        k = place.get(i)
        out = covered[c.at[k] : c.at[k] + c.sizes[k]] if k is not None else None
        if out is not None and out.any():
            words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
        kept.append(b" ".join(words).decode("utf-8", "replace"))
        removed.append(int(out.sum()) if out is not None else 0)
    extra = docs.drop(columns=["_text", "_id", "chunk"])
    return extra.assign(kept_text=kept, n_words=sizes, n_removed=removed)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without ``text_col`` but with kept_text, n_words, n_removed (long).

    A word goes if a window of 2 * block - 1 words that covers it also starts in a document with a smaller
    id; kept words are joined by one space. Equal ids don't remove each other's words; a null id is larger
    than any other and removes nothing. Null texts have no words. Other columns pass unchanged (columns
    named kept_text, n_words or n_removed are replaced); an empty table gives no rows.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    n = chunks_for(docs, text_col, chunk_bytes)
    extra = [f for f in docs.schema.fields if f.name not in (text_col, "kept_text", "n_words", "n_removed")]
    # the others travel under numbers, so that no name of theirs can clash
    d = docs.select(*[F.col(f.name).alias(f"_{k}") for k, f in enumerate(extra)], F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.col(text_col).alias("_text"))
    x = with_chunk(d, n, "_id", "_text")
    out = StructType([*[StructField(f"_{k}", f.dataType) for k, f in enumerate(extra)], StructField("kept_text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    asked = x.groupBy("chunk").applyInPandas(lambda pdf: _probe(pdf, block, n), "bucket int, chunk int, found binary")
    hits = asked.groupBy("bucket").applyInPandas(_repeated, "chunk int, bucket int, found binary")
    windows = x.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(lambda a, b: _extend(a, b, block, n), "bucket int, chunk int, found binary, ids binary")
    late = windows.groupBy("bucket").applyInPandas(_earlier, "chunk int, found binary")
    kept = x.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInPandas(lambda a, b: _remove(a, b, block), out)
    return kept.select(*[F.col(f"_{k}").alias(f.name) for k, f in enumerate(extra)], "kept_text", "n_words", "n_removed")
