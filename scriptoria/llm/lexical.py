"""Ranked lexical search: every item of a query table against all documents, by sort-based accumulation.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lowered. A
document that holds a term tf times gives it the impact w * (tf / (tf + saturation)), in whole numbers, where w falls
with the number of documents that hold the term and the saturation grows with the document's length.

The items' terms, of bounded size, go to all workers. One pass over the documents counts terms and keeps, for each
document, the ids and counts of those that items ask for. When document frequencies and lengths are known, a task
concatenates the (item, document, impact) arrays of many documents, radix-sorts their packed keys, sums impacts with
``reduceat`` and keeps a heap of the best an item. The heaps of all tasks are range-partitioned by item and
score, so that no item is one task, and cut to the best again.

Items come in blocks of about ``BLOCK_TERMS`` terms; a larger query table is that many passes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.text import shared_folder

TOP = 50
#: Terms of the items that are handled together, with repeats over items.
BLOCK_TERMS = 1 << 20
#: Entries that are sorted together, and bytes of a text that are split together.
ENTRIES, PIECE = 1 << 21, 1 << 20
#: Documents whose counts are returned together.
ROWS = 1000
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists of bounded size. Bytes of characters beyond ASCII are all above 127."""
    data = text.encode("utf-8", "surrogatepass").translate(_MAP) if text else b""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def radix_order(key: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, sixteen bits at a time from the lowest; numpy sorts 16-bit values by radix."""
    order = np.argsort((key & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    top, shift = int(key.max()) if len(key) else 0, 16
    while top >> shift:
        digit = ((key[order] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


class Best:
    """The best ``top`` (score, id) of each item: higher scores first, then lower ids; a null id is the last."""

    LAST = (1 << 63) - 1

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int, bool]]] = [[] for _ in range(n_items)]
        self.floor, self.last = np.zeros(n_items, np.int64), np.full(n_items, self.LAST, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        floor, last = self.floor[item], self.last[item]
        may = (score > floor) | ((score == floor) & (ids < last) & (floor > 0))
        for i, s, d, k in zip(item[may].tolist(), score[may].tolist(), ids[may].tolist(), named[may].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, (s, -d, k))
            else:
                heapq.heappushpop(heap, (s, -d, k))
            if len(heap) == self.top:
                self.floor[i], self.last[i] = heap[0][0], -heap[0][1]


class Items:
    """Terms of a block of items, numbered, and by term which items ask for it."""

    def __init__(self, wanted: list[set[bytes]]):
        self.number = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
        pairs = np.array(sorted((self.number[t], i) for i, found in enumerate(wanted) for t in found), np.int64).reshape(-1, 2)
        self.n_items, self.item = len(wanted), pairs[:, 1]
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(self.number) + 1))


def counted(docs: DataFrame, items) -> DataFrame:
    """doc_id, n (all terms), ids and tfs (array<int>) of the terms that items ask for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = items.value.number
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
                n, ids, tfs = [], [], []
                for text in batch["text"]:
                    seen: Counter = Counter()
                    total = 0
                    for part in terms(text.as_py()):
                        seen.update(part)
                        total += len(part)
                        if len(seen) > PIECE:  # a very long text: only what is asked for is kept
                            seen = Counter({t: c for t, c in seen.items() if t in number})
                    own = [(number[t], c) for t, c in seen.items() if t in number]
                    n.append(total)
                    ids.append([i for i, _ in own])
                    tfs.append([c for _, c in own])
                columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "ids", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


def _best_of_tasks(found: DataFrame, items, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item int, doc_id, score: the best of each task."""

    def scores(doc_n: np.ndarray, posts: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, score) of a slice of documents with ``posts`` entries each."""
        row = np.repeat(np.arange(len(doc_n)), posts)
        length = 100 - 50 + (50 * doc_n * n_docs) // max(n_terms, 1)
        impact = weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * length[row]))
        start, stop = items.value.start[ids], items.value.start[ids + 1]
        size = stop - start
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        key = (items.value.item[entry].astype(np.uint64) * np.uint64(len(doc_n))) + np.repeat(row, size).astype(np.uint64)
        order = radix_order(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        total = np.add.reduceat(np.repeat(impact, size)[order], first) if len(key) else np.empty(0, np.int64)
        item, doc = np.divmod(key[first].astype(np.int64), len(doc_n))
        return item, doc, total

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items.value.n_items, top)
        for batch in batches:
            named = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            doc_id = batch["doc_id"].fill_null(Best.LAST).to_numpy(zero_copy_only=False)
            n = batch["n"].to_numpy(zero_copy_only=False)
            ids, tfs = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            posts = batch["ids"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.append(0, np.cumsum(posts))
            entries = np.append(0, np.cumsum(np.diff(items.value.start)[ids]))[at]
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(entries, entries[lo] + ENTRIES, "right")) - 1)
                item, doc, score = scores(n[lo:hi], posts[lo:hi], ids[at[lo] : at[hi]], tfs[at[lo] : at[hi]])
                best.add(item, score, doc_id[lo:hi][doc], named[lo:hi][doc])
                lo = hi
        for i in range(0, len(best.heaps), 256):
            rows = [(i + j, None if not k else -d, s) for j, heap in enumerate(best.heaps[i : i + 256]) for s, d, k in heap]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return found.mapInArrow(rank, "item int, doc_id long, score long")


def _select(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each item with their rank: first within ranges of (item, score), then over the few rows that are left of each item."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = rows.repartitionByRange(F.col("item"), *order).sortWithinPartitions(F.col("item"), *order)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, taken = -1, 0
        for batch in batches:
            own = batch["item"].to_numpy(zero_copy_only=False)
            if not len(own):
                continue
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            place += np.where(own == item, taken, 0)
            yield batch.filter(pa.array(place < top))
            item, taken = own[-1], place[-1] + 1

    few = parts.mapInArrow(heads, "item int, doc_id long, score long")
    of_item = Window.partitionBy("item").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(of_item)).filter(F.col("rank") <= top)


def _block(docs: DataFrame, block: list, top: int) -> DataFrame:
    """The ranking for one block of items (item_id, text), given as rows."""
    spark = docs.sparkSession
    wanted = [{t for part in terms(r["text"]) for t in part} for r in block]
    items = spark.sparkContext.broadcast(Items(wanted))
    found = counted(docs, items).checkpoint()
    seen = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(items.value.number), np.int64)
    # as many rows as the block has terms
    for r in found.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[r["id"]] = r["count"]
    weights = np.array([weight(seen["docs"], int(x)) for x in df], np.int64)
    best = _select(_best_of_tasks(found, items, weights, seen["docs"], seen["terms"], top), top)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): for each row of ``items`` its ``top`` best documents with a score above 0.

    Null and empty texts have no terms, so such a document is never found and such an item finds nothing; statistics
    count documents with a term only. Equal scores stand by ascending doc_id, a null id last; repeated rows are
    documents, and items, of their own. Other columns are not read, whatever their names. Empty tables give no rows.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    q = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = q.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0  # a term has a byte, and another parts it from the next
    n_blocks = max(1, math.ceil(size / 2 / block_terms))
    numbered = q.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    parts = []
    for k in range(n_blocks):
        rows = numbered.filter(F.col("block") == k).select("item_id", "text").collect()
        if rows:
            parts.append(_block(d, rows, top))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)
