"""Column expressions and in-task helpers on words that several operators share.

A word is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often a lambda inside ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Free memory goes back to the system. Arrow and C keep what a task has used, and a worker that waits holds it while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """array<string>; null and blank texts give an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)
_BASE, _INVERSE = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Bytes that are hashed together.
BLOCK_BYTES = 1 << 18
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``; longer ones only for a word longer than a block."""
    if len(_POWERS[0]) <= n:
        made = [np.cumprod(np.append(np.uint64(1), np.full(max(n, BLOCK_BYTES), x))) for x in (_BASE, _INVERSE)]
        if n > BLOCK_BYTES:
            return made
        _POWERS[:] = made
    return _POWERS


def hash_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and how many words each text has."""
    return hash_bytes([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts])[:2]


def hash_bytes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``hash_texts``; also all bytes together, and where words start and end in them.

    A word's hash is a polynomial of random values of its bytes, so it is a difference of prefix sums.
    """
    if not raw:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, np.empty(0, np.uint8), none, none
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.diff(_IS_SPACE[data], prepend=True, append=True).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    sizes = np.diff(np.searchsorted(starts, doc_ends), prepend=0)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")), i + 1)
        hi = ends[j - 1]
        up, down = _powers(int(hi - lo))
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=prefix[1:])
        out[i:j] = (prefix[ends[i:j] - lo] - prefix[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return mix(out), sizes, data, starts, ends


def split_words(text: str | None) -> list[bytes]:
    """bytes.split() without arguments splits at exactly the six space characters meant here."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries; windows that cross documents are the caller's to mask."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)
    for j in range(width):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def chunks_for(docs: DataFrame, text: str = "text", chunk_bytes: int = 8 << 20, least: int = 12) -> int:
    """How many chunks of about ``chunk_bytes`` of text the table makes: one scan of one column.

    Chunks exchange blocks with as many buckets, so beyond a quarter of a terabyte they grow with the
    root of the table; blocks then stay large enough to ship well.
    """
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(least, math.ceil(total / max(chunk_bytes, 16 * math.isqrt(total))))


def with_chunk(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with chunk (int), dealt by chunk. A chunk is a bounded set of documents chosen by hash, so
    copies of one text spread over all chunks, and what a chunk asks of other chunks it asks once."""
    key = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    return docs.withColumn("chunk", key).repartition(n, "chunk")


def unique_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, where each begins in the sorting order, and that order."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    return s[first], first, order


def by_bucket(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that groups hashes by bucket, ascending within each, and the n + 1 cuts between buckets."""
    bucket = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.argsort(h, kind="stable")  # a bucket is a range of hashes
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def shared_folder(spark) -> None:
    """The cluster's spark.checkpoint.dir stays; only where none is set, as in tests in one process, a local one is made."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)


def release(spark) -> None:
    """Shuffle and checkpoint files of plans that nothing refers to any more go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
