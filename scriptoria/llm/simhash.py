"""SimHash near-dedup with candidates from pigeonring filtering.

A text is the bag of its four-word shingles, of which each has a 64-bit hash. A bit of the fingerprint is 1 if more
than half of the hashes have it. Texts are linked if their fingerprints differ in at most ``LIMIT`` bits, and
components of links are the result.

Candidates: the 64 bits are a ring of ``LIMIT + 1`` segments. If two fingerprints differ in at most LIMIT bits, then
there is a segment from which every chain of 1, 2, ... consecutive segments differs in at most the chain's share of
the budget, length * LIMIT / (LIMIT + 1), rounded down: nothing in the first segment, at most one bit in two, two in
three. So fingerprints are kept under the first segment and its neighbour, and look under all values of the two that
a viable chain allows: their own, and each with one bit of the neighbour turned, of which only the side with the 0
asks. What meets is held to the next chain before the full distance is taken. Keys that hold many
fingerprints are split by the chain of three segments, and what is still large is met in blocks of bounded size.

Equal fingerprints are one from the start. A block of a key gives no pairs but a forest that joins what its
pairs join, so the links grow with the rows of a key and not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.near_dedup import contract
from scriptoria.llm.text import shared_folder

SHINGLE, SEED, BITS, LIMIT = 4, 42, 64, 4
#: Rows of a key above which it is split by a longer chain, and rows of a block.
HOT, BLOCK = 2048, 2048
#: Shingles whose bits are counted together, and rows whose keys are made together.
SLICE, KEYED = 1 << 15, 1 << 12


def hashes(text: str | None) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, with repeats, in slices. Only A-Z are lowered; bytes.split() splits at the six
    space characters meant."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    of = xxhash.xxh64_intdigest
    for i in range(0, count, SLICE):
        part = words[i : i + SLICE + width - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(size + 1) - 1
        starts, ends = (ends - size)[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist()
        yield np.fromiter((of(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None) -> int:
    """Null and blank texts have 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in hashes(text):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def segments(limit: int = LIMIT) -> list[list[int]]:
    """Bits of the limit + 1 segments of the ring."""
    return [x.tolist() for x in np.array_split(np.arange(BITS), limit + 1)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def chain_masks(at: int, length: int, limit: int = LIMIT) -> list[int]:
    """Masks of the chains of 1 .. length segments from segment ``at`` on."""
    ring = segments(limit)
    return [_mask(b for k in range(n) for b in ring[(at + k) % len(ring)]) for n in range(1, length + 1)]


def budget(length: int, limit: int = LIMIT) -> int:
    """Bits in which a viable chain of that length may differ."""
    return length * limit // (limit + 1)


def turns(at: int, length: int, limit: int = LIMIT) -> np.ndarray:
    """All differences that a viable chain of ``length`` segments from ``at`` on may have; the first is none."""
    ring = segments(limit)
    found = [((), 0)]
    for n in range(2, length + 1):
        bits = ring[(at + n - 1) % len(ring)]
        found = [(flips + more, count + k) for flips, count in found for k in range(budget(n, limit) - count + 1) for more in combinations(bits, k)]
    return np.array([_mask(f) for f, _ in found], np.uint64)


def keyed(prints: DataFrame, length: int, limit: int = LIMIT) -> DataFrame:
    """``prints`` (fp, at: a bit for each segment that chains may begin with) as key, at, fp, guest: a row under its own key
    and, as a guest, under those it asks."""
    ring = range(limit + 1)
    asked = [turns(at, length, limit) for at in ring]
    whole = [np.uint64(chain_masks(at, length, limit)[-1]) for at in ring]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), KEYED):
                part = pdf.iloc[lo : lo + KEYED]
                fp = part["fp"].to_numpy(np.int64).view(np.uint64)
                for at in ring:
                    own = fp[part["at"].to_numpy(np.int64) & (1 << at) > 0]
                    chain = asked[at]
                    low = chain & (~chain + np.uint64(1))
                    for k in range(0, len(chain), 64):
                        some = chain[k : k + 64]
                        row, col = ((own[:, None] & low[None, k : k + 64]) == 0).nonzero()  # the side with the 0 in the lowest turned bit asks
                        key = (own[row] ^ some[col]) & whole[at]
                        yield pd.DataFrame({"key": key.view(np.int64), "at": np.int32(at), "fp": own[row].view(np.int64), "guest": some[col] != 0})

    return prints.select("fp", "at").mapInPandas(make, "key long, at int, fp long, guest boolean")


def forest(own: np.ndarray, other: np.ndarray, next_chain: int, spare: int, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(a, b) that join what the pairs of ``own`` x ``other`` within the limit join."""
    near = np.zeros((len(own), len(other)), bool)
    for i in range(0, len(own), 256):
        differ = own[i : i + 256, None] ^ other[None, :]
        row, col = (np.bitwise_count(differ & np.uint64(next_chain)) <= spare).nonzero()
        hit = np.bitwise_count(differ[row, col]) <= limit
        near[i + row[hit], col[hit]] = True
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return []
    near, none = near[np.ix_(rows, cols)], np.iinfo(np.int64).max
    label = np.arange(len(rows))
    while True:
        of_col = np.where(near, label[:, None], none).min(0)
        least = np.where(near, of_col[None, :], none).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    root = own[rows[label]]
    links = [(own[rows], root), (other[cols], own[rows[of_col]])]
    return [(a[a != b], b[a != b]) for a, b in links]


def _links(bucket: DataFrame, length: int, limit: int) -> DataFrame:
    """Links (a, b) among the rows of ``bucket`` (key, at, fp, guest, rows, hosts): rows and hosts are the key's rows, and those that are no guests."""
    packs = max(1, bucket.count() // BLOCK)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    b = bucket.withColumns({"down": blocks("hosts"), "across": blocks("rows")})
    small = (F.col("down") == 1) & (F.col("across") == 1)
    b = b.withColumn("pack", F.when(small, F.pmod(F.xxhash64("key", "at"), F.lit(packs))).otherwise(F.xxhash64("key", "at")))
    place = lambda n, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    host = b.filter(~F.col("guest")).select("pack", "key", "at", "fp", place("down", 1).alias("row"), every("across").alias("col"), F.lit(True).alias("host"))
    other = b.select("pack", "key", "at", "fp", every("down").alias("row"), place("across", 2).alias("col"), F.lit(False).alias("host"))
    after = [(chain_masks(at, min(length + 1, limit + 1), limit)[-1], budget(min(length + 1, limit + 1), limit)) for at in range(limit + 1)]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "key"], kind="stable")
        key, at, is_host = pdf["key"].to_numpy(), pdf["at"].to_numpy(), pdf["host"].to_numpy(bool)
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))), len(key))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            h = is_host[lo:hi]
            own, others = fp[lo:hi][h], fp[lo:hi][~h]
            if len(own) and len(others) and (len(own) > 1 or len(others) > 1 or own[0] != others[0]):
                found += forest(own, others, *after[at[lo]], limit)
        a, c = (np.concatenate([f[i] for f in found] or [np.empty(0, np.uint64)]) for i in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": c.view(np.int64)}).drop_duplicates()

    return host.unionByName(other).groupBy("pack", "row", "col").applyInPandas(meet, "a long, b long").distinct()


def links(prints: DataFrame, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``prints`` (fp long) that join all pairs within ``limit`` bits."""
    todo = prints.select("fp", F.lit((1 << (limit + 1)) - 1).alias("at"))
    found = []
    last = min(3, limit + 1)
    for length in range(min(2, last), last + 1):
        rows = keyed(todo, length, limit)
        guest = F.col("guest").cast("long")
        sizes = rows.groupBy("key", "at").agg(F.count(F.lit(1)).alias("rows"), F.sum(1 - guest).alias("hosts")).filter("hosts > 0 AND rows > 1")
        met = rows.join(sizes, ["key", "at"]).checkpoint()
        large = F.col("rows") > hot
        cold = met if length == last else met.filter(~large)
        found.append(_links(cold, length, limit).checkpoint())
        if length == last or not met.filter(large).limit(1).count():
            break
        # the segments from which a fingerprint stands or asks under a large key
        todo = met.filter(large).groupBy("fp").agg(F.expr("bit_or(shiftleft(1, at))").alias("at")).checkpoint()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a row of ``docs``: doc_id, fingerprint (long, its 64 bits), component_id, the least doc_id of the component.

    Null and blank texts have fingerprint 0 and are linked like any other. A null id counts as no id: a
    component of such rows only has a null component_id. Repeated rows are rows of their own in one component;
    ties do not arise. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    shared_folder(docs.sparkSession)

    @F.pandas_udf("long")
    def prints_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), prints_of(F.col(text_col).cast("string")).alias("fp")).checkpoint()
    nodes = signed.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    joined = links(nodes.select("fp"), limit).checkpoint()
    classes = nodes.select(F.col("fp").alias("id"), F.col("fp").alias("cls"))
    if joined.limit(1).count():
        classes = contract(classes, joined)
    of = classes.join(nodes, F.col("id") == F.col("fp")).select("fp", "cls", "least").checkpoint()
    named = of.groupBy("cls").agg(F.min("least").alias("component_id"))
    members = of.select("fp", "cls").join(named, "cls").select("fp", "component_id")
    return signed.join(members, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
