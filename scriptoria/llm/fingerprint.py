"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level runs of one symbol fold into one, deterministic coin tossing
labels every symbol from itself and its left neighbour (three rounds leave labels below 8), and local
maxima of the labels start new phrases; a phrase's name is a hash of its symbols, and names are the next
level's symbols. A boundary depends on a few neighbours only, so a passage that stands in two texts is cut
into the same phrases, whatever its offset, but for a few at its edges.

The fingerprint is a one-permutation MinHash of the phrase names of levels 2 and up: ``SLOTS`` slots of
four hexadecimal digits, ``----`` where no name fell. Likeness is the share of equal slots among those
that either fingerprint fills, an estimate of the Jaccard similarity of the two sets of names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.text import mix

SLOTS, LEVELS, FROM_LEVEL = 64, 6, 2
EMPTY = "----"
#: Texts are parsed together up to so many code points.
BATCH_CHARS = 1 << 20


def _toss_table(limit: int) -> np.ndarray:
    """label[left, own] for labels below ``limit``: twice the lowest differing bit, plus own bit there."""
    own, left = np.meshgrid(np.arange(limit, dtype=np.int64), np.arange(limit, dtype=np.int64))
    low = (own ^ left) & -(own ^ left)
    at = np.where(low > 0, np.round(np.log2(np.maximum(low, 1))), 0).astype(np.int64)
    return (2 * at + ((own >> at) & 1)).astype(np.uint8)


_SECOND, _THIRD = _toss_table(128), _toss_table(16)
_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _labels(s: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Small labels of a sequence in which neighbours differ; at documents' edges 0, whatever stands before."""
    x = s[1:] ^ s[:-1]
    low = x & (~x + np.uint64(1))
    at = (np.maximum(np.frexp(low.astype(np.float64))[1], 1) - 1).astype(np.uint64)  # equal neighbours stand at documents' edges only
    label = np.zeros(len(s), np.uint8)
    label[1:] = (np.uint64(2) * at + ((s[1:] >> at) & np.uint64(1))).astype(np.uint8)
    label[edge] = 0
    for table in (_SECOND, _THIRD):
        after = np.zeros_like(label)
        after[1:] = table[label[:-1], label[1:]]
        after[edge] = 0
        label = after
    return label


def _parse(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of one level and the document that each is in."""
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    if len(at) < len(s):
        run = np.diff(np.append(at, len(s))).astype(np.uint64)
        s, doc = s[at], doc[at]
        s = np.where(run > 1, mix(s + run * np.uint64(0x9E3779B97F4A7C15)), s)
    edge = np.ones(len(s), bool)
    edge[1:] = doc[1:] != doc[:-1]
    label = _labels(s, edge).astype(np.int16)
    start = np.zeros(len(s), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # neighbours of a document's edge have no partner on one side
    start[1:][edge[:-1]] = False
    start[:-1][edge[1:]] = False
    start |= edge
    begins = np.flatnonzero(start)
    sizes = np.diff(np.append(begins, len(s)))
    offset = np.arange(len(s)) - np.repeat(begins, sizes)
    names = np.add.reduceat(mix(s + np.uint64(0x632BE59BD9B4E019)) * _WEIGHTS[offset & 63], begins)
    return mix(names + sizes.astype(np.uint64)), doc[begins]


def _sketch(chars: list[np.ndarray]) -> np.ndarray:
    """slots[document, slot] as uint32, 0xFFFFFFFF where empty, low 16 bits of the least name else."""
    doc = np.repeat(np.arange(len(chars)), [len(c) for c in chars])
    s = np.concatenate(chars).astype(np.uint64) if chars else np.empty(0, np.uint64)
    keys, values = [], []
    for level in range(1, LEVELS + 1):
        if not len(s):
            break
        s, doc = _parse(s, doc)
        if level >= FROM_LEVEL:
            h = mix(s + np.uint64(level))
            keys.append(doc * SLOTS + (h >> np.uint64(58)).astype(np.int64))
            values.append(h & np.uint64(0xFFFFFFFFFFFF))
    out = np.full(len(chars) * SLOTS, 0xFFFFFFFF, np.uint32)
    if keys:
        key, val = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, val = key[order], val[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        out[key[at]] = (np.minimum.reduceat(val, at) >> np.uint64(16)).astype(np.uint32) & np.uint32(0xFFFF)
    return out.reshape(len(chars), SLOTS)


def sketches(texts: list[str]) -> np.ndarray:
    out, pending, size = [], [], 0
    for t in texts:
        pending.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
        size += len(pending[-1])
        if size >= BATCH_CHARS:
            out.append(_sketch(pending))
            pending, size = [], 0
    out.append(_sketch(pending))
    return np.concatenate(out)


def to_text(slots: np.ndarray) -> list[str]:
    empty = slots == 0xFFFFFFFF
    packed = slots.astype(">u2").tobytes().hex()
    width = SLOTS * 4
    found = [packed[i * width : (i + 1) * width] for i in range(len(slots))]
    for i in np.flatnonzero(empty.any(1)):
        found[i] = "".join(EMPTY if e else found[i][4 * k : 4 * k + 4] for k, e in enumerate(empty[i]))
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints row by row; two empty ones are alike."""
    filled = ((a != 0xFFFFFFFF) | (b != 0xFFFFFFFF)).sum(1)
    same = ((a == b) & (a != 0xFFFFFFFF)).sum(1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out_col``. Null texts are empty; an empty text fills no slot; equal texts have equal
    fingerprints. Rows pass one by one, so repeated rows, other columns and empty tables need no care."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(to_text(sketches([t or "" for t in texts])), dtype=object)

    return docs.withColumn(out_col, of(F.col(text_col)))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 << 20) -> DataFrame:
    """Each document against an edited self and against the next document, by descending doc_id.

    The edit replaces the last floor(n/3) code points by the first as many of the next document; after the
    last document comes the first. Documents are dealt to ranges of ids, whose bounds are ids of the table
    (a quantile sketch of the ids), so a bound is the first id of its range; that document also goes, as a
    guest, to the range before. One shuffle of the texts, ranges of bounded size, no global sort.
    Equal ids are ordered by text, null ids come last; null texts are empty.
    """
    least = -(1 << 63)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(12, math.ceil((d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / chunk_bytes))
    shares = [i / n for i in range(1, n)]
    cut = d.agg(F.max("key").alias("top"), F.percentile_approx("key", shares, max(10_000, 20 * n)).alias("at")).first()
    bounds = sorted({cut["top"], *(cut["at"] or [])} - {None}, reverse=True)
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))
    schema = "key long, text string, chunk int, guest boolean"

    def dealt(batches):
        falling = shared.value
        rising = falling[::-1]
        for pdf in batches:
            key = pdf["key"].to_numpy(np.int64)
            chunk = len(falling) - 1 - np.searchsorted(rising, key)  # the last bound that is not below the key
            yield pdf.assign(chunk=chunk.astype(np.int32), guest=False)
            first = key == falling[chunk]
            if first.any():
                yield pdf[first].assign(chunk=((chunk[first] - 1) % len(falling)).astype(np.int32), guest=True)

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["guest", "key", "text"], ascending=[True, False, True], kind="stable")
        own = pdf[~pdf["guest"]]
        texts = pdf["text"].tolist()[: len(own) + 1]
        mine = texts[: len(own)]
        after = texts[1 : len(own) + 1]
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(mine, after, strict=True)]
        slots = sketches(texts)
        changed = sketches(edited)
        same = slots[: len(own)]
        return pd.DataFrame(
            {
                "doc_id": own["key"].to_numpy(), "n_chars": [len(t) for t in mine],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": to_text(same), "edited_fingerprint": to_text(changed),
                "near_edited": likeness(same, changed), "near_next": likeness(same, slots[1 : len(own) + 1]),
            }
        )

    rows = d.mapInPandas(dealt, schema).groupBy("chunk").applyInPandas(group, out)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
