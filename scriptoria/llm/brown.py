"""LM scoring with a Brown class bigram model.

P(text) is the product over its tokens of P(class | class before) * P(word | class). Tokens are the
lower-cased (A-Z only) words and one end token; the first token follows an end.

* Tasks pack the training tokens once: a chunk has its distinct words and the tokens as numbers of these.
* Word counts cover the whole training table: chunks send packed (hash, count) lists to hash buckets.
* Seed: units are the commonest words, one each, and for all other words ``SUFFIXES`` groups by their last
  letters. Exchange clustering assigns units to ``CLASSES`` classes on their bigrams, a matrix of fixed
  size: each unit in turn moves to the class where the likelihood of the class bigrams is largest, until a
  sweep moves none.
* Then every word has a class of its own, held in its bucket. In each of ``ROUNDS`` rounds chunks ask buckets
  for the classes of their words and send back how often each word stands after and before each class;
  buckets sum that and move all words to their best classes against the class bigrams of the round. Moves
  made at once can harm each other, so the classes of the round with the best measured likelihood stay.
* A word unseen in training has the class of its suffix group.
* Class transitions are smoothed towards class frequencies. Word emission is discounted absolutely by
  D = n1 / (n1 + 2 n2); what that frees in a class is the probability of an unknown word of the class.
  Probabilities of all known words and one unknown word a class sum to one.

Scoring asks for each distinct word once a chunk of documents: chunks send hashes to the buckets that
hold counts and classes and get these back, so a frequent word costs no more than a rare one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.text import by_bucket, chunks_for, hash_bytes, mix, release, shared_folder, split_words, with_chunk

#: Commonest words with a unit of their own, suffix groups, classes.
TOP, SUFFIXES, CLASSES = 512, 512, 64
UNITS = TOP + SUFFIXES
#: The end token; no word holds a space.
END = b" "
END_HASH = np.uint64(0x5851F42D4C957F2D)
#: Pseudo-count of class frequencies in a transition.
KAPPA = 2.0
#: Characters after which a chunk of the training text is closed; its distinct words then mostly have numbers of 16 bits.
CHUNK_CHARS = 700_000
#: Counts up to which what they add to the likelihood is looked up.
MOST_TABLED = 16
#: Rounds in which every word may move.
ROUNDS = 3
#: Context codes of a word: classes before it, classes after it, itself.
BEFORE, AFTER, ITSELF = 0, CLASSES, 2 * CLASSES


def tokens(text: str | None) -> list[bytes]:
    return [w.lower() for w in split_words(text)] + [END]


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of all texts in order: hash and suffix group; and how many tokens each text has."""
    h, sizes, data, starts, ends = hash_bytes([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    tail = np.zeros(len(h), np.uint64)
    for k in range(3):
        at = ends - 1 - k
        tail |= np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    groups = (mix(tail + np.uint64(5)) >> np.uint64(32)) % np.uint64(SUFFIXES)
    upto = np.cumsum(sizes)
    return np.insert(h, upto, END_HASH), np.insert(groups.astype(np.uint16), upto, 0), sizes + 1


def word_hash(word: bytes) -> int:
    return int(END_HASH) if word == END else int(hash_bytes([word])[0][0])


def suffix_group(word: bytes) -> int:
    return int(token_hashes([word.decode("utf-8", "surrogatepass")])[1][0])


def _kept(frame: DataFrame) -> DataFrame:
    """``frame`` from the shared folder: computed once, and without the plan that made it."""
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/brown-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _dropped(frame: DataFrame) -> None:
    """Deletes what ``_kept`` wrote, once nothing that is still to run reads it."""
    files = frame.inputFiles()
    if files:
        jvm, context = frame.sparkSession.sparkContext._jvm, frame.sparkSession.sparkContext._jsc
        folder = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)


def encode(texts: DataFrame) -> DataFrame:
    """chunk, hashes (ascending), groups, seq of ``texts`` (text): distinct words, and tokens as their numbers after a first end."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32

        def packed(own: list[str | None]) -> pd.DataFrame:
            h, groups, _ = token_hashes(own)
            h, first, seq = np.unique(h, return_index=True, return_inverse=True)
            seq = np.append(np.searchsorted(h, END_HASH), seq).astype(np.uint16 if len(h) <= 1 << 16 else np.uint32)
            return pd.DataFrame({"chunk": [chunk], "hashes": [h.tobytes()], "groups": [groups[first].tobytes()], "seq": [seq.tobytes()], "width": [seq.itemsize]})

        pending, size = [], 0
        for pdf in batches:
            for text in pdf["text"]:
                pending.append(text)
                size += len(text or "")
                if size >= CHUNK_CHARS:
                    yield packed(pending)
                    chunk += 1
                    pending, size = [], 0
        if pending:
            yield packed(pending)

    return texts.mapInPandas(pack, "chunk long, hashes binary, groups binary, seq binary, width int")


def _seq(seq: bytes, width: int) -> np.ndarray:
    return np.frombuffer(seq, np.uint16 if width == 2 else np.uint32).astype(np.int64)


def count_words(encoded: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, hashes, counts, groups (packed, by hash) of all tokens of ``encoded``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                h, g = np.frombuffer(x.hashes, np.uint64), np.frombuffer(x.groups, np.uint16)
                c = np.bincount(_seq(x.seq, x.width)[1:], minlength=len(h))
                order, cuts = by_bucket(h, n_buckets)
                h, c, g = h[order], c[order], g[order]
                full = np.flatnonzero(np.diff(cuts))
                parts = [(cuts[b], cuts[b + 1]) for b in full]
                yield pd.DataFrame({"bucket": full, "hashes": [h[a:b].tobytes() for a, b in parts], "counts": [c[a:b].tobytes() for a, b in parts], "groups": [g[a:b].tobytes() for a, b in parts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["hashes"]])
        c = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["counts"]])
        g = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["groups"]])
        order = np.argsort(h, kind="stable")
        h, c, g = h[order], c[order], g[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c, g = h[at], np.add.reduceat(c, at), g[at]
        top = np.lexsort((h, -c))[:TOP]
        return pd.DataFrame(
            {
                "bucket": [int(pdf["bucket"].iloc[0])], "hashes": [h.tobytes()], "counts": [c.tobytes()], "groups": [g.tobytes()],
                "n": [int(c.sum())], "types": [len(h)], "ones": [int((c == 1).sum())], "twos": [int((c == 2).sum())],
                "top": [[{"h": int(h[i].view(np.int64)), "c": int(c[i])} for i in top]],
            }
        )

    schema = "bucket int, hashes binary, counts binary, groups binary, n long, types long, ones long, twos long, top array<struct<h:long,c:long>>"
    return encoded.mapInPandas(count, "bucket int, hashes binary, counts binary, groups binary").groupBy("bucket").applyInPandas(add, schema)


def _units(h: np.ndarray, groups: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Seed unit of each word; ``top`` has the hashes of the commonest words in order of their units."""
    unit = TOP + groups.astype(np.int64)
    if len(top):
        order = np.argsort(top)
        at = np.minimum(np.searchsorted(top[order], h), len(top) - 1)
        unit = np.where(top[order][at] == h, order[at], unit)
    return unit


def unit_bigrams(encoded: DataFrame, top: np.ndarray) -> np.ndarray:
    """int64[UNITS, UNITS]: how often a unit follows another; rows are summed by Spark, the matrix has a fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(UNITS * UNITS, np.int64)
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                a = _units(np.frombuffer(x.hashes, np.uint64), np.frombuffer(x.groups, np.uint16), top)[_seq(x.seq, x.width)]
                total += np.bincount(a[:-1] * UNITS + a[1:], minlength=UNITS * UNITS)
        m = total.reshape(UNITS, UNITS)
        full = np.flatnonzero(m.any(1))
        at = [np.flatnonzero(m[u]) for u in full]
        yield pd.DataFrame({"u": full, "v": [a.astype(np.uint16).tobytes() for a in at], "n": [m[u][a].tobytes() for u, a in zip(full, at, strict=True)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(UNITS, np.int64)
        for v, n in zip(pdf["v"], pdf["n"], strict=True):
            total[np.frombuffer(v, np.uint16)] += np.frombuffer(n, np.int64)
        return pd.DataFrame({"u": [int(pdf["u"].iloc[0])], "n": [total.tobytes()]})

    out = np.zeros((UNITS, UNITS), np.int64)
    for row in encoded.mapInPandas(count, "u int, v binary, n binary").groupBy("u").applyInPandas(add, "u int, n binary").collect():
        out[row["u"]] = np.frombuffer(row["n"], np.int64)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(g: np.ndarray) -> float:
    """What the class bigrams add to the log-likelihood; words alone add the same under any classes."""
    g = g.astype(float)
    return float(_xlogx(g).sum() - _xlogx(g.sum(1)).sum() - _xlogx(g.sum(0)).sum())


def exchange(m: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit, by exchange on the class-bigram likelihood

    sum n(a, b) ln n(a, b) - sum n(a, .) ln n(a, .) - sum n(., b) ln n(., b).
    Units move in order of frequency; a unit that stands in no bigram keeps its first class.
    """
    m = m.astype(float)
    size = len(m)
    order = np.argsort(-(m.sum(0) + m.sum(1)), kind="stable")
    of = np.empty(size, np.int64)
    of[order] = np.arange(size) % classes
    one = np.zeros((size, classes))
    one[np.arange(size), of] = 1
    rows, cols = m @ one, m.T @ one  # counts of a unit before, after each class
    g = one.T @ rows
    least = 1e-12 * _xlogx(m.sum()) + 1e-9  # above what rounding makes, so that sweeps end
    while True:
        moved = 0
        for u in order:
            own, a = m[u, u], of[u]
            if not rows[u].any() and not cols[u].any():
                continue
            r, c = rows[u].copy(), cols[u].copy()
            r[a] -= own
            c[a] -= own
            # the unit's neighbours stay, so it takes nothing but its own tokens from the marginals
            left, right, nr, nc = g.sum(1), g.sum(0), r.sum() + own, c.sum() + own
            left[a] -= nr
            right[a] -= nc
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= own
            diag = np.diag(g)
            gain = (_xlogx(g + r) - _xlogx(g)).sum(1) + (_xlogx(g + c[:, None]) - _xlogx(g)).sum(0)
            gain += _xlogx(diag + r + c + own) - _xlogx(diag + r) - _xlogx(diag + c) + _xlogx(diag)
            gain -= _xlogx(left + nr) - _xlogx(left) + _xlogx(right + nc) - _xlogx(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            g[b] += r
            g[:, b] += c
            g[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                rows[:, a] -= m[:, u]
                rows[:, b] += m[:, u]
                cols[:, a] -= m[u]
                cols[:, b] += m[u]
        if not moved:
            break
    return of


def _seed(table: DataFrame, top: np.ndarray, of: np.ndarray) -> DataFrame:
    """bucket, hashes, counts, classes: each word in the class of its unit."""

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [_units(np.frombuffer(h, np.uint64), np.frombuffer(g, np.uint16), top) for h, g in zip(pdf["hashes"], pdf["groups"], strict=True)]
            yield pdf[["bucket", "hashes", "counts"]].assign(classes=[of[u].astype(np.uint8).tobytes() for u in units])

    return table.select("bucket", "hashes", "counts", "groups").mapInPandas(seed, "bucket int, hashes binary, counts binary, classes binary")


def _answered(asked: DataFrame, state: DataFrame) -> DataFrame:
    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInPandas(_answer, "chunk long, bucket int, counts binary, classes binary")


def _steps(places: np.ndarray) -> bytes:
    """Ascending places as what each adds to the one before, in 16 bits if all fit."""
    steps = np.diff(places, prepend=0)
    return steps.astype(np.uint16 if steps.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _places(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint16 if len(steps) == 2 * n else np.uint32), dtype=np.int64)


def _classes(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Classes of known words, and their places among the words of the bucket."""
    h, k = np.frombuffer(held["hashes"].iloc[0], np.uint64), np.frombuffer(held["classes"].iloc[0], np.uint8)
    at = [np.searchsorted(h, np.frombuffer(x, np.uint64)) for x in asked["asked"]]
    return asked[["chunk", "bucket"]].assign(classes=[k[x].tobytes() for x in at], places=[_steps(x) for x in at])


def chunk_contexts(seq: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, code (ascending) and number of each class context of the words of ``seq``, whose classes are ``cls``."""
    width = ITSELF + 1
    # sorting short keys costs less than counting in a row of all codes for each word
    kind = np.uint32 if len(cls) * width < 1 << 32 else np.int64
    seq, of = seq.astype(kind), cls.astype(kind)[seq]
    left, right = seq[:-1], seq[1:]
    own = left == right
    key = np.concatenate([right * kind(width) + np.where(own, kind(ITSELF), kind(BEFORE) + of[:-1]), (left * kind(width) + (kind(AFTER) + of[1:]))[~own]])
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    at = key[first]
    return (at // kind(width)).astype(np.int64), (at % kind(width)).astype(np.uint8), np.diff(first, append=len(key))


def summed(key: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys ascending and their sums of ``ns`` (1 at least); key and number are sorted as one integer."""
    bits = np.uint64(int(ns.max(initial=0)).bit_length())
    both = key.astype(np.uint64) << bits | ns.astype(np.uint64)
    both.sort()
    key, ns = (both >> bits).astype(np.int64), (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(ns, at) if len(at) else ns


def class_contexts(encoded: DataFrame, state: DataFrame, n_buckets: int) -> DataFrame:
    """A row a bucket: its words by class context (sizes, codes, ns, packed) under the classes of ``state``,
    and g, the bigrams from any class to the classes of its words."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                yield _asked(np.frombuffer(x.hashes, np.uint64), x.chunk, n_buckets)

    def count(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        # hashes ascend and buckets are ranges of them, so a chunk's words stand in order of their buckets
        x, answers = chunk.iloc[0], answers.sort_values("bucket")
        seq = _seq(x["seq"], x["width"])
        cls = np.frombuffer(b"".join(answers["classes"]), np.uint8)
        n_words = len(cls)
        cuts = np.append(0, np.cumsum([len(c) for c in answers["classes"]]))
        word, codes, ns = chunk_contexts(seq, cls)
        sizes = np.bincount(word, minlength=n_words)
        ends = np.append(0, np.cumsum(sizes))[cuts]
        parts = range(len(answers))
        # most counts fit a byte; 255 stands for the next of the others
        small, large = np.minimum(ns, 255).astype(np.uint8), np.append(0, np.cumsum(ns >= 255))[ends]
        others = ns[ns >= 255].astype(np.uint32)
        return pd.DataFrame(
            {
                "bucket": answers["bucket"].to_numpy(), "places": answers["places"].to_numpy(), "sizes": [sizes[cuts[b] : cuts[b + 1]].astype(np.uint8).tobytes() for b in parts],
                "codes": [codes[ends[b] : ends[b + 1]].tobytes() for b in parts], "ns": [small[ends[b] : ends[b + 1]].tobytes() for b in parts],
                "others": [others[large[b] : large[b + 1]].tobytes() for b in parts],
            }
        )

    def add(held: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        h, cls = np.frombuffer(held["hashes"].iloc[0], np.uint64), np.frombuffer(held["classes"].iloc[0], np.uint8)
        width = ITSELF + 1
        key, ns = [], []
        for x in parts.itertuples(index=False):
            word = _places(x.places, len(x.sizes))
            key.append(np.repeat(word, np.frombuffer(x.sizes, np.uint8)) * width + np.frombuffer(x.codes, np.uint8))
            n = np.frombuffer(x.ns, np.uint8).astype(np.int64)
            n[n == 255] = np.frombuffer(x.others, np.uint32)
            ns.append(n)
        key, ns = summed(np.concatenate(key), np.concatenate(ns))
        word, code = key // width, key % width
        g = np.zeros((CLASSES, CLASSES), np.int64)
        before, own = code < AFTER, code == ITSELF
        np.add.at(g, (code[before], cls[word[before]]), ns[before])
        np.add.at(g, (cls[word[own]], cls[word[own]]), ns[own])
        sizes = np.bincount(word, minlength=len(h)).astype(np.uint8)
        return held[["bucket", "hashes", "counts", "classes"]].assign(sizes=[sizes.tobytes()], codes=[code.astype(np.uint8).tobytes()], ns=[ns.tobytes()], g=[g.tobytes()])

    asked = encoded.select("chunk", "hashes").mapInPandas(ask, "bucket int, chunk long, asked binary")
    answers = asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInPandas(_classes, "chunk long, bucket int, classes binary, places binary")
    parts = encoded.select("chunk", "seq", "width").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(count, "bucket int, places binary, sizes binary, codes binary, ns binary, others binary")
    schema = "bucket int, hashes binary, counts binary, classes binary, sizes binary, codes binary, ns binary, g binary"
    return state.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInPandas(add, schema)


def class_bigrams(contexts: DataFrame) -> np.ndarray:
    """int64[CLASSES, CLASSES] over all buckets; tasks send their sums."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for pdf in batches:
            for g in pdf["g"]:
                total += np.frombuffer(g, np.int64)
        yield pd.DataFrame({"g": [total.tobytes()]})

    rows = contexts.select("g").mapInPandas(add, "g binary").collect()
    return sum((np.frombuffer(r["g"], np.int64) for r in rows), np.zeros(CLASSES * CLASSES, np.int64)).reshape(CLASSES, CLASSES)


def best_classes(cls: np.ndarray, sizes: np.ndarray, codes: np.ndarray, ns: np.ndarray, g: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each word the class of the greatest likelihood against ``g`` without the word; ties stay.

    As in ``exchange``, but only entries of a word's contexts are looked at, and all words move against the same ``g``.
    """
    g = g.astype(float)
    out = cls.astype(np.int64)
    ends = np.append(0, np.cumsum(sizes.astype(np.int64)))
    left, right, diag = g.sum(1), g.sum(0), np.diag(g)
    # what n more in a cell add, for the usual small n
    tables = {f: np.stack([_xlogx(x + n) - _xlogx(x) for n in range(1, MOST_TABLED + 1)]) for f, x in ((AFTER, g.T), (BEFORE, g))}
    margins = [np.stack([_xlogx(x + n) - _xlogx(x) for n in range(MOST_TABLED + 1)]) for x in (left, right)]
    lo = 0
    while lo < len(cls):
        # words up to a bound of contexts, one at least
        hi = max(lo + 1, min(lo + block, int(np.searchsorted(ends, ends[lo] + 4 * block, "right")) - 1))
        a, span = out[lo:hi], slice(ends[lo], ends[hi])
        word, code, n = np.repeat(np.arange(hi - lo), sizes[lo:hi]), codes[span].astype(np.int64), ns[span].astype(float)
        each = np.arange(hi - lo)
        dense = np.zeros((hi - lo, ITSELF + 1))
        dense[word, code] = n
        c, r, own = dense[:, BEFORE:AFTER], dense[:, AFTER:ITSELF], dense[:, ITSELF]
        gain = np.zeros((hi - lo, CLASSES))
        for from_, matrix, mine, other in ((AFTER, g.T, r, c), (BEFORE, g, c, r)):
            at = np.flatnonzero((code >= from_) & (code < from_ + CLASSES))
            if not len(at):
                continue
            w, k, m = word[at], code[at] - from_, n[at]
            home = a[w] == k  # the word has left its class on both sides
            more = tables[from_][np.minimum(m, MOST_TABLED).astype(np.int64) - 1, k]
            # from the class it leaves the word takes its own contexts
            left_over = np.maximum(matrix[k, a[w]] - mine[w, k] - np.where(home, other[w, k] + own[w], 0), 0)
            staying = _xlogx(left_over + m) - _xlogx(left_over)
            many = m > MOST_TABLED
            # at home the word's contexts on the other side are gone from each class's cell, where there are any
            i, j = np.nonzero(other[w[few := np.flatnonzero(home & ~many)]])
            i = few[i]
            base = np.maximum(matrix[k[i], j] - other[w[i], j], 0)
            more[i, j] = _xlogx(base + m[i]) - _xlogx(base)
            direct = np.flatnonzero(many)
            base, away = matrix[k[direct]], home[direct]  # of each class with class k
            base[away] -= other[w[direct][away]]
            np.maximum(base, 0, out=base)
            more[direct] = _xlogx(base + m[direct, None]) - _xlogx(base)
            more[np.arange(len(at)), a[w]] = staying
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(more, first)
        # a class's cell with itself is met from both sides: it differs only for contexts on both, or of the word with itself
        i, j = np.nonzero((r > 0) & (c > 0) | (own > 0)[:, None])
        d = diag[j]
        d = np.where(j == a[i], np.maximum(d - r[i, j] - c[i, j] - own[i], 0), d)
        gain[i, j] += _xlogx(d + r[i, j] + c[i, j] + own[i]) - _xlogx(d + r[i, j]) - _xlogx(d + c[i, j]) + _xlogx(d)
        for margin, tabled, total in ((left, margins[0], r.sum(1) + own), (right, margins[1], c.sum(1) + own)):
            rest = np.maximum(margin[a] - total, 0)
            staying = _xlogx(rest + total) - _xlogx(rest)
            more = tabled[np.minimum(total, MOST_TABLED).astype(np.int64)]
            many = np.flatnonzero(total > MOST_TABLED)
            more[many] = _xlogx(margin + total[many, None]) - _xlogx(margin)
            more[each, a] = staying
            gain -= more
        b = gain.argmax(1)
        out[lo:hi] = np.where(gain[each, b] > gain[each, a] + 1e-6, b, a)
        lo = hi
    return out.astype(np.uint8)


def _moved(contexts: DataFrame, g: np.ndarray) -> DataFrame:
    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            best = [best_classes(*(np.frombuffer(v, t) for v, t in zip(x, (np.uint8, np.uint8, np.uint8, np.int64), strict=True)), g) for x in pdf[["classes", "sizes", "codes", "ns"]].itertuples(index=False)]
            yield pdf[["bucket", "hashes", "counts"]].assign(classes=[x.tobytes() for x in best])

    return contexts.select("bucket", "hashes", "counts", "classes", "sizes", "codes", "ns").mapInPandas(move, "bucket int, hashes binary, counts binary, classes binary")


def word_classes(encoded: DataFrame, state: DataFrame, n_buckets: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[float]]:
    """The classes of the best round, the class bigrams under them, and the likelihood of each round, the seed's first."""
    best, found = None, []
    for k in range(rounds + 1):
        contexts = _kept(class_contexts(encoded, state, n_buckets))
        _dropped(state)
        g = class_bigrams(contexts)
        found.append(likelihood(g))
        better = best is None or found[-1] > max(found[:-1])
        last, best = (best, (contexts, g)) if better else (None, best)
        if k < rounds:
            state = _kept(_moved(contexts, g))
        for old in (last and last[0], None if better else contexts):
            if old:
                _dropped(old)
        # shuffles of a finished round are dropped when the driver collects the plans that made them
        release(encoded.sparkSession)
    return best[0].select("bucket", "hashes", "counts", "classes"), best[1], found


def train(texts: DataFrame) -> tuple[dict, DataFrame]:
    """The model (of fixed size) and counts and classes by bucket, kept in the cluster's shared folder."""
    shared_folder(texts.sparkSession)
    n_buckets = chunks_for(texts)
    encoded = _kept(encode(texts))
    table = _kept(count_words(encoded, n_buckets))
    t = table.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n", "types", "ones", "twos")]).first()
    top_rows = table.select(F.inline("top")).orderBy(F.desc("c"), "h").limit(TOP).collect()
    top = np.array([r["h"] for r in top_rows], np.int64).view(np.uint64)
    of = exchange(unit_bigrams(encoded, top))
    seed = _kept(_seed(table, top, of))
    _dropped(table)
    state, n, found = word_classes(encoded, seed, n_buckets)
    _dropped(encoded)
    types = np.zeros(CLASSES)
    for r in state.mapInPandas(_class_sizes, "c int, k long").groupBy("c").agg(F.sum("k").alias("k")).collect():
        types[r["c"]] = r["k"]
    size = n.sum(0)  # every token follows another
    prior = (size + 1) / (size.sum() + CLASSES)
    step = np.log10((n + KAPPA * prior) / (n.sum(1, keepdims=True) + KAPPA))
    d = t["ones"] / (t["ones"] + 2 * t["twos"]) if t["ones"] else 0.5
    model = {
        "unseen": of[TOP:], "step": step, "size": size, "free": d * types, "discount": d, "n": t["n"], "types": t["types"],
        "n_buckets": n_buckets, "likelihood": found,
    }
    return model, state


def _class_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CLASSES, np.int64)
    for pdf in batches:
        for c in pdf["classes"]:
            total += np.bincount(np.frombuffer(c, np.uint8), minlength=CLASSES)
    yield pd.DataFrame({"c": np.arange(CLASSES), "k": total})


def _asked(h: np.ndarray, chunk: int, n: int) -> pd.DataFrame:
    _, cuts = by_bucket(h, n)
    full = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"bucket": full, "chunk": chunk, "asked": [h[cuts[b] : cuts[b + 1]].tobytes() for b in full]})


def _ask(docs: pd.DataFrame, n: int) -> pd.DataFrame:
    return _asked(np.unique(token_hashes(docs["_text"].tolist())[0]), int(docs["chunk"].iloc[0]), n)


def _answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Counts (0: unseen) and classes (0 where unseen) of what is asked."""
    h = np.frombuffer(held["hashes"].iloc[0], np.uint64) if len(held) else np.empty(0, np.uint64)
    c = np.frombuffer(held["counts"].iloc[0], np.int64) if len(held) else np.empty(0, np.int64)
    k = np.frombuffer(held["classes"].iloc[0], np.uint8) if len(held) else np.empty(0, np.uint8)
    counts, classes = [], []
    for x in asked["asked"]:
        a = np.frombuffer(x, np.uint64)
        if len(h):
            at = np.minimum(np.searchsorted(h, a), len(h) - 1)
            counts.append(np.where(h[at] == a, c[at], 0).tobytes())
            classes.append(np.where(h[at] == a, k[at], 0).astype(np.uint8).tobytes())
        else:
            counts.append(np.zeros(len(a), np.int64).tobytes())
            classes.append(np.zeros(len(a), np.uint8).tobytes())
    return pd.DataFrame({"chunk": asked["chunk"], "bucket": asked["bucket"], "counts": counts, "classes": classes})


def _score(docs: pd.DataFrame, answers: pd.DataFrame, model: dict) -> pd.DataFrame:
    extra = docs.drop(columns=["_text", "chunk"])
    if not len(docs):
        return extra.assign(n_tokens=[], n_known=[], train_tokens=[], base_score=[], score=[])
    h, groups, sizes = token_hashes(docs["_text"].tolist())
    h, first, seq = np.unique(h, return_index=True, return_inverse=True)
    answers = answers.sort_values("bucket")  # buckets are ranges of hashes, and so are the parts
    count = np.concatenate([np.frombuffer(x, np.int64) for x in answers["counts"]]).astype(float)
    cls = np.concatenate([np.frombuffer(x, np.uint8) for x in answers["classes"]]).astype(np.int64)
    cls = np.where(count > 0, cls, model["unseen"][groups[first]])
    size, d = model["size"][cls], model["discount"]
    emit = np.log10(np.where(count > 0, np.maximum(count - d, 1e-9), model["free"][cls] + 1.0) / (size + 1.0))
    base = np.log10((count + 1.0) / (model["n"] + model["types"] + 1.0))
    c = cls[seq]
    before = np.append(cls[np.searchsorted(h, END_HASH)], c[:-1])  # the token before a text is the end of another
    starts = np.cumsum(sizes) - sizes
    summed = lambda x: np.add.reduceat(x, starts)
    return extra.assign(
        n_tokens=sizes, n_known=summed((count > 0)[seq].astype(np.int64)), train_tokens=model["n"], base_score=summed(base[seq]),
        score=summed(emit[seq] + model["step"][before, c]),
    )


def score(docs: DataFrame, model: dict, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` but with n_tokens, n_known, train_tokens (long), base_score, score (log10).

    Null and empty texts are one end token. A model of an empty table knows no word: every score is that
    of unknown words. Other columns and repeated rows pass unchanged; columns of the names above are replaced.
    """
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    added = {"n_tokens": LongType(), "n_known": LongType(), "train_tokens": LongType(), "base_score": DoubleType(), "score": DoubleType()}
    extra = [f for f in docs.schema.fields if f.name not in (text_col, *added)]
    # the others travel under numbers, so that no name of theirs can clash
    x = docs.select(*[F.col(f.name).alias(f"_{k}") for k, f in enumerate(extra)], F.col(text_col).alias("_text"))
    key = "_0" if extra else "_text"
    x = with_chunk(x, chunks_for(x, "_text"), key, "_text")
    n = model["n_buckets"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = x.groupBy("chunk").applyInPandas(lambda pdf: _ask(pdf, n), "bucket int, chunk long, asked binary")
    answers = _answered(asked, counts).withColumn("chunk", F.col("chunk").cast("int"))
    out = StructType([*[StructField(f"_{k}", f.dataType) for k, f in enumerate(extra)], *[StructField(k, v) for k, v in added.items()]])
    scored = x.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda a, b: _score(a, b, shared.value), out)
    return scored.select(*[F.col(f"_{k}").alias(f.name) for k, f in enumerate(extra)], *added)


def perplexity(scored: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -scored / n_tokens)
