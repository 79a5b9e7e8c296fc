"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles (a shorter text is one shingle of its words). A
shingle weighs ``(1 + ln tf) * idf``, with ``idf = 1 + log10(N / max(df, N / 100)) / 4``: the frequency
damped, and shingles of a hundredth of all documents or fewer half as heavy again as one that all hold.
Document frequencies cover all documents, in a count-min sketch of fixed size; only cells that reach the
hundredth matter, and there are at most a hundred times the mean number of shingles of them.

Improved consistent weighted sampling draws, for each of ``SAMPLES`` seeds and each shingle, r and c from
Gamma(2, 1) and beta from U(0, 1), takes t = floor(ln w / r + beta) and keeps the shingle and t with the
least ln c - r * (t - beta + 1). Two texts agree in a sample with their weighted Jaccard similarity as
probability. A shingle's (r, c, beta) come from a table of 65,536 triples that its hash points into.

``BANDS`` bands of six samples make buckets: a pair at 0.8 shares one with probability 0.998. Equal texts
are one document from the start. Two rounds then hold the members of each bucket against one pivot: pairs
whose signatures agree enough (4.6 standard deviations below 0.8) are verified by the weighted Jaccard of
the whole texts, and links are joined to classes by distributed label contraction. That joins nearly all. In
the buckets that still hold several classes a last round meets every pair across classes, again first by
signature and then by text, in groups bounded in rows and bytes; pairs within a class, which the hot groups
consist of, are never looked at. So no link within a bucket is lost whatever a group's size.

Why frequencies below a hundredth weigh alike: with plain ln(N / df) the words in which near copies differ
(df 1) weigh several times what a large group shares, so copies of a frequent text that are alike by 0.8 and
more fall below 0.8. The README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from scriptoria.llm.text import hash_texts, mix, release, shared_folder, unique_hashes, window_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 21, 6
SAMPLES = BANDS * ROWS
#: Agreeing samples, of 126, below which a pair isn't verified: mean 100.8 and deviation 4.5 at 0.8.
AGREE = 80
#: Rows, and bytes of text, of a bucket that meet as many guests in one group.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Rows and cells of the count-min sketch of document frequencies.
SKETCH_ROWS, CELLS = 2, 1 << 19
RARE = 0.01
_TRIPLES = 1 << 16
#: Words that a task handles together; what it computes on then stays in a core's cache.
BATCH_WORDS = 60_000


def _triples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.gamma(2.0, 1.0, _TRIPLES), np.log(rng.gamma(2.0, 1.0, _TRIPLES)), rng.random(_TRIPLES)


_R, _LN_C, _BETA = _triples()
_A, _B = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(k)) | np.uint64(1) for k in (7919, 104729))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Floats as uint32 of the same order."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)


def _draw(index: np.ndarray, ln_w: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    r, beta = _R[index], _BETA[index]
    t = np.floor(ln_w / r + beta)
    return _sortable(_LN_C[index] - r * (t - beta + 1)) << np.uint64(32), t.astype(np.int64).astype(np.uint64)


#: Bits of a shingle's hash that tell it from others of its text; the rest of a key numbers the text.
_OWN = np.uint64((1 << 44) - 1)


class Shingles:
    """Distinct shingles of many texts (fewer than 2**20): hash, how often, and the text; ordered by text."""

    def __init__(self, texts: list[str | None]):
        flat, sizes = hash_texts(texts)
        doc = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
        ends = np.cumsum(sizes)
        h = window_hashes(flat, SHINGLE, 3)
        within = doc[SHINGLE - 1 :] == doc[: len(h)]
        short = np.flatnonzero(sizes < SHINGLE)
        one = np.array([int(mix(np.add.reduce(flat[ends[i] - sizes[i] : ends[i]] * (np.arange(1, sizes[i] + 1, dtype=np.uint64) | np.uint64(1)), keepdims=True))[0]) for i in short], np.uint64)
        key = np.concatenate([(doc[: len(h)][within] << np.uint64(44)) | (h[within] >> np.uint64(20)), (short.astype(np.uint64) << np.uint64(44)) | (one >> np.uint64(20))])
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.tf = np.diff(np.append(first, len(key)))
        key = key[first]
        self.doc = (key >> np.uint64(44)).astype(np.int64)
        self.hash = mix(key & _OWN)


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (mix(h + np.uint64(row * 7_777_777 + 1)) >> np.uint64(45)).astype(np.int64)  # 64 - 45 = 19 bits


class Idf:
    """Log weights; ``heavy[row]`` maps a cell that reaches the hundredth to its count."""

    def __init__(self, n_docs: int, heavy: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.rare = max(n_docs, 1), max(n_docs * RARE, 1.0)
        self.table = []
        for cells, counts in heavy:
            t = np.zeros(CELLS)
            t[cells] = counts
            self.table.append(t)
        self.light = float(np.log(self.of(np.array([self.rare]))[0]))

    def of(self, df: np.ndarray) -> np.ndarray:
        return 1.0 + np.log10(self.n / np.clip(df, self.rare, self.n)) / 4.0

    def ln_weight(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        df = reduce(np.minimum, (t[_cells(h, row)] for row, t in enumerate(self.table)), np.full(len(h), np.inf))
        return np.log((1.0 + np.log(tf)) * self.of(df))


def signatures(s: Shingles, idf: Idf, n: int) -> np.ndarray:
    """uint16[n, SAMPLES]: a digest of the shingle and t kept in each sample.

    A key is the sortable value above 32 bits of the shingle, xor 32 bits of t.
    """
    out = np.zeros((n, SAMPLES), np.uint16)
    begins = np.flatnonzero(np.append(True, s.doc[1:] != s.doc[:-1])) if len(s.doc) else np.empty(0, np.int64)
    if not len(begins):
        return out
    ln_w = idf.ln_weight(s.hash, s.tf)
    odd = np.flatnonzero(np.abs(ln_w - idf.light) > 1e-12)
    ln_odd = ln_w[odd]
    values, ts = _draw(np.arange(_TRIPLES), idf.light)
    usual = values | (mix(ts) >> np.uint64(32))  # a light shingle's draw depends on the triple alone
    low = s.hash & np.uint64(0xFFFFFFFF)
    low_odd = low[odd]
    index, key = np.empty(len(low), np.uint64), np.empty(len(low), np.uint64)
    least = np.empty((SAMPLES, len(begins)), np.uint64)
    for j in range(SAMPLES):
        np.multiply(s.hash, _A[j], out=index)
        np.right_shift(index, np.uint64(48), out=index)
        at = index.view(np.int64)
        np.take(usual, at, out=key, mode="clip")
        np.bitwise_xor(key, low, out=key)
        if len(odd):
            value, t = _draw(at[odd], ln_odd)
            key[odd] = (value | (mix(t) >> np.uint64(32))) ^ low_odd
        np.minimum.reduceat(key, begins, out=least[j])
    out[s.doc[begins]] = (mix((least & np.uint64(0xFFFFFFFF)) * _B[:, None]) >> np.uint64(48)).astype(np.uint16).T
    return out


def weighted_jaccard(a: list[str], b: list[str], idf: Idf) -> np.ndarray:
    """Of texts pair by pair, exactly."""
    n = len(a)
    s = Shingles([*a, *b])
    w = np.exp(idf.ln_weight(s.hash, s.tf))
    pair = np.where(s.doc >= n, s.doc - n, s.doc)
    key = mix(s.hash ^ mix(pair.astype(np.uint64) + np.uint64(1)))
    _, first, order = unique_hashes(key)
    if not len(first):
        return np.zeros(n)
    low, high = np.minimum.reduceat(w[order], first), np.maximum.reduceat(w[order], first)
    both = np.diff(np.append(first, len(key))) == 2
    who = pair[order[first]]
    shared = np.bincount(who, np.where(both, low, 0.0), n)
    return shared / np.maximum(np.bincount(who, high, n), 1e-300)


def _batched(pdf: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    size = np.cumsum(pdf[text].str.len().fillna(0).to_numpy(float)) // (BATCH_WORDS * 6)
    for _, part in pdf.groupby(size, sort=False):
        yield part.reset_index(drop=True)


def document_frequencies(texts: DataFrame, n_docs: int) -> Idf:
    """One pass over ``texts`` (text); a task sends its count-min cells, packed, once."""
    slices = 64
    width = CELLS // slices

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SKETCH_ROWS, CELLS), np.uint32)
        for pdf in batches:
            for part in _batched(pdf, "text"):
                h = Shingles(part["text"].tolist()).hash
                for row in range(SKETCH_ROWS):
                    total[row] += np.bincount(_cells(h, row), minlength=CELLS).astype(np.uint32)
        parts = total.reshape(SKETCH_ROWS * slices, width)
        yield pd.DataFrame({"part": np.arange(len(parts)), "n": [p.tobytes() for p in parts]})

    rare = max(n_docs * RARE, 1.0)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = reduce(np.add, (np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["n"]))
        at = np.flatnonzero(n > rare)
        return pd.DataFrame({"part": int(pdf["part"].iloc[0]), "cell": at, "n": n[at]})

    rows = texts.mapInPandas(count, "part int, n binary").groupBy("part").applyInPandas(add, "part int, cell long, n long").toPandas()
    heavy = []
    for row in range(SKETCH_ROWS):
        own = rows[(rows["part"] // slices) == row]
        heavy.append(((own["cell"] + (own["part"] % slices) * width).to_numpy(np.int64), own["n"].to_numpy(float)))
    return Idf(n_docs, heavy)


def contract(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (id, cls) after ``links`` (a, b of classes): every class gets the least of its component.

    A step takes the least label of all neighbours, then that label's label; both shrink distances, so the
    steps grow with the logarithm of a chain's length. Only classes that have links take part.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()

    def step(label: DataFrame) -> DataFrame:
        far = edges.join(label, F.col("b") == F.col("v")).groupBy(F.col("a").alias("u")).agg(F.min("l").alias("m"))
        near = label.join(far, F.col("v") == F.col("u"), "left").select("v", F.least("l", F.coalesce("m", "l")).alias("k"), F.col("l").alias("old"))
        up = label.select(F.col("v").alias("u"), F.col("l").alias("m"))
        return near.join(up, F.col("k") == F.col("u"), "left").select("v", F.least("k", F.coalesce("m", "k")).alias("l"), "old")

    label = edges.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("l"))
    while True:
        stepped = step(step(label.select("v", "l"))).checkpoint()
        label = stepped.select("v", "l")
        release(classes.sparkSession)
        if not stepped.filter(F.col("l") != F.col("old")).limit(1).count():
            return classes.join(label, F.col("cls") == F.col("v"), "left").select("id", F.coalesce("l", "cls").alias("cls"))


#: Texts that no id of their own names get ids from here on, made from their digest.
UNNAMED = 1 << 62
#: Stands for a null id in joins.
NO_ID = -(1 << 63)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of ``docs``: doc_id and class_id, the least doc_id of the class.

    Null texts are empty, and empty texts are copies of each other. A null id is a class member like any
    other, but a class without an id is named by a digest (``UNNAMED`` or more); so is the class of a text
    whose every id already stands for another text. Extra columns are not read; an empty table gives no rows.
    """
    found = _text_classes(docs, id_col, text_col, threshold)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, class_id long")
    signed, of_text = found
    return signed.select("id", "digest").join(of_text, "digest").select(F.col("id").alias("doc_id"), F.col("cls").alias("class_id"))


def _text_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """(id, digest) of every row, and (digest, rep, node, cls) of every distinct text; None if ``docs`` is empty."""
    spark = docs.sparkSession
    shared_folder(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_docs = d.count()
    if not n_docs:
        return None
    idf = document_frequencies(d.select("text"), n_docs)
    shared = spark.sparkContext.broadcast(idf)

    @F.pandas_udf("binary")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[bytes] = []
            for part in _batched(texts.to_frame("text"), "text"):
                out += [x.tobytes() for x in signatures(Shingles(part["text"].tolist()), shared.value, len(part))]
            yield pd.Series(out, dtype=object)

    # copies first: a text's digest stands for it, and its least id represents it
    signed = d.select("id", digest_of("text").alias("digest"), F.octet_length("text").cast("long").alias("bytes"), signature("text").alias("sig")).checkpoint()
    distinct = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    # a node is named by its least id, unless that is null or the least id of another text with a lesser digest
    own = F.shiftrightunsigned(F.xxhash64("digest"), 2).bitwiseOR(F.lit(UNNAMED))
    of_id = Window.partitionBy(F.coalesce("rep", own)).orderBy("digest")
    nodes = distinct.withColumn("id", F.when(F.col("rep").isNotNull() & (F.row_number().over(of_id) == 1), F.col("rep")).otherwise(own)).checkpoint()
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS))))
    member = nodes.select("id", F.explode(bands).alias("band"))
    shared_bands = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    member = member.join(shared_bands, "band").checkpoint()
    # signatures and texts of what stands in any bucket with another, moved once for all rounds
    ids = member.select("id").distinct()
    sigs = nodes.select("id", "sig", "bytes").join(ids, "id").checkpoint()
    wanted = nodes.select("id", "digest", "rep").join(ids, "id")
    texts = _texts_of(d, wanted).checkpoint()
    del shared_bands, ids, wanted, distinct
    release(spark)

    classes = nodes.select("id", F.col("id").alias("cls")).checkpoint()
    for search in (_star, _star, _across):
        m = member.join(classes, "id")
        # of a bucket's classes the one with most members is its main one; each pair across classes has a member outside it
        parts = m.groupBy("band", "cls").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        size = F.struct("n", -F.col("cls"))
        mains = parts.groupBy("band").agg(F.max_by("cls", size).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("band", "main")
        links = search(m.join(mains, "band"), sigs, texts, shared, threshold).checkpoint()
        if links.limit(1).count():
            cls = classes.select(F.col("id").alias("k"), F.col("cls").alias("c"))
            of = links.join(cls, F.col("pivot") == F.col("k")).select("id", F.col("c").alias("a")).join(cls, F.col("id") == F.col("k")).select("a", F.col("c").alias("b"))
            classes = contract(classes, of.filter("a <> b").distinct()).checkpoint()
            del cls, of
        del m, parts, mains, links
        release(spark)
    return signed.select("id", "digest"), nodes.select("id", "digest", "rep").join(classes, "id").select("digest", "rep", F.col("id").alias("node"), "cls")


def digest_of(text_col: str):
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


@F.pandas_udf(IntegerType())
def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="int32")
    u, v = (np.frombuffer(b"".join(z), np.uint16).reshape(-1, SAMPLES) for z in (x, y))
    return pd.Series((u == v).sum(1).astype(np.int32))


def _texts_of(d: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of ``nodes`` (id, digest, rep): of all copies of a text only the row that names it counts."""
    key = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("key")
    wanted = nodes.select(F.col("id").alias("node"), "digest", F.coalesce("rep", F.lit(NO_ID)).alias("key"))
    rows = d.select("text", digest_of("text").alias("digest"), key).join(wanted.hint("shuffle_hash"), ["digest", "key"])
    return rows.groupBy(F.col("node").alias("id")).agg(F.first("text").alias("text"))


def _star(members: DataFrame, sigs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """Links (pivot, id) of the members (band, id, cls, main) to one pivot of their bucket, across classes.

    The pivot is the least id outside the main class. At first all classes are of one member, so the main
    one is that of the least id; the pivot must then be that id, or the least one would meet nobody.
    """
    outside = F.min(F.when(F.col("cls") != F.col("main"), F.col("id")))
    alone = F.max(F.when(F.col("cls") == F.col("main"), F.col("id"))) == F.min("main")
    pivots = members.groupBy("band").agg(F.when(alone, F.min("main")).otherwise(outside).alias("pivot"))
    of = members.select(F.col("id").alias("p"), F.col("cls").alias("p_cls"), F.col("band").alias("p_band"))
    pivots = pivots.join(of, (F.col("band") == F.col("p_band")) & (F.col("pivot") == F.col("p"))).select("band", "pivot", "p_cls")
    pairs = members.join(pivots, "band").filter(F.col("p_cls") != F.col("cls")).select("pivot", "id").distinct()
    sig = sigs.select("id", "sig")
    both = pairs.join(sig, "id").join(sig.select(F.col("id").alias("pivot"), F.col("sig").alias("p_sig")), "pivot")
    near = both.withColumn("agree", _agreeing("sig", "p_sig")).filter(F.col("agree") >= AGREE).select("pivot", "id").checkpoint()
    # members first, then pivots: a hot pivot's text meets its members' in a join that AQE splits
    met = near.join(texts.select("id", F.col("text").alias("a")), "id").join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("b")), "pivot")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _batched(pdf, "a"):
                linked = weighted_jaccard(part["a"].tolist(), part["b"].tolist(), shared.value) >= threshold
                yield part.loc[linked, ["pivot", "id"]]

    return met.select("pivot", "id", "a", "b").mapInPandas(verify, "pivot long, id long")


def _across(members: DataFrame, sigs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """All links (pivot, id) across classes in the buckets of ``members`` (band, id, cls, main).

    Members outside the main class are guests; all members meet all guests of their bucket. Members and
    guests of a large bucket are dealt to blocks by a hash, each of about ``BLOCK`` rows and ``BLOCK_BYTES``
    of text, and a group has one block of either; small buckets share a group. Groups first compare
    signatures and name who takes part in any candidate pair; only those bring their texts.
    """
    m = members.join(sigs, "id").withColumn("guest", F.col("cls") != F.col("main"))
    count = lambda rows, total: F.greatest(F.ceil(rows / BLOCK), F.ceil(total / BLOCK_BYTES), F.lit(1)).cast("int")
    guest = F.col("guest")
    blocks = m.groupBy("band").agg(
        count(F.count(F.lit(1)), F.sum("bytes")).alias("rows"), count(F.count_if(guest), F.sum(F.when(guest, F.col("bytes")).otherwise(0))).alias("cols")
    )
    packs = max(1, m.count() // BLOCK)
    m = m.join(blocks, "band")
    small = (F.col("rows") == 1) & (F.col("cols") == 1)
    m = m.withColumn("pack", F.when(small, F.pmod(F.xxhash64("band"), F.lit(packs))).otherwise(F.col("band")))
    at = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["pack", "row", "col"]
    own = m.select("pack", "band", at("rows", 1).alias("row"), every("cols").alias("col"), "id", "cls", "sig", F.lit(False).alias("guest"))
    guests = m.filter("guest").select("pack", "band", every("rows").alias("row"), at("cols", 2).alias("col"), "id", "cls", "sig", F.lit(True).alias("guest"))

    def taking_part(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["guest"].to_numpy(bool)
        found = np.zeros(len(pdf), bool)
        near = _meeting(pdf, g)
        if near.any():
            s = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, SAMPLES)
            x, y = s[~g].T.copy(), s[g].T.copy()
            agree = np.zeros(near.shape, np.uint8)
            for j in range(SAMPLES):
                agree += x[j][:, None] == y[j][None, :]
            near &= agree >= AGREE
            found[~g], found[g] = near.any(1), near.any(0)
        return pdf.loc[found, [*keys, "band", "id", "cls", "guest"]]

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["guest"].to_numpy(bool)
        ids = pdf["id"].to_numpy(np.int64)
        near = _meeting(pdf, g)
        near &= jaccard_matrix(pdf["text"].tolist(), g, shared.value) >= threshold
        i, j = near.nonzero()
        # of a member's links to one class one is enough, as more would join the same classes
        return pd.DataFrame({"pivot": ids[g][j], "id": ids[~g][i], "cls": pdf["cls"].to_numpy(np.int64)[g][j]}).drop_duplicates(["id", "cls"])[["pivot", "id"]]

    part = own.unionByName(guests).groupBy(*keys).applyInPandas(taking_part, "pack long, row int, col int, band long, id long, cls long, guest boolean").checkpoint()
    return part.join(texts, "id").groupBy(*keys).applyInPandas(links, "pivot long, id long").distinct()


def _meeting(pdf: pd.DataFrame, guest: np.ndarray) -> np.ndarray:
    """Which rows that are no guests meet which guests: those of their bucket and of another class."""
    band, cls = pdf["band"].to_numpy(np.int64), pdf["cls"].to_numpy(np.int64)
    return (band[~guest][:, None] == band[guest][None, :]) & (cls[~guest][:, None] != cls[guest][None, :])


def jaccard_matrix(texts: list[str], column: np.ndarray, idf: Idf) -> np.ndarray:
    """Weighted Jaccard of all texts outside ``column`` (rows) with all in it, exactly.

    A shingle that a text holds k times has the levels 1..k, each with what it adds to the weight; so the
    sum of minima is a product of two matrices over (shingle, level), of which only shared ones count.
    """
    s = Shingles(texts)
    w = np.exp(idf.ln_weight(s.hash, s.tf))
    total = np.bincount(s.doc, w, len(texts))
    reps = np.maximum(s.tf, 1)
    level = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + 1
    doc, shingle = np.repeat(s.doc, reps), np.repeat(s.hash, reps)
    unit = np.repeat(w / (1.0 + np.log(s.tf)), reps)
    adds = unit * np.where(level == 1, 1.0, np.log(level) - np.log(np.maximum(level - 1, 1)))
    _, first, order = unique_hashes(mix(shingle + level.astype(np.uint64)))
    size = np.diff(np.append(first, len(order)))
    rank = np.repeat(np.cumsum(size > 1) - 1, size)
    shared = np.repeat(size > 1, size)
    order, rank = order[shared], rank[shared]
    place = np.where(column, np.cumsum(column) - 1, np.cumsum(~column) - 1)
    n_rows, n_cols = int((~column).sum()), int(column.sum())
    both = np.zeros((n_rows, n_cols))
    step = max(1, 4_000_000 // max(len(texts), 1))
    cuts = np.searchsorted(rank, np.arange(0, (rank[-1] + 1 if len(rank) else 0) + step, step))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        at, to = doc[order[a:b]], rank[a:b] - k * step
        root = np.sqrt(adds[order[a:b]])
        in_col = column[at]
        x, y = np.zeros((n_rows, step)), np.zeros((n_cols, step))
        x[place[at[~in_col]], to[~in_col]] = root[~in_col]
        y[place[at[in_col]], to[in_col]] = root[in_col]
        both += x @ y.T
    either = total[~column][:, None] + total[column][None, :] - both
    return both / np.maximum(either, 1e-300)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: of its text with the least id, the row of that id (one of them, if it repeats).

    Null texts are empty; a null id is kept if its text has no other. An empty table stays empty. All columns
    pass, whatever their names. Rows are dealt by digest and id, so the copies of one text spread; what is
    kept of a class is a digest and an id, and rows are folded only if a pair of these stands twice.
    """
    found = _text_classes(docs, id_col, text_col, threshold)
    if found is None:
        return docs
    signed, of_text = found
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))
    kept = of_text.filter("node = cls").select(F.col("digest").alias("d"), key("rep").alias("k")).checkpoint()
    # the row travels under one name, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(text_col).alias("digest"), key(id_col).alias("key"))
    rows = rows.join(kept.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & (F.col("key") == F.col("k")))
    twice = signed.groupBy("digest", F.coalesce("id", F.lit(NO_ID)).alias("key")).count().filter("count > 1")
    if twice.limit(1).count():
        rows = rows.dropDuplicates(["digest", "key"])
    return rows.select("row.*")
