"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the selected terms that a text holds. The
pairwise part learns that, say, an insult next to a group mention counts for more than the two apart.

Terms are lower-case words and the word beginnings of three to six letters, hashed to 2**18 bins. Bins are
counted over the training rows and the ``terms`` with the largest likelihood ratio are kept, so the model
has a fixed size. Fitting sees at most ``train_docs`` labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, TERMS, FACTORS = 1 << 18, 4096, 8
#: The most labelled rows that fitting reads, chosen by a hash of their id.
TRAIN_DOCS = 20_000
#: A bin must stand in so many training texts, and tell the labels apart by so much (log likelihood ratio).
LEAST_DOCS, LEAST_GAIN = 4, 4.0
#: What a toxic text weighs in fitting; they are the fewer.
POSITIVE = 2.0
WORD = re.compile(r"[^\W\d_]+")


def term_bins(word: str) -> list[int]:
    cuts = {word} | {f"^{word[:k]}" for k in range(3, 7) if len(word) > k}
    return [xxhash.xxh32_intdigest(c.encode("utf-8", "surrogatepass")) % BINS for c in cuts]


class WordTerms(dict):
    """Word -> its selected term numbers, remembered within a task up to a bound."""

    LIMIT = 300_000

    def __init__(self, selected: dict[int, int]):
        super().__init__()
        self.selected = selected

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        found = tuple({self.selected[b] for b in term_bins(word) if b in self.selected})
        if len(word) <= 64:
            self[word] = found
        return found


def text_terms(text: str | None, known: WordTerms) -> list[int]:
    out: set[int] = set()
    for found in map(known.__getitem__, set(WORD.findall((text or "").lower()))):
        if found:
            out.update(found)
    return sorted(out)


def fit(y: np.ndarray, found: list[np.ndarray], n_terms: int, factors: int = FACTORS, steps: int = 400, batch: int = 1024, rate: float = 0.05, decay: float = 0.3, positive: float = POSITIVE, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the logistic loss by batches, with a falling rate; ``found`` has each text's term numbers.

    Rows are a bounded sample and a batch's arrays are small, whatever their number.
    """
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    p = {"w0": np.array([np.log(share / (1 - share))]), "w": np.zeros(n_terms), "v": rng.normal(0, 0.02, (n_terms, factors))}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    queue = np.empty(0, np.int64)
    for t in range(1, (steps if len(y) else 0) + 1):
        if len(queue) < min(batch, len(y)):
            queue = rng.permutation(len(y))
        rows, queue = queue[:batch], queue[batch:]
        sizes = np.array([len(found[i]) for i in rows])
        idx = np.concatenate([found[i] for i in rows]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda x: (c := np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)]))[ends[1:]] - c[ends[:-1]]
        v = p["v"][idx]
        sums = total(v)
        z = p["w0"] + total(p["w"][idx]) + 0.5 * (sums**2 - total(v**2)).sum(1)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * np.where(y[rows] > 0, positive, 1.0) / len(rows)
        e = err[doc]
        pull = e[:, None] * (sums[doc] - v)
        g = {"w0": np.array([err.sum()]), "w": np.bincount(idx, e, n_terms) + decay * p["w"] / len(y)}
        g["v"] = np.stack([np.bincount(idx, pull[:, k], n_terms) for k in range(factors)], 1) + decay * p["v"] / len(y)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-9)
    return p


def value(model: dict[str, np.ndarray], found: list[int]) -> float:
    if not found:
        return float(1 / (1 + np.exp(-model["w0"][0])))
    v = model["v"][found]
    z = model["w0"][0] + model["w"][found].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, terms: int = TERMS) -> dict:
    """``labelled``: text, label (0/1; null rows are left out). Beyond ``train_docs`` rows a hash of the text
    chooses about so many, before the terms are counted and wherever the rows lie."""
    spark_rows = labelled.select("text", "label").filter(F.col("label").isNotNull())
    share = min(1.0, train_docs / max(spark_rows.count(), 1))
    if share < 1:
        spark_rows = spark_rows.filter(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BINS), np.int64)
        size = [0, 0]
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                bins = {b for w in set(WORD.findall((text or "").lower())) for b in term_bins(w)}
                n[int(label)][list(bins)] += 1
                size[int(label)] += 1
        k = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"bin": [*k, -1], "n0": [*n[0][k], size[0]], "n1": [*n[1][k], size[1]]})

    c = spark_rows.mapInPandas(counts, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = c.filter((F.col("n0") + F.col("n1") >= LEAST_DOCS)).toPandas()  # 2**18 rows at most
    size = table[table["bin"] == -1]
    if not len(size):
        return {"selected": {}, "model": fit(np.empty(0), [], 0)}
    s0, s1 = int(size["n0"].iloc[0]), int(size["n1"].iloc[0])
    table = table[table["bin"] >= 0]
    a, b = table["n1"].to_numpy(float), table["n0"].to_numpy(float)
    e1 = (a + b) * s1 / max(s0 + s1, 1)
    gain = a * np.log(np.maximum(a, 0.5) / np.maximum(e1, 1e-9)) + b * np.log(np.maximum(b, 0.5) / np.maximum(a + b - e1, 1e-9))
    best = table.assign(gain=np.nan_to_num(gain)).query("gain > @LEAST_GAIN").sort_values(["gain", "bin"], ascending=[False, True]).head(terms)
    selected = {int(x): i for i, x in enumerate(best["bin"])}

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordTerms(selected)
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"].astype("int64"), "terms": [np.array(text_terms(t, known), np.uint16).tobytes() for t in pdf["text"]]})

    rows = spark_rows.mapInPandas(listed, "label long, terms binary").toPandas()  # a bounded number, packed
    rows = rows.sort_values(["label", "terms"])  # so that reruns see one order
    found = [np.frombuffer(x, np.uint16) for x in rows["terms"]]
    return {"selected": selected, "model": fit(rows["label"].to_numpy(float), found, len(selected))}


def score(docs: DataFrame, fitted: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col`` (double, 0 to 1). Null and empty texts get the score of no terms.

    Only the text is read; repeated rows and other columns pass unchanged, a clashing ``out_col`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value["model"]
        known = WordTerms(shared.value["selected"])
        for batch in texts:
            yield pd.Series([value(model, text_terms(t, known)) for t in batch], dtype="float64")

    return docs.withColumn(out_col, of(F.col(text_col)))


def labelled_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> DataFrame:
    """text, label of at most ``train_docs`` labels: those of the least hashes of their ids, chosen before the join,
    so that what is broadcast has a proven bound and ``docs`` is read without a shuffle."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("label_id").isNotNull())
    # the rows of the least hashes, so that reruns fit the same; of equal hashes and ids any order is the same rows
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(train_docs)
    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(known), F.col("own_id") == F.col("label_id")).select("text", "label")
