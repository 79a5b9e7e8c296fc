"""The best library title of each reference by token-sort ratio, through an index of positional character trigrams.

Titles are compared as their words in order of the alphabet. A score of at least s per cent means that both texts,
of m and n characters, have a common subsequence of K = ceil(s (m + n) / 200) characters; so at most D = m - K
characters of the reference are dropped and I = n - K are put in. This gives filters that lose no such pair:

* length: K is at most the shorter length, so lengths differ by a factor of (200 - s) / s at most;
* count: texts have K characters in common at least, wherever they stand;
* place: what is matched stands at most D places earlier or I places later, which is a band of the table of all
  places that fits a number for texts of some 400 characters together;
* end: a pair is left as soon as it has missed more than it may.

The first two are sums over whole arrays of titles; what is left is scored exactly, many references and titles at once
(``common.in_band``); pairs that are too long for that are scored by the whole table.

Equal titles are one, the least id's, and equal references too. The library is dealt by bands of length, and large bands
by a hash, into parts of bounded size; references, a query set, come in blocks to the parts of their own band and its
neighbours. A part gives one row a reference.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.operators.common import BAND, Texts, columns, in_band

LEAST, LEAST_LENGTH = 85, 10
#: Titles of a part of the library, references of a block, and the most tasks that their groups are dealt to.
PART, BLOCK, TASKS = 20_000, 8_000, 2_000
#: References, and pairs of one with a title, that are scored at once; one reference's pairs are not parted.
CHUNKS = (32, 1 << 15)
#: Titles of more characters are scored by the whole table. Numbers that the tables of references scored at once hold, one reference aside.
LONGEST, HELD = 512, 1 << 21


def sorted_words(text: Column) -> Column:
    """Lower case, words in order, one space between them; null and blank titles are empty."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits a step."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Titles:
    """Titles in order of length."""

    def __init__(self, texts: list[str], ids: list):
        order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), ids[i]))
        self.texts, self.ids = [texts[i] for i in order], [ids[i] for i in order]
        self.chars = Texts(self.texts)
        self.size = self.chars.size
        self.letters = columns(self.chars, LONGEST)
        self.room = max(1, HELD // ((len(self.chars.letters) + 1) * (LONGEST + 2 * BAND)))  # references of short pairs have no more characters than that

    def near(self, ref: str, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all titles that may reach ``least``, few others, and how many characters each needs in common for it."""
        m = len(ref)
        low, high = -(-least * m // (200 - least)), (200 - least) * m // least
        a, b = np.searchsorted(self.size, [low, high + 1])
        n = self.size[a:b]
        need = -(-least * (m + n) // 200)
        at = np.flatnonzero((self.chars.shared(ref, a, b) >= need) & (need <= np.minimum(n, m)))
        return a + at, need[at]

    def candidates(self, ref: str, least: int = LEAST) -> np.ndarray:
        return self.near(ref, least)[0]

    def best(self, ref: str, least: int = LEAST) -> tuple[float, object] | None:
        return self.best_of([ref], least)[0]

    def best_of(self, refs: list[str], least: int = LEAST) -> list[tuple[float, object] | None]:
        """Of each reference the score and id of the best title of ``least`` or more, the least id among equals."""
        found: list[tuple[float, object] | None] = [None] * len(refs)
        held, pairs = [], 0
        for i, ref in enumerate(refs):
            at, need = self.near(ref, least)
            if len(at):
                held.append((i, at, need))
                pairs += len(at)
            if held and (i + 1 == len(refs) or len(held) == min(CHUNKS[0], self.room) or pairs >= CHUNKS[1]):
                self._score(refs, held, found)
                held, pairs = [], 0
        if held:
            self._score(refs, held, found)
        return found

    def _score(self, refs: list[str], held: list[tuple[int, np.ndarray, np.ndarray]], found: list) -> None:
        texts = [refs[i] for i, _, _ in held]
        of = np.repeat(np.arange(len(held)), [len(at) for _, at, _ in held])
        which, need = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        both = np.array([len(t) for t in texts])[of] + self.size[which]
        short = (both - 2 * need <= BAND) & (self.size[which] <= LONGEST)
        common = np.zeros(len(which), np.int64)
        some, number = np.unique(of[short], return_inverse=True)
        if len(some):
            common[short] = in_band(self.chars, self.letters, [texts[i] for i in some], number, which[short], need[short])
        for r in np.unique(of[~short]):
            at = np.flatnonzero(~short & (of == r))
            common[at] = self.chars.common(texts[r], which[at])
        for p in np.flatnonzero(common >= need):
            i, here = held[of[p]][0], (200.0 * float(common[p]) / float(both[p]), self.ids[which[p]])
            if found[i] is None or (-here[0], here[1]) < (-found[i][0], found[i][1]):
                found[i] = here


def best_titles(refs: DataFrame, library: DataFrame, least: int = LEAST) -> DataFrame:
    """ref_id, matched_id, score of the references (ref_id, title) that a title of ``library`` (id, title) answers.

    Titles of fewer than ten characters and null ones are answered by none, and empty ones answer none; the least id
    wins ties; a repeated reference is answered once. Empty tables give no rows.
    """
    width = math.log((200 - least) / least) + 1e-6
    band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.lit(width)).cast("int")
    asked = refs.filter(F.length(F.trim("title")) >= LEAST_LENGTH).select("ref_id", sorted_words(F.col("title")).alias("r")).filter("r <> ''").distinct()
    r = asked.select("r").distinct()
    t = library.select("id", sorted_words(F.col("title")).alias("t")).filter("t <> ''").groupBy("t").agg(F.min("id").alias("matched_id")).withColumn("t_band", band("t"))
    n_asked = r.count()
    # a few dozen bands: as many as the logarithm of the longest title
    parts = {x["t_band"]: math.ceil(x["count"] / PART) for x in t.groupBy("t_band").count().collect()} if n_asked else {}
    kind = {f.name: f.dataType.simpleString() for f in [*refs.schema, *library.schema]}
    if not parts:
        return refs.sparkSession.createDataFrame([], f"ref_id {kind['ref_id']}, matched_id {kind['id']}, score double")
    blocks = max(1, math.ceil(n_asked / BLOCK))
    n_parts = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    near = F.filter(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: band("r") + k), lambda b: F.coalesce(n_parts[b], F.lit(0)) > 0)
    r = r.select("r", F.explode(near).alias("r_band"), F.pmod(F.xxhash64("r"), F.lit(blocks)).alias("r_block"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), n_parts[F.col("r_band")] - 1)).alias("r_part"))
    t = t.withColumn("t_part", F.pmod(F.xxhash64("t"), n_parts[F.col("t_band")]).cast("int"))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("t_block"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        titles = Titles(right["t"].tolist(), right["matched_id"].tolist()) if len(left) and len(right) else None
        asked = left["r"].tolist()
        rows = [(x, b[1], b[0]) for x, b in zip(asked, titles.best_of(asked, least), strict=True) if b] if titles else []
        return pd.DataFrame(rows, columns=["r", "matched_id", "score"])

    n = min(blocks * sum(parts.values()), TASKS)
    r, t = r.repartition(n, "r_band", "r_part", "r_block"), t.repartition(n, "t_band", "t_part", "t_block")  # else small groups share a task, and these take long
    found = r.groupBy("r_band", "r_part", "r_block").cogroup(t.groupBy("t_band", "t_part", "t_block")).applyInPandas(score, f"r string, matched_id {kind['id']}, score double")
    best = found.groupBy("r").agg(F.min(F.struct((-F.col("score")).alias("s"), "matched_id")).alias("b"))
    of_ref = asked.join(best, "r").groupBy("ref_id").agg(F.min("b").alias("b"))
    return of_ref.select("ref_id", F.col("b.matched_id").alias("matched_id"), (-F.col("b.s")).alias("score"))
