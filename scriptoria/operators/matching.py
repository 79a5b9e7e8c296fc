"""Matches of references to papers: exact DOI, else the best token-sort ratio of titles; ranking by token-set ratio; assignments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import identifiers as I
from scriptoria.functions import text as T
from scriptoria.operators.common import FULL, LIMB, Texts, lengths
from scriptoria.operators.fuzzy import TASKS, best_titles, common_length
from scriptoria.session import checkpoint_folder

def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_length(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among common words, and common words with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(both, with_left) if both else 0.0, ratio(both, with_right) if both else 0.0, ratio(with_left, with_right))


def match(refs: DataFrame, library: DataFrame) -> DataFrame:
    """ref_id, matched_id, confidence, strategy (doi, title or null). refs: ref_id, doi, title; library: id, doi, title.

    Titles are tried for references without a DOI match; the least id wins ties."""
    held = library.select("id", F.lower("doi").alias("d")).filter("d <> ''").groupBy("d").agg(F.min("id").alias("id"))  # many papers may have one DOI
    by_doi = refs.select("ref_id", I.doi_key(F.col("doi")).alias("d")).filter("d <> ''").join(held, "d")
    exact = by_doi.groupBy("ref_id").agg(F.min("id").alias("matched_id")).select("ref_id", "matched_id", F.lit(1.0).alias("confidence"), F.lit("doi").alias("strategy"))
    rest = refs.join(exact.select("ref_id"), "ref_id", "left_anti")
    best = best_titles(rest, library)
    fuzzy = best.select("ref_id", "matched_id", F.round(F.col("score") / 100, 3).alias("confidence"), F.lit("title").alias("strategy"))
    return refs.select("ref_id").join(exact.unionByName(fuzzy), "ref_id", "left")


def rematch(unmatched: DataFrame, new: DataFrame) -> DataFrame:
    """ref_id, matched_id of the references without a paper that an item just added answers."""
    return match(unmatched, new).filter("matched_id is not null").select("ref_id", "matched_id", "strategy")


def analyse(items: DataFrame, library: DataFrame) -> DataFrame:
    """ref_id, matched_id, strategy, has_file: what an import would meet. items as refs of ``match``; library: id, doi, title, filename."""
    files = library.select(F.col("id").alias("matched_id"), (F.coalesce("filename", F.lit("")) != "").alias("has_file"))
    return match(items, library).join(files, "matched_id", "left").select("ref_id", "matched_id", "strategy", F.coalesce("has_file", F.lit(False)).alias("has_file"))


#: Texts of a block of items, and rows of a part of the library, that one group scores; texts of a block where common words alone are counted.
BLOCK, PART, WIDE = 500, 100_000, 8_000
#: Titles scored at once: few at first, as near copies end the search.
CHUNKS = (256, 8192)


class Shelf:
    """Folded titles, each with its ids, for searches by token-set ratio of one item against all of them at once."""

    def __init__(self, rows: Iterable[tuple[str, object]]):
        ids: dict[str, list] = {}
        for t, i in rows:
            ids.setdefault(" ".join(sorted(set(t.split()))), []).append(i)  # the ratio knows sets of words only
        self.titles = sorted(ids, key=len)
        self.ids = [sorted(ids[t]) for t in self.titles]
        self.place = np.empty(len(ids), np.int64)  # by the least id
        self.place[sorted(range(len(ids)), key=lambda j: self.ids[j][0])] = np.arange(len(ids))
        self.size = np.fromiter(map(len, self.titles), np.int32, len(ids))
        words = [t.split() for t in self.titles]
        self.words = np.fromiter(map(len, words), np.int64, len(ids))
        flat = [x for w in words for x in w]
        number = {w: n for n, w in enumerate(dict.fromkeys(flat))}
        self.of = np.fromiter(map(number.__getitem__, flat), np.int32, len(flat))
        self.long = np.fromiter(map(len, number), np.int64, len(number))
        by_word = np.argsort(self.of, kind="stable")
        self.cut = np.append(0, np.cumsum(np.bincount(self.of, minlength=len(number)))).tolist()
        self.owner, self.number = np.repeat(np.arange(len(words)), self.words)[by_word], number

    @cached_property
    def texts(self) -> Texts:
        return Texts(self.titles)

    @cached_property
    def word(self) -> np.ndarray:
        """The word of each character of all titles; a word has the space behind it."""
        taken = self.long[self.of] + 1
        taken[(np.cumsum(self.words) - 1)[self.words > 0]] -= 1
        return np.repeat(self.of, taken)

    def where(self, word: str) -> np.ndarray:
        n = self.number.get(word)
        return self.owner[:0] if n is None else self.owner[self.cut[n] : self.cut[n + 1]]

    def _both(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each title the characters of the words it has in common, with spaces between, and whether there are any."""
        both = np.zeros(len(self.size), np.int32)
        for w in words:
            both[self.where(w)] += len(w) + 1
        shared = both > 0
        both -= shared
        return both, shared

    def _all_in(self, whole: str, both: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Titles that have all of the item's words, or none but these: they score 100, and no other does."""
        return np.flatnonzero(shared & ((both == len(whole)) | (both == self.size)))

    def _known(self, whole: str, both: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """What the common words alone give: they are the start of both sides, so their ratio to either is known."""
        known = np.where(shared, 100.0 * 2 * both / np.maximum(both + np.minimum(self.size, len(whole)), 1), 0.0)
        known[self._all_in(whole, both, shared)] = 100.0
        return known

    def known(self, item: str, k: int) -> list[tuple[float, object]]:
        """The ``k`` best (-score, id) by common words alone, equal scores by id: no score of these titles is less, and 100 is exact."""
        words = sorted(set(item.split()))
        whole, (both, shared) = " ".join(words), self._both(words)
        at = self._all_in(whole, both, shared)
        if len(at) >= k:
            return self._first(np.full(len(at), 100.0), at, k)
        known = self._known(whole, both, shared)
        at = np.flatnonzero(known >= np.partition(known, len(known) - k)[len(known) - k]) if len(known) > k else np.arange(len(known))
        return self._first(known[at], at, k)

    def best(self, item: str, k: int, floor: float = 0.0) -> list[tuple[float, object]]:
        """The ``k`` best (-score, id) of ``floor`` or more, equal scores by id.

        The k-th best by common words alone is a floor, too. Titles are scored if their length and characters may reach it,
        in order of a bound that no score exceeds, until it is below the k-th best.
        """
        words = sorted(set(item.split()))
        whole, size, (both, shared) = " ".join(words), self.size, self._both(words)
        known = self._known(whole, both, shared)
        if len(known) > k:
            floor = max(floor, float(np.partition(known, len(known) - k)[len(known) - k]))
        low, high = len(whole) * floor / (200 - floor) - 1, len(whole) * (200 - floor) / floor + 1 if floor else np.inf
        a, b = np.searchsorted(size, [low, high])
        bound = known.copy()
        if words:
            bound[a:b] = np.maximum(known[a:b], np.where(size[a:b] > 0, 100.0 * 2 * self.texts.shared(whole, a, b) / (size[a:b] + len(whole)), 0.0))
        order = np.flatnonzero(bound >= floor - 1e-9)
        order = order[np.argsort(-bound[order], kind="stable")]
        found, done, chunk = [], 0, CHUNKS[0]
        while done < len(order) and (len(found) < k or bound[order[done]] >= -found[-1][0] - 1e-9):
            some = order[done : done + chunk]
            if len(found) == k:
                some = some[bound[some] >= -found[-1][0] - 1e-9]
            done, chunk, score = done + chunk, CHUNKS[1], known[some]
            open_ = np.flatnonzero((score < 100) & (bound[some] > score))
            if len(open_):
                rest = self._rest(words, whole, some[open_])
                score[open_] = np.maximum(score[open_], 100.0 * 2 * (both[some[open_]] + shared[some[open_]] + rest) / (size[some[open_]] + len(whole)))
            found = sorted([*found, *self._first(score, some, k)])[:k]
        return found

    def _first(self, score: np.ndarray, which: np.ndarray, k: int) -> list[tuple[float, object]]:
        """The ``k`` best (-score, id) of titles; of these only the ``k`` best, by their least ids where scores are equal, have such rows."""
        best = np.lexsort((self.place[which], -score))[:k]
        return sorted((-float(score[j]), i) for j in best for i in self.ids[which[j]][:k])[:k]

    def _rest(self, words: list[str], whole: str, which: np.ndarray) -> np.ndarray:
        """The longest common subsequence of the item's own words and the own words of each of the titles ``which``."""
        texts, out, table = self.texts, np.zeros(len(which), np.int64), self.texts.places(whole)
        common, has, mark = np.zeros(len(self.number) + 1, bool), np.zeros((len(words), len(which)), bool), np.zeros(len(self.size), bool)
        common[[self.number[w] for w in words if w in self.number]] = True
        for i, w in enumerate(words):
            mark[self.where(w)] = True
            has[i] = mark[which]
            mark[self.where(w)] = False
        begin = np.cumsum([0, *[len(w) + 1 for w in words]])
        space, no_letter = np.searchsorted(texts.letters, ord(" ")), len(texts.letters)

        def parts(bits: int) -> list[tuple[int, np.uint64]]:
            return [(n, np.uint64(x)) for n in range(len(table)) if (x := bits >> LIMB * n & int(FULL))]

        spans = [(parts((1 << len(w)) - 1 << int(b)), parts(1 << int(b) + len(w))) for w, b in zip(words, begin, strict=False)]
        for piece in texts.pieces(which):
            grid = texts.grid(which[piece], lambda source: common[self.word[source]])
            kept = grid[:, ::-1] != no_letter
            last = grid.shape[1] - 1 - kept.argmax(axis=1)  # of the own words the last ends without a space
            row = np.flatnonzero(kept.any(axis=1) & (grid[np.arange(len(grid)), last] == space))
            grid[row, last[row]] = no_letter
            keep, later = np.full((len(table), len(piece)), FULL), np.zeros(len(piece), bool)
            for i in range(len(words) - 1, -1, -1):
                own = ~has[i, piece]
                for stays, span in ((own, spans[i][0]), (own & later, spans[i][1])):
                    for n, bits in span:
                        keep[n, ~stays] &= ~bits
                later |= own
            out[piece] = lengths(table, np.ascontiguousarray(grid.T), keep)
        return out


def ranked(items: DataFrame, library: DataFrame, k: int = 3, suggest: float = 70.0) -> DataFrame:
    """item_id, id, score, rank, suggested: the best ``k`` papers of the whole library by token-set ratio. items: item_id, name.

    Equal names are one text, and of equal titles only the ``k`` least ids can count. The texts, a query set, meet the titles block by
    block: each part of the library is scored against each block of texts and gives on the ``k`` best of a text only. First common words
    alone are counted. Where ``k`` titles of the whole library have all words of a text, or none but these, that is the answer; else
    the k-th best so far is a floor below which no part scores anything. Empty tables give no rows, a null name or title is empty.
    """
    checkpoint_folder(items.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in [*items.schema, *library.schema]}
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    named = items.select("item_id", T.fold_title(F.col("name")).alias("r"))
    of_title = Window.partitionBy("t").orderBy("id")
    b = library.select("id", T.fold_title(F.col("title")).alias("t")).withColumn("n", F.row_number().over(of_title)).filter(F.col("n") <= k).select("id", "t").checkpoint()  # met twice
    parts = max(1, math.ceil(b.count() / PART))

    def met(a: DataFrame, block: int, best: Callable[[Shelf, str, float], list]) -> DataFrame:
        """r, id, score, rank: the ``k`` best of ``a`` (r, floor) in all parts."""
        blocks = max(1, math.ceil(a.count() / block))
        left = a.select("r", "floor", dealt("r", blocks).alias("block"), every(parts).alias("part"))
        right = b.select("id", "t", dealt("t", parts).alias("part"), every(blocks).alias("block"))

        def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            shelf = Shelf(zip(y["t"], y["id"], strict=True)) if len(x) and len(y) else None
            rows = [(r, j, -s) for r, floor in zip(x["r"], x["floor"], strict=True) for s, j in best(shelf, r, floor)] if shelf else []
            return pd.DataFrame(rows, columns=["r", "id", "score"])

        left, right = (d.repartition(min(blocks * parts, TASKS), "block", "part") for d in (left, right))  # else small groups share a task, and these take long
        s = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(score, f"r string, id {kind['id']}, score double")
        place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("score"), "id"))
        return s.withColumn("rank", place).filter(F.col("rank") <= k)

    known = met(named.select("r", F.lit(0.0).alias("floor")).distinct(), WIDE, lambda shelf, r, floor: shelf.known(r, k)).checkpoint()
    floors = known.groupBy("r").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor")).select("r", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    done = known.join(floors.filter("floor = 100").select("r"), "r", "left_semi")
    best = done.unionByName(met(floors.filter("floor < 100"), BLOCK, lambda shelf, r, floor: shelf.best(r, k, floor)))
    return named.join(best, "r").select("item_id", "id", F.round("score", 2).alias("score"), "rank", ((F.col("rank") == 1) & (F.col("score") >= suggest)).alias("suggested"))


def greedy(scored: DataFrame) -> DataFrame:
    """One-to-one pairs of (file, id, score): the best of either side pair off, round by round, until none is left.

    Mutual bests are chosen all at once, which ends at the assignment that taking the best pair first gives;
    ties go to the least file, then id. Every round pairs at least the best pair left.
    """
    cut = (lambda d: d.checkpoint()) if scored.sparkSession.sparkContext.getCheckpointDir() else (lambda d: d)
    key = F.struct((-F.col("score")).alias("s"), "file", "id")
    left, done = scored.withColumn("key", key), None
    while True:
        f = left.groupBy("file").agg(F.min("key").alias("f"))
        i = left.groupBy("id").agg(F.min("key").alias("i"))
        pairs = cut(f.join(i, (F.col("f.id") == i["id"]) & (F.col("f") == F.col("i"))).select(F.col("f.file").alias("file"), F.col("f.id").alias("id"), (-F.col("f.s")).alias("score")))
        if not pairs.limit(1).count():
            return done if done is not None else pairs
        done = pairs if done is None else done.unionByName(pairs)
        left = cut(left.join(pairs.select("file"), "file", "left_anti").join(pairs.select("id"), "id", "left_anti"))


def in_order(choices: DataFrame) -> DataFrame:
    """file, id, tier, score: one-to-one, files in sorted order, each takes its first choice of what is left (least
    tier, then best score, then least id). choices: file, id, tier, score.

    A file may take its first choice as soon as no earlier file still has it among its choices; all such files
    take theirs at once, which is what going file by file gives. The first file left can always choose.
    """
    checkpoint_folder(choices.sparkSession)
    wish = F.struct("tier", (-F.col("score")).alias("s"), "id")
    left = choices.groupBy("file", "id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"))).alias("c")).select("file", "id", F.col("c.tier").alias("tier"), (-F.col("c.s")).alias("score")).checkpoint()
    done = None
    while done is None or left.limit(1).count():
        first = left.groupBy("file").agg(F.min(wish).alias("w")).select("file", F.col("w.id").alias("id"), F.col("w.tier").alias("tier"), (-F.col("w.s")).alias("score"))
        earliest = left.groupBy("id").agg(F.min("file").alias("file"))
        pairs = first.join(earliest, ["id", "file"]).select("file", "id", "tier", "score").checkpoint()
        done = pairs if done is None else done.unionByName(pairs)
        left = left.join(pairs.select("file"), "file", "left_anti").join(pairs.select("id"), "id", "left_anti").checkpoint()
    return done
