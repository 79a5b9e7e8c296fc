"""Longest common subsequences of one text with many others at once: a step a character, all others in one array.

Where only long ones count (``in_band``), pairs of several texts share the steps, and a pair needs one number, as its matches lie in a band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bits of a number that hold places of the text; one is left for the carry. Characters of others that one step's arrays hold.
LIMB, CELLS = 63, 1 << 20
FULL, SHIFT = np.uint64((1 << LIMB) - 1), np.uint64(LIMB)
BINS = 64
#: Characters that one move of a band's number goes on, and that pairs leave out of both texts together, so that the band fits a number.
MOVE = 4
BAND, LOOK = 64 - MOVE, 4 * MOVE
#: Texts that are counted at once.
COUNTED = 1 << 12


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Texts:
    """Many texts, character by character, and how often each holds a character (dealt to bins)."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        flat = points("".join(texts))
        there = np.zeros(int(flat.max(initial=0)) + 1, bool)
        there[flat] = True
        self.letters = np.flatnonzero(there[: len(there) if len(flat) else 0]).astype(np.uint32)
        number = np.zeros(len(there), np.min_scalar_type(len(self.letters)))
        number[self.letters] = np.arange(len(self.letters))
        self.code = number[flat]
        self.bags = np.zeros((BINS, len(texts)), np.min_scalar_type(int(self.size.max(initial=0))))
        for i in range(0, len(texts), COUNTED):
            size = self.size[i : i + COUNTED]
            part = flat[self.start[i] :][: int(size.sum())]
            at = (part % BINS).astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size)
            self.bags[:, i : i + COUNTED] = np.bincount(at, minlength=BINS * len(size)).reshape(BINS, len(size))

    def shared(self, text: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        """How many characters each (from ``begin`` to ``end``) may have in common with ``text`` at most: sums of minima never fall short of the
        longest common subsequence."""
        own = np.bincount(points(text) % BINS, minlength=BINS)
        bags = self.bags[:, begin:end]
        out = np.zeros(bags.shape[1], np.min_scalar_type(len(text)))  # the sum is at most that
        least = np.empty(bags.shape[1], bags.dtype)
        own = np.minimum(own, np.iinfo(bags.dtype).max).astype(bags.dtype)
        for b in np.flatnonzero(own):
            np.minimum(bags[b], own[b], out=least)
            np.add(out, least, out=out, casting="unsafe")
        return out

    def cells(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the characters of the texts ``which`` in ``code``, and where they go in an array of (text, place)."""
        size = self.size[which]
        row = np.repeat(np.arange(len(which)), size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(self.start[which], size) + place, row * int(size.max(initial=0)) + place

    def pieces(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """Places in ``which``, texts of like length together, few enough for one step's arrays."""
        order = np.argsort(self.size[which], kind="stable")
        end = len(order)
        while end:
            begin = max(0, end - max(1, CELLS // max(1, int(self.size[which[order[end - 1]]]))))
            yield order[begin:end]
            end = begin

    def common(self, text: str, which: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of ``text`` with each of the texts ``which``."""
        out, table = np.zeros(len(which), np.int64), self.places(text)
        for piece in self.pieces(which):
            out[piece] = lengths(table, np.ascontiguousarray(self.grid(which[piece]).T))
        return out

    def grid(self, which: np.ndarray, lost: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """The letters of the texts ``which``, a row a text; ``lost`` tells of places in ``code`` which count as no letter."""
        source, target = self.cells(which)
        code = self.code[source].astype(np.intp)
        if lost is not None:
            code[lost(source)] = len(self.letters)
        out = np.full((len(which), int(self.size[which].max(initial=0))), len(self.letters), np.intp)
        out.ravel()[target] = code
        return out

    def places(self, text: str) -> np.ndarray:
        """For each number of 63 bits and each letter where it stands in ``text``; the last letter, of no text, stands nowhere."""
        own = points(text)
        table = np.zeros((max(1, -(-len(own) // LIMB)), len(self.letters) + 1), np.uint64)
        at = np.searchsorted(self.letters, own)
        for i, k in enumerate(at):
            if k < len(self.letters) and self.letters[k] == own[i]:
                table[i // LIMB, k] |= np.uint64(1 << (i % LIMB))
        return table


def lengths(table: np.ndarray, steps: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Lengths for texts given by columns of letters ``steps``; keep: for each number and text the places that count."""
    n = steps.shape[1]
    rows = [np.full(n, FULL) for _ in table]
    hit, total, carry = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    for letters in steps:
        for w, row in enumerate(rows):
            np.take(table[w], letters, out=hit, mode="clip")
            hit &= row
            if keep is not None:
                hit &= keep[w]
            np.add(row, hit, out=total)
            if w:
                total += carry
            if w + 1 < len(rows):
                np.right_shift(total, SHIFT, out=carry)
            row ^= hit
            row |= total
            row &= FULL
    return LIMB * len(rows) - sum(np.bitwise_count(row).astype(np.int64) for row in rows)


def columns(texts: Texts, longest: int) -> np.ndarray:
    """Letters of the texts of ``longest`` characters at most, a row a place, no letter behind the ends; the other texts have none at all."""
    which = np.flatnonzero(texts.size <= longest)
    size = texts.size[which]
    wide = int(size.max(initial=0))
    out = np.full((wide + MOVE, len(texts.size)), len(texts.letters), np.intp)
    for k in range(wide):
        has = which[size > k]
        out[k, has] = texts.code[texts.start[has] + k]
    return out


def windows(texts: Texts, refs: list[str]) -> np.ndarray:
    """Where each letter stands in each of ``refs``: by first place (from -BAND), text and letter the next 64 places as bits."""
    none, longest = len(texts.letters), max(map(len, refs))
    code = np.full((len(refs), longest), none, np.intp)
    for i, r in enumerate(refs):
        own = points(r)
        at = np.minimum(np.searchsorted(texts.letters, own), max(none - 1, 0))
        code[i, : len(own)] = np.where(texts.letters[at] == own, at, none) if none else none
    out = np.zeros((BAND + longest + MOVE, len(refs), none + 1), np.uint64)
    every, one = np.arange(len(refs)), np.uint64(1)
    for row in range(BAND + longest - 1, -1, -1):
        np.left_shift(out[row + 1], one, out=out[row])
        if row >= BAND:
            out[row, every, code[:, row - BAND]] |= one
    out[:, :, none] = 0
    return out


def in_band(texts: Texts, letters: np.ndarray, refs: list[str], of: np.ndarray, which: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For pairs of a text ``refs[of]`` and one of ``texts``, the length of the longest common subsequence if it is ``need`` or more, else a lesser number.

    letters: ``columns``. With m and n characters, m - need of the one and n - need of the other are left out at most, so a match stands at
    most so far before or behind its place: a band of m + n - 2 need + 1 places, at most ``BAND`` + 1. A column's number holds
    the band's places only and moves on with it. A pair ends where all that is left of its text could not make up for what it has missed.
    """
    out, n = np.zeros(len(which), np.int64), texts.size[which]
    table = windows(texts, refs)
    step, table = table[0].size, table.ravel()
    move, low, top = np.uint64(MOVE), np.uint64((1 << MOVE) - 1), np.uint64((1 << MOVE) - 1 << BAND)
    at = (BAND - (n - need)) * step + of * (len(texts.letters) + 1)
    row, got, pair = np.full(len(which), ~np.uint64(0)), np.zeros(len(which), np.int64), np.arange(len(which))
    held = lambda: got + 64 - np.bitwise_count(row)
    first = 0
    while len(pair):
        letter, hit, total = np.empty(len(pair), np.intp), np.empty(len(pair), np.uint64), np.empty(len(pair), np.uint64)
        for k in range(first, min(first + LOOK, len(letters) // MOVE * MOVE), MOVE):
            for column in letters[k : k + MOVE]:
                np.take(column, which, out=letter, mode="clip")
                letter += at
                np.take(table, letter, out=hit, mode="clip")  # beyond the end there is no match
                hit &= row
                np.add(row, hit, out=total)
                row ^= hit
                row |= total
            got += MOVE - np.bitwise_count(row & low)
            row >>= move
            row |= top
            at += MOVE * step
        first += LOOK
        now = held()
        over = first >= n
        out[pair[over]] = now[over]
        keep = ~over & (now + n - first >= need)
        which, n, need, at, row, got, pair = which[keep], n[keep], need[keep], at[keep], row[keep], got[keep], pair[keep]
    return out
