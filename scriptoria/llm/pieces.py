"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

Every segmentation of a text into pieces has a probability proportional to the product of its pieces'
weights, ``1 / rank ** theta`` by the piece's place in the model: a merge model holds no probabilities, its
scores are just these places, which follow the pieces' frequencies. Forward filtering sums the weights of
all ways to reach each position, as logarithms; backward sampling then draws, from the end, the piece by
which the position was reached. Draws come from a hash of the row key, the segment's number and the step, so a
document is always cut the same way, however rows are batched or retried, and other keys give other cuts.

Texts are cut into segments where no piece can cross (``check_cuts``): spaces with the whole word after them,
line feeds alone. A lattice is built once a segment and worker, and all segments of a batch are sampled in
lockstep with numpy; memory grows with the longest word by some 200 bytes a character. A character that is no piece becomes its UTF-8 bytes' pieces, also a literal U+2581,
which would otherwise read back as a space; so decoding returns every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptoria.llm.text import give_back, mix
from scriptoria.llm.token_count import META, check_cuts, model

SEGMENT = re.compile(r"\n| *[^ \n]+| +")
#: Arcs that a worker keeps; segments, and characters, that are sampled together; characters whose lattices are built together.
KEPT, LOCKSTEP, LOCKSTEP_CHARS, ADDED = 3_000_000, 60_000, 1_000_000, 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Piece texts with spaces for space marks, byte pieces, and hashes of all beginnings of pieces."""

    def __init__(self, path: str, theta: float):
        check_cuts(path)
        sp = model(path)
        self.size = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int64)
        ids: dict[str, int] = {}
        for i in range(self.size):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                self.bytes_of.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                ids.setdefault(text.replace(META, " "), i)
                self.bytes_of.append(text.replace(META, " ").encode())
        self.singles = {t for t in ids if len(t) == 1}
        prefix = {t[:k]: -1 for t in ids for k in range(1, len(t) + 1)} | ids
        self.longest = max(map(len, prefix))
        keys = np.array([self.hash(t) for t in prefix], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        self.ids = np.array(list(prefix.values()), np.int64)[order]
        first = min(ids.values())
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.bytes_in = np.array([len(x) for x in self.bytes_of], np.int64)
        self.bytes_at = np.cumsum(self.bytes_in) - self.bytes_in
        self.ln_weight = -theta * np.log(np.maximum(np.arange(self.size) - first + 2.0, 2.0))
        self.ln_least = -theta * np.log(self.size)
        if self.longest >= 64:
            raise ValueError("a piece of 64 characters or more")

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h


class Growing:
    """An array that doubles its room when it is full."""

    def __init__(self, dtype: type):
        self.room, self.n = np.zeros(1024, dtype), 0

    @property
    def used(self) -> np.ndarray:
        return self.room[: self.n]

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.used, np.zeros(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class Lattices:
    """Arcs of all known segments, grouped by the node they end at; nodes are numbered over all segments."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.end = Growing(np.int32), Growing(np.int32)  # of a segment: its first and last node
        self.first = Growing(np.int32)  # of a node: its first arc
        self.cdf = Growing(np.float64)  # of an arc: the share of its end node's arcs up to it
        self.back = Growing(np.int32)  # of an arc: the node it comes from
        self.piece = Growing(np.int32)  # of an arc: its piece, or -1 - code point

    def add(self, segments: list[str]) -> None:
        p = self.pieces
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = np.cumsum(sizes) - sizes
        room = np.repeat(sizes, sizes) - (np.arange(len(chars)) - np.repeat(at, sizes))  # characters to the segment's end
        node0 = at + np.arange(len(segments))  # n characters have n + 1 nodes
        node_of = np.arange(len(chars)) + np.repeat(np.arange(len(segments)), sizes)
        live, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        starts, lengths, found = [], [], []
        single = np.zeros(len(chars), bool)
        for k in range(1, p.longest + 1):
            ok = room[live] >= k
            live, h = live[ok], h[ok]
            if not len(live):
                break
            h = h * _BASE + chars[live + k - 1] + np.uint64(1)
            where = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
            hit = p.keys[where] == h
            live, h, ids = live[hit], h[hit], p.ids[where[hit]]
            whole = ids >= 0
            starts.append(live[whole])
            lengths.append(np.full(int(whole.sum()), k, np.int64))
            found.append(ids[whole])
            if k == 1:
                single[live[whole]] = True
        lone = np.flatnonzero(~single)
        n_bytes = 1 + (chars[lone] >= 0x80) + (chars[lone] >= 0x800) + (chars[lone] >= 0x10000)
        starts, lengths = np.concatenate([*starts, lone]), np.concatenate([*lengths, np.ones(len(lone), np.int64)])
        ln_weight = np.concatenate([p.ln_weight[np.concatenate(found)] if found else np.zeros(0), p.ln_least * n_bytes])
        piece = np.concatenate([*found, -1 - chars[lone].astype(np.int64)])
        back, to = node_of[starts], node_of[starts] + lengths
        nodes = int(len(chars) + len(segments))
        order = np.argsort(to * 64 - lengths)  # a piece has fewer than 64 characters
        starts, back, to, piece, ln_weight = starts[order], back[order], to[order], piece[order], ln_weight[order]
        depth = starts - np.repeat(at, sizes)[starts] + lengths[order]
        by_depth = np.argsort(depth, kind="stable")  # within a depth arcs stay together by the node they end at
        cuts = np.append(0, np.cumsum(np.bincount(depth, minlength=2)[1:]))
        alpha = np.zeros(nodes)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # forward filtering, one position of all segments at a time
            if a < b:
                arcs = by_depth[a:b]
                ends = to[arcs]
                firsts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
                alpha[ends[firsts]] = np.logaddexp.reduceat(alpha[back[arcs]] + ln_weight[arcs], firsts)
        share = np.exp(alpha[back] + ln_weight - alpha[to])
        total = np.cumsum(share)
        new = np.append(True, to[1:] != to[:-1])
        base = (total - share)[new][np.cumsum(new) - 1]
        part = total - base
        part[np.append(new[1:], True)] = 2.0  # the last arc takes what rounding leaves
        nodes_before, arcs_before = self.first.n, self.cdf.n
        self.number.update(zip(segments, range(len(self.number), len(self.number) + len(segments)), strict=True))
        self.start.extend(node0 + nodes_before)
        self.end.extend(node0 + sizes + nodes_before)
        self.first.extend(np.searchsorted(to, np.arange(nodes)) + arcs_before)
        self.cdf.extend(part)
        self.back.extend(back + nodes_before)
        self.piece.extend(piece)

    def numbers(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))

    def sample(self, found: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all segments in order, and how many each segment has. seeds: one a segment."""
        seg = self.numbers(found)
        unknown = np.flatnonzero(seg < 0)
        new = list(dict.fromkeys([found[i] for i in unknown.tolist()]))
        if self.cdf.n > KEPT:
            self.forget()
            unknown, new = np.arange(len(found)), list(dict.fromkeys(found))
        pending, size = [], 0
        for k, segment in enumerate(new, 1):
            pending.append(segment)
            size += len(segment)
            if size >= ADDED or k == len(new):
                self.add(pending)
                pending, size = [], 0
        seg[unknown] = self.numbers([found[i] for i in unknown.tolist()])
        node, start = self.end.used[seg], self.start.used[seg]
        first, cdf, back, named = self.first.used, self.cdf.used, self.back.used, self.piece.used
        live, steps = np.arange(len(found)), np.zeros(len(found), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            u = (mix(seeds[live] + np.uint64((len(drawn) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = first[node[live]]
            beyond = np.flatnonzero(cdf[arc] <= u)
            while len(beyond):
                arc[beyond] += 1
                beyond = beyond[cdf[arc[beyond]] <= u[beyond]]
            drawn.append((live, named[arc]))
            node[live] = back[arc]
            steps[live] += 1
            live = live[node[live] != start[live]]
        after = np.cumsum(steps)
        out = np.zeros(int(after[-1]) if len(after) else 0, np.int32)
        for k, (who, piece) in enumerate(drawn):
            out[after[who] - 1 - k] = piece
        return self.spelled(out, steps)

    def spelled(self, out: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        lone = np.flatnonzero(out < 0)
        if not len(lone):
            return out, steps
        spelled = [[int(self.pieces.byte_ids[b]) for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in out[lone].tolist()]
        more = np.ones(len(out), np.int64)
        more[lone] = [len(x) for x in spelled]
        owner = np.repeat(np.arange(len(steps)), steps)
        place = np.cumsum(more) - more
        grown = np.repeat(out, more)
        for at, ids in zip(place[lone].tolist(), spelled, strict=True):
            grown[at : at + len(ids)] = ids
        return grown, np.bincount(owner, more, len(steps)).astype(np.int64)


_KNOWN: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, theta: float) -> Lattices:
    if (path, theta) not in _KNOWN:
        _KNOWN[path, theta] = Lattices(Pieces(path, theta))
    return _KNOWN[path, theta]


def seed_of(key: str, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode("utf-8", "surrogatepass")))


def encode_texts(keys: list, texts: list[str | None], known: Lattices, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of consecutive texts in order and how many each text has, some ``LOCKSTEP`` segments or ``LOCKSTEP_CHARS`` at a time."""
    chars = 0
    found: list[str] = []
    counts: list[int] = []
    seeds: list[np.ndarray] = []

    def drawn() -> tuple[np.ndarray, np.ndarray]:
        pieces, sizes = known.sample(found, np.concatenate(seeds))
        upto = np.append(0, np.cumsum(sizes))[np.cumsum(counts)]
        return pieces, np.diff(upto, prepend=0)

    for key, text in zip(keys, texts, strict=True):
        own = SEGMENT.findall(" " + text) if text else []
        found.extend(own)
        counts.append(len(own))
        chars += len(text or "")
        seeds.append(mix(seed_of(key, seed) + np.arange(len(own), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        if len(found) >= LOCKSTEP or chars >= LOCKSTEP_CHARS:
            yield drawn()
            found.clear(), counts.clear(), seeds.clear()
            chars = 0
    if counts:
        yield drawn()


def decode_texts(ids: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of consecutive runs of pieces; a text's first byte is the space that encoding puts before it."""
    n = pieces.bytes_in[ids]
    after = np.cumsum(n)
    raw = pieces.table[np.repeat(pieces.bytes_at[ids] - after + n, n) + np.arange(int(after[-1]) if len(n) else 0)].tobytes()
    cuts = np.append(0, after)[np.append(0, np.cumsum(sizes))].tolist()
    return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _lists(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]))
    flat = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _key(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(key.cast("string"), F.lit("null"))


def encode(docs: DataFrame, path: str, key: Column | str = "doc_id", text_col: str = "text", out_col: str = "piece_ids", theta: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with ``out_col`` (array<int>): one sampled segmentation of the whole text.

    Null and empty texts have no pieces; a null key seeds like the word null. Equal keys and texts give
    equal pieces. Other columns and repeated rows pass unchanged; a clashing ``out_col`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = lattices(path, theta)
        for keys, texts in batches:
            ids, sizes = [], []
            for i, n in encode_texts(keys.to_pylist(), texts.to_pylist(), known, seed):
                ids.append(i), sizes.append(n)
            yield _lists(ids, sizes)
        keys = texts = ids = sizes = i = n = None  # the worker lives on, for tasks that need the memory
        known.forget()
        give_back()

    return docs.withColumn(out_col, of(_key(key), F.col(text_col)))


def _checked(batches: Iterator[tuple[pa.Array, pa.Array]], path: str, theta: float, seed: int) -> Iterator[pa.Array]:
    known = lattices(path, theta)
    for keys, texts in batches:
        whole = texts.to_pylist()
        ids, sizes, same = [], [], []
        for i, n in encode_texts(keys.to_pylist(), whole, known, seed):
            same.extend(back == (text or "") for back, text in zip(decode_texts(i, n, known.pieces), whole[len(same) :], strict=False))
            ids.append(i), sizes.append(n)
        yield pa.StructArray.from_arrays([_lists(ids, sizes), pa.array(same, pa.bool_())], ["piece_ids", "lossless"])
    keys = texts = whole = ids = sizes = same = i = n = None  # the worker lives on, for tasks that need the memory
    known.forget()
    give_back()


def encode_checked(docs: DataFrame, path: str, key: Column | str = "doc_id", text_col: str = "text", theta: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` with piece_ids as ``encode`` gives them and lossless: whether they decode to the very text.

    Both happen in one worker, so pieces do not travel there twice. Null and empty texts have no pieces and
    are lossless; clashing columns are replaced.
    """

    @F.arrow_udf("struct<piece_ids:array<int>,lossless:boolean>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _checked(batches, path, theta, seed)

    # called so that a filter on lossless is not planned as a second run of the function
    coded = docs.withColumn("piece_ids", of.asNondeterministic()(_key(key), F.col(text_col)))
    return coded.withColumn("lossless", F.col("piece_ids.lossless")).withColumn("piece_ids", F.col("piece_ids.piece_ids"))


def decode(docs: DataFrame, path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``: the text of the pieces; no pieces or null give the empty text."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = lattices(path, 1.0).pieces
        for lists in batches:
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.array(decode_texts(ids, sizes, pieces), pa.string())

    return docs.withColumn(out_col, of(F.col(ids_col)))
