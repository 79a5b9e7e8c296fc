"""Token counts by a map-side two-tier lookup: no pre-token is ever shuffled.

Tier one is a broadcast table of the commonest pre-tokens and their lengths in tokens. It has at most
``frequent`` entries, whatever the corpus, so its size is bounded. Tier two is each Python worker's own
cache, filled by encoding what tier one misses and emptied when it is full. Tiers only save time: every
pre-token's length is what the tokenizer library gives, so counts don't depend on either.

A pre-token is a run of spaces with the following run of other characters, cut at line feeds. For the
piece model no piece has a space after another character and none but the byte piece has a line feed, so
no merge crosses a cut and lengths add up exactly; ``check_cuts`` asserts this for the model in use.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
PRE_TOKEN = re.compile(f"{META}+[^{META}\n]*|\n|[^{META}\n]+")
#: Entries of the broadcast table, of each task's list of common pre-tokens, of a worker's cache.
FREQUENT, PER_TASK, CACHED, LONGEST = 32_768, 4_096, 300_000, 64

_MODELS: dict[str, object] = {}


def model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def check_cuts(path: str) -> None:
    sp = model(path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if META in piece.lstrip(META) or "\n" in piece:
            raise ValueError(f"piece {piece!r} may cross a pre-token cut")


def pre_tokens(text: str) -> list[str]:
    return PRE_TOKEN.findall(META + text.replace(" ", META)) if text else []


def length_of(sp, pre_token: str) -> int:
    """Tokens of one pre-token; the library puts a space mark before any text, so a line feed shields the rest."""
    if pre_token == META:
        return 1
    if pre_token[0] == META:
        return len(sp.encode(pre_token[1:]))
    return 1 if pre_token == "\n" else len(sp.encode("\n" + pre_token)) - 2


class Lengths(dict):
    def __init__(self, frequent: dict[str, int], path: str):
        super().__init__(frequent)
        self.frequent, self.path = frequent, path

    def __missing__(self, pre_token: str) -> int:
        n = length_of(model(self.path), pre_token)
        if len(pre_token) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n


_LENGTHS: dict[int, Lengths] = {}


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", frequent: int = FREQUENT, per_task: int = PER_TASK) -> dict[str, int]:
    """The commonest pre-tokens of the whole table, from a bounded list of each task."""

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["t"]:
                if text:
                    seen.update(pre_tokens(text))
                    if len(seen) > CACHED:
                        seen = Counter(dict(seen.most_common(CACHED // 3)))
        top = [(w, n) for w, n in seen.most_common(per_task) if len(w) <= LONGEST]
        yield pd.DataFrame({"w": [w for w, _ in top], "n": [n for _, n in top]}).astype({"w": "str", "n": "int64"})

    rows = docs.select(F.col(text_col).alias("t")).mapInPandas(common, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(frequent).collect()
    sp = model(path)
    return {r["w"]: length_of(sp, r["w"]) for r in rows}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens", frequent: int = FREQUENT) -> DataFrame:
    """``docs`` with ``out_col`` (long): tokens of the whole text as the piece model at ``path`` gives them.

    Null and empty texts have 0 tokens; all other columns and repeated rows pass unchanged (a column
    already named ``out_col`` is replaced). An empty table gives an empty table.
    """
    check_cuts(path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, text_col, frequent))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _LENGTHS.get(id(table.value))
        if lengths is None:
            _LENGTHS.clear()
            lengths = _LENGTHS[id(table.value)] = Lengths(table.value, path)
        get = lengths.__getitem__
        for batch in texts:
            yield pd.Series([sum(map(get, pre_tokens(t))) if t else 0 for t in batch], dtype="int64")

    return docs.withColumn(out_col, n_tokens(F.col(text_col)))
