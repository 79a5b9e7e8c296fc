"""Texts sent to a service in batches, with a bounded wait for a service that is busy; failures are rows, not lost jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of a call; attempts, the longest single wait and the longest of all, in seconds; waits where the service names none.
BATCH, TRIES, SINGLE, BUDGET, WAITS = 50, 3, 30.0, 60.0, (2.0, 10.0)


class Busy(Exception):
    """The service asks for a later call, after ``retry_after`` seconds if it says so. OSError counts as busy too."""

    def __init__(self, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.retry_after = retry_after


def send(call: Callable[[list[str]], list], texts: list[str], sleep: Callable[[float], None]) -> tuple[list | None, str | None, int, float]:
    """Answers or error, calls made and seconds waited, of one batch."""
    waited, error = 0.0, None
    for attempt in range(TRIES):
        try:
            answers = list(call(texts))
            if len(answers) != len(texts) or any(a is None for a in answers):
                return None, "incomplete answer", attempt + 1, waited
            return answers, None, attempt + 1, waited
        except (Busy, OSError) as e:
            error = f"{type(e).__name__}: {e}"
            asked = getattr(e, "retry_after", None)
        except Exception as e:  # calling again would not help
            return None, f"{type(e).__name__}: {e}", attempt + 1, waited
        wait = max(0.0, min(WAITS[min(attempt, len(WAITS) - 1)] if asked is None else asked, SINGLE))
        if attempt + 1 == TRIES or waited + wait > BUDGET:
            break
        sleep(wait)
        waited += wait
    return None, error, attempt + 1, waited


def settled(call: Callable[[list[str]], list], texts: list[str], sleep: Callable[[float], None]) -> list[tuple]:
    """(answer, error, calls, waited) of each text. A batch that the service refuses for what it holds is halved, down to the
    texts that are to blame; a busy service is not asked again for the halves."""
    answers, error, calls, waited = send(call, texts, sleep)
    if answers is not None:
        return [(a, None, calls, waited) for a in answers]
    if len(texts) == 1 or error.startswith(("Busy", "OSError", "TimeoutError", "ConnectionError")):
        return [(None, error, calls, waited)] * len(texts)
    half = len(texts) // 2
    return [(a, e, calls + c, waited + w) for part in (texts[:half], texts[half:]) for a, e, c, w in settled(call, part, sleep)]


def answered(rows: DataFrame, call: Callable[[list[str]], list], kind: str = "array<float>", id_col: str = "id", text_col: str = "text", batch: int = BATCH, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """id, answer (``kind``), error, calls, waited (seconds) of each row: exactly one of answer and error is null.

    Batches are filled across the pieces in which Spark hands rows to a worker, so only the last one of a partition
    is short. calls and waited are those made for the row, its batch's included. Null texts are empty.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    answer = to_arrow_type(_parse_datatype_string(kind))
    id_kind = rows.schema[id_col].dataType
    names, types = ["id", "answer", "error", "calls", "waited"], [to_arrow_type(id_kind), answer, pa.string(), pa.int32(), pa.float64()]

    def ask(ids: list, texts: list[str]) -> pa.RecordBatch:
        found = settled(call, texts, sleep)
        columns = [ids, *map(list, zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        for b in batches:
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids.append(i), texts.append(t or "")
                if len(texts) == batch:
                    yield ask(ids, texts)
                    ids, texts = [], []
        if texts:
            yield ask(ids, texts)

    return rows.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(fill, f"id {id_kind.simpleString()}, answer {kind}, error string, calls int, waited double")
