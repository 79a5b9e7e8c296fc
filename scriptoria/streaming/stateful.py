"""Runs of a user's events as a stateful stream: what has been seen of a user is kept between batches and let go by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Users share so many groups, as a group costs Spark some ten milliseconds whatever it holds. A checkpoint stands and falls with it.
BUCKETS = 512
#: Times as microseconds.
RUN = "user_id long, start long, stop long, n long, total double, closed boolean"
#: The open runs of a bucket, by user.
STATE = "user_id array<long>, start array<long>, stop array<long>, n array<long>, total array<double>"
_FIELDS = {"user_id": np.int64, "start": np.int64, "stop": np.int64, "n": np.int64, "total": np.float64}


def user_runs(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """user_id, start, stop, n, total, closed of a stream (event_id, ts, user_id, value): runs of events less than ``gap`` apart.

    A run is given as closed when an event behind its gap comes, or when the watermark has passed its gap: then it is let go, by
    a timer or with the next events of its bucket. The open run of a user is given after every batch that changes it. Events that come twice
    within the watermark count once, and those behind it are dropped by Spark (``intake.split_late`` keeps them).
    Null users and times are dropped; a null value adds nothing. Users are dealt to ``buckets`` groups by a hash.
    """
    wide = pd.Timedelta(gap).value // 1000
    clean = events.filter("ts is not null and user_id is not null").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value"))
    clean = clean.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    dealt = clean.select("event_id", "ts", F.unix_micros("ts").alias("at"), "user_id", "value", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"))

    def step(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else [[]] * len(_FIELDS)
        known = pd.DataFrame({c: np.array(v, kind) for (c, kind), v in zip(_FIELDS.items(), kept, strict=True)})
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            out = known.iloc[:0].assign(closed=True)
        else:
            # events of one batch; they may come in several pieces, in any order
            out, known = continued(known, pd.concat(batches), wide)
        over = (known["stop"].to_numpy() + wide) // 1000 < now
        last = out.loc[~out["closed"], "user_id"]
        over &= ~known["user_id"].isin(last).to_numpy()  # of these the open run was just given
        out = pd.concat([out, known[over].assign(closed=True)])
        known = known[~over]
        if len(known):
            state.update(tuple(known[c].tolist() for c in _FIELDS))
            state.setTimeoutTimestamp(max(int(known["stop"].min() + wide) // 1000, now + 1))
        else:
            state.remove()
        yield out

    runs = dealt.groupBy("bucket").applyInPandasWithState(step, RUN, STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return runs.select("user_id", F.timestamp_micros("start").alias("start"), F.timestamp_micros("stop").alias("stop"), "n", "total", "closed")


def continued(known: pd.DataFrame, seen: pd.DataFrame, wide: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """All runs that end or change, with closed; and the open runs after it. known: open runs, a row a user; seen: event_id, at, user_id, value."""
    seen = seen.sort_values(["user_id", "at", "event_id"])
    user, at, value = seen["user_id"].to_numpy(np.int64), seen["at"].to_numpy(np.int64), seen["value"].astype(float).fillna(0.0).to_numpy()
    first = np.append(True, user[1:] != user[:-1])
    known = known.sort_values("user_id").reset_index(drop=True)
    # a user's open run counts as seen before its first event
    where = np.searchsorted(known["user_id"].to_numpy(), user)
    has = np.append(known["user_id"].to_numpy(), 0)[where] == user
    has &= where < len(known)
    lowest = np.iinfo(np.int64).min // 2
    before = np.where(first, lowest, np.append(lowest, at[:-1]))
    before = np.maximum(before, np.where(has, np.append(known["stop"].to_numpy(), 0)[where], lowest))
    new = at - before >= wide
    begins = np.flatnonzero(first | new)
    ends = np.append(begins[1:], len(at)) - 1
    runs = pd.DataFrame({"user_id": user[begins], "start": at[begins], "stop": at[ends], "n": ends - begins + 1, "total": np.add.reduceat(value, begins)})
    going_on = (first & has & ~new)[begins]
    old = known.iloc[where[begins][going_on]]
    runs.loc[going_on, "start"] = np.minimum(runs["start"].to_numpy()[going_on], old["start"].to_numpy())
    runs.loc[going_on, "stop"] = np.maximum(runs["stop"].to_numpy()[going_on], old["stop"].to_numpy())
    runs.loc[going_on, "n"] += old["n"].to_numpy()
    runs.loc[going_on, "total"] += old["total"].to_numpy()
    runs["closed"] = np.append(~first[begins][1:], False)  # another run of the user follows
    replaced = known.iloc[where[first & has & new]].assign(closed=True)
    rest = known[~known["user_id"].isin(user)]
    return pd.concat([replaced, runs]), pd.concat([rest, runs.loc[~runs["closed"], list(_FIELDS)]])
