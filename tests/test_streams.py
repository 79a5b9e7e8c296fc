"""Streams that are killed, replayed and repaired; late rows; state over several batches; calls that fail."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptoria.operators import calls
from scriptoria.streaming import intake, stateful

STEPS = {"words": lambda docs, _: docs.select("id", F.size(F.split("text", " ")).alias("n")), "double": lambda _, rows: rows["words"].select("id", (2 * F.col("n")).alias("n"))}


def drop(spark, folder, name, rows, schema="id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema="id long, text string"):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def content(spark, root, name):
    return sorted((r["id"], r["n"]) for r in spark.read.parquet(f"{root}/{name}").collect())


def test_intake_killed_between_steps_and_replayed(spark, tmp_path):
    root = str(tmp_path / "root")
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "")], "id long, text string")

    def killed(docs, rows):
        raise KeyboardInterrupt  # no Exception: nothing is written down, as when the machine goes

    with pytest.raises(KeyboardInterrupt):
        intake.take_in(docs, 0, root, {"words": STEPS["words"], "double": killed})
    assert {r["step"] for r in intake.ledger(spark, root).collect()} == {"papers", "words"}
    files = lambda: {r[0] for r in spark.read.parquet(f"{root}/words").select(F.input_file_name()).collect()}
    before = files()
    intake.take_in(docs, 0, root, STEPS)
    assert content(spark, root, "double") == [(1, 4), (3, 2)] and files() == before  # not done twice


def test_intake_of_a_folder_in_two_runs(spark, tmp_path):
    box, root, cp = (str(tmp_path / x) for x in ("box", "root", "cp"))
    drop(spark, box, "a", [(1, "one two"), (3, "")])
    intake.run(stream(spark, box), root, cp, STEPS)
    drop(spark, box, "b", [(4, "one two"), (5, "new")])
    intake.run(stream(spark, box), root, cp, STEPS)
    intake.take_in(spark.createDataFrame([(4, "one two"), (5, "new")], "id long, text string"), 1, root, STEPS)  # the second batch once more
    assert content(spark, root, "double") == [(1, 4), (3, 2), (5, 2)]
    assert intake.ledger(spark, root).count() == 6


def test_a_failed_step_is_written_down_and_repaired(spark, tmp_path):
    root = str(tmp_path / "root")
    docs = spark.createDataFrame([(1, "one two")], "id long, text string")
    bad = {"words": lambda d, _: d.select("missing"), "other": lambda d, _: d.select("id", F.lit(7).alias("n")), "double": STEPS["double"]}
    intake.take_in(docs, 0, root, bad)
    errors = {r["step"]: r["error"] for r in intake.ledger(spark, root).collect()}
    assert "missing" in errors["words"] and errors["other"] is None and errors["double"] is not None
    assert content(spark, root, "other") == [(1, 7)]
    good = {**bad, "words": STEPS["words"]}
    assert intake.repair(spark, root, good) == 2 and intake.repair(spark, root, good) == 0
    assert content(spark, root, "double") == [(1, 4)]


def test_late_rows_go_to_a_table_of_their_own(spark, tmp_path):
    root = str(tmp_path / "root")
    at = lambda h, k: (k, datetime(2024, 1, 1) + timedelta(hours=h))
    batches = [[at(0, 1), at(10, 2)], [at(8.5, 3), at(7.5, 4), at(12, 5)], [at(9, 6), at(11, 7)]]
    for number in (0, 1, 1, 2, 0):  # replays change nothing
        intake.split_late(spark.createDataFrame(batches[number], "id long, ts timestamp"), number, root, "2 hours")
    ids = lambda name: sorted(r["id"] for r in spark.read.parquet(f"{root}/{name}").collect())
    assert ids("in_time") == [1, 2, 3, 5, 7] and ids("late") == [4, 6]


def plain_runs(events):
    out, by_user = [], {}
    for k, ts, user, value in sorted(set(events), key=lambda e: (e[1], e[0])):
        run = by_user.get(user)
        if run is None or ts - run[2] >= timedelta(minutes=30):
            run = by_user[user] = [user, ts, ts, 0, 0.0]
            out.append(run)
        run[2], run[3], run[4] = ts, run[3] + 1, run[4] + (value or 0.0)
    return sorted((u, a, b, n, round(t, 6)) for u, a, b, n, t in out)


def test_runs_over_several_batches_with_repeats_and_timers(spark, tmp_path):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    events = [(k, start + timedelta(minutes=k * 3 + rng.random()), rng.randrange(5), rng.choice([1.5, None, 2.0])) for k in range(300)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    box, out, cp = (str(tmp_path / x) for x in ("box", "out", "cp"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    far = [(999, start + timedelta(days=3), 77, 1.0)]
    for k, rows in enumerate([events[:100], events[100:200] + events[90:100], events[200:] + events[200:205], far, [(1000, start + timedelta(days=3, minutes=1), 77, 1.0)]]):
        drop(spark, box, f"part{k}", [r for r in rows] if k != 1 else rng.sample(rows, len(rows)), schema)
        runs = stateful.user_runs(stream(spark, box, schema))
        runs.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    closed = found.filter("closed").collect()
    got = sorted((r["user_id"], r["start"], r["stop"], r["n"], round(r["total"], 6)) for r in closed)
    assert got == plain_runs(events)  # each run once; the last ones by the timer, when time went on


def test_many_users_share_few_groups(spark, tmp_path):
    """A user was a group of its own, and a group costs the same whatever it holds; also gaps of just the limit."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    events = [(k, start + timedelta(minutes=rng.choice([rng.randrange(600), rng.random() * 600])), rng.randrange(-30, 200), rng.choice([0.25, None, -2.0])) for k in range(2000)]
    events.sort(key=lambda e: e[1])
    pieces = [events[:900], events[900:1300], events[1300:]]
    schema = "event_id long, ts timestamp, user_id long, value double"
    box, out, cp = (str(tmp_path / x) for x in ("box", "out", "cp"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    groups = []
    for k, rows in enumerate([*pieces, [(-1, start + timedelta(days=3), 10**12, 1.0)]]):
        drop(spark, box, f"part{k}", rng.sample(rows, len(rows)), schema)
        q = stateful.user_runs(stream(spark, box, schema), buckets=4).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        groups += [o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"] if "WithState" in o["operatorName"]]
    closed = spark.read.parquet(out).filter("closed").collect()
    assert 0 < sum(groups) <= 2 * 4 * 4  # two batches a run, of which there are four
    got = sorted((r["user_id"], r["start"], r["stop"], r["n"], round(r["total"], 6)) for r in closed)
    assert got == plain_runs(events)


def test_runs_continued_at_once_are_those_of_a_loop():
    """Also where an event comes before the run that is known."""
    rng = random.Random(8)
    for _ in range(60):
        known = pd.DataFrame([(u, a := rng.randrange(100), a + rng.randrange(50), rng.randrange(1, 5), 0.5) for u in rng.sample(range(-4, 9), rng.randrange(6))], columns=["user_id", "start", "stop", "n", "total"])
        known = known.astype({c: "float64" if c == "total" else "int64" for c in known.columns})
        seen = pd.DataFrame([(k, rng.randrange(200), rng.randrange(-4, 9), rng.choice([0.25, None])) for k in range(rng.randrange(1, 40))], columns=["event_id", "at", "user_id", "value"])
        open_runs, out = {r[0]: list(r) for r in known.itertuples(index=False)}, []
        for e in seen.sort_values(["at", "event_id"]).itertuples():
            run = open_runs.get(e.user_id)
            if run is None or e.at - run[2] >= 20:
                out += [(*run, True)] if run else []
                run = open_runs[e.user_id] = [e.user_id, e.at, e.at, 0, 0.0]
            run[1:] = [min(run[1], e.at), max(run[2], e.at), run[3] + 1, run[4] + (0.0 if pd.isna(e.value) else e.value)]
        out += [(*open_runs[u], False) for u in set(seen["user_id"])]
        given, after = stateful.continued(known, seen, 20)
        assert sorted(given.itertuples(index=False, name=None)) == sorted(out)
        assert sorted(after.itertuples(index=False, name=None)) == sorted(map(tuple, open_runs.values()))


def test_calls_back_off_and_halve():
    waits: list[float] = []
    answer = lambda texts: [len(t) for t in texts]
    script = iter([calls.Busy("full", 90.0), calls.Busy("full"), None])

    def busy_twice(texts):
        if (e := next(script)) is not None:
            raise e
        return answer(texts)

    assert calls.send(busy_twice, ["a"], waits.append) == ([1], None, 3, 40.0) and waits == [30.0, 10.0]

    def always(texts):
        raise OSError("down")

    waits.clear()
    assert calls.settled(always, ["a", "bb"], waits.append) == [(None, "OSError: down", 3, 12.0)] * 2 and waits == [2.0, 10.0]

    def refuses(texts):
        if "bad" in texts:
            raise ValueError("no")
        return answer(texts)

    got = calls.settled(refuses, ["a", "bad", "ccc", "dd"], waits.append)
    assert [g[:2] for g in got] == [(1, None), (None, "ValueError: no"), (3, None), (2, None)]
    assert calls.send(lambda t: [None], ["a"], waits.append)[1] == calls.send(lambda t: [], ["a"], waits.append)[1] == "incomplete answer"


def test_batches_are_filled_across_pieces(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(0, 123, 1, 1).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.lit("x")).alias("text"))
        got = calls.answered(rows, lambda texts: [[float(len(texts)), float(len(t))] for t in texts]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r["answer"][0] for r in sorted(got, key=lambda r: r["id"])] == [50.0] * 100 + [23.0] * 23
    assert all(r["answer"][1] == (0.0 if r["id"] % 10 == 0 else 1.0) and r["error"] is None and r["calls"] == 1 for r in got)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_intake_of_a_folder_of_part_files(spark, sf_dir, tmp_path, parts):
    """A table of Spark's own writing is a folder; stream_intake found no file in it."""
    from scriptoria.plans import library
    from scriptoria.streaming import feeds

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    rows.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    rows.write.parquet(str(tmp_path / "documents.parquet2"))  # another table
    found = library.queries()["stream_intake"](spark, str(tmp_path))
    assert found.count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert feeds.table_stream(spark, sf_dir, "documents").isStreaming
