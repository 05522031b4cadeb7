"""Windows and neighbours over streams with rows in any order, repeated and late."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from porewise.operators.neighbours import with_neighbour_errors
from porewise.streaming import neighbours, windows

BEGIN = datetime(2024, 5, 1, 6)
EVENT = "ts timestamp, user_id long, event_type string, value double"


def _stream(spark, folder, files, schema):
    """A stream that meets each of the lists of rows as one file, in order."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def _event(minute, user=1, kind="view", value=1.0):
    return (None if minute is None else BEGIN + timedelta(minutes=minute), user, kind, value)


def _sessions(events, gap=30):
    out, last = {}, {}
    for ts, user, _, value in sorted((e for e in events if e[0] is not None), key=lambda e: e[0]):
        if user in last and ts - last[user] <= timedelta(minutes=gap):
            out[user][-1] = (*out[user][-1][:2], ts, out[user][-1][3] + 1, out[user][-1][4] + value)
        else:
            out.setdefault(user, []).append((user, ts, ts, 1, value))
        last[user] = ts
    return sorted((r for rows in out.values() for r in rows), key=str)


def test_sessions_and_windows(spark):
    rng = random.Random(2)
    events = [_event(rng.random() * 3000, rng.choice([1, 2, 3, None]), "view", float(rng.randint(0, 9))) for _ in range(300)] + [_event(None)]
    df = spark.createDataFrame(events, EVENT)
    assert sorted(map(tuple, windows.sessions(df).collect()), key=str) == _sessions(events)
    got = {(r["event_type"], r["start"]): (r["events"], r["total"]) for r in windows.sliding(df).collect()}
    want = {}
    for ts, _, kind, value in events[:-1]:
        quarter = BEGIN + timedelta(minutes=15 * ((ts - BEGIN) // timedelta(minutes=15)))
        for i in range(4):
            n, total = want.get((kind, quarter - timedelta(minutes=15 * i)), (0, 0))
            want[kind, quarter - timedelta(minutes=15 * i)] = (n + 1, total + value)
    assert got == want
    assert windows.sessions(df.limit(0)).count() == 0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """A row behind the watermark opens no session and is counted; one before it joins its session."""
    files = [[_event(0), _event(10)], [_event(200), _event(35)], [_event(205)], [_event(20), _event(210), _event(40, user=2)], [_event(10_000, user=-1)], [_event(10_001, user=-1)]]
    stream = windows.sessions(windows.with_lateness(_stream(spark, tmp_path, files, EVENT), "2 hours"))
    found, query = windows.write_to_end(stream, "test-sessions")
    kept = [e for f in files for e in f if e[1] == 1 and e[0] != _event(20)[0]]
    assert not found.where("user_id = 2").count()
    assert sorted((tuple(r) for r in found.collect() if r["user_id"] == 1), key=str) == _sessions(kept)
    state = windows.state_of(query)
    assert state["late"] == 2 and state["batches"] >= 5 and state["most_state"] <= 4


@pytest.mark.parametrize("stretch", [8, 1 << 14])
def test_neighbours_of_a_stream(spark, tmp_path, stretch):
    """Rows in random files, repeated and out of order within the delay: the last versions equal the batch."""
    rng = random.Random(stretch)
    rows = [(rng.choice("ab"), s, rng.choice([0.1, 0.9, 0.6, None])) for s in range(-20, 60) if rng.random() < 0.8]
    rows += rng.sample(rows, 20) + [("a", None, 0.9), (None, 3, 0.9)]
    rng.shuffle(rows)
    timed = [(*r, BEGIN + timedelta(minutes=rng.randint(0, 30))) for r in rows]
    files = [timed[i::3] for i in range(3)]
    kind = "chr string, site long, mismatch_rate double, ts timestamp"
    found, query = windows.write_to_end(neighbours.neighbour_updates(_stream(spark, tmp_path, files, kind), stretch=stretch), "test-neighbours")
    got = {(r["chr"], r["site"]): r["neighbour_error_pos"] for r in neighbours.latest(found).collect()}
    batch = with_neighbour_errors(spark.createDataFrame([r for r in rows if r[0] and r[1] is not None], "chr string, site long, mismatch_rate double"))
    assert got == {(r["chr"], r["site"]): r["neighbour_error_pos"] for r in batch.collect()}
    assert found.count() > len(got) and windows.state_of(query)["late"] == 0


def test_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    far = BEGIN + timedelta(days=2)
    files = [[("a", 1, 0.9, BEGIN), ("a", 2, 0.1, BEGIN)], [("a", 100_000, 0.9, far)], [("a", 100_001, 0.9, far)], [("a", 100_002, 0.1, far), ("a", 3, 0.9, BEGIN)]]
    stream = neighbours.neighbour_updates(_stream(spark, tmp_path, files, "chr string, site long, mismatch_rate double, ts timestamp"))
    found, query = windows.write_to_end(stream, "test-evicted")
    assert {(r["site"], tuple(r["neighbour_error_pos"])) for r in neighbours.latest(found).collect()} == {(1, ()), (2, (-1,)), (100_000, (1,)), (100_001, (-1,)), (100_002, (-2, -1))}
    state = windows.state_of(query)
    assert state["late"] == 1 and query.lastProgress.stateOperators[0].numRowsTotal == 1


def test_reach_of_a_stretch(spark, tmp_path):
    stream = _stream(spark, tmp_path, [[("a", 1, 0.9, BEGIN)]], "chr string, site long, mismatch_rate double, ts timestamp")
    with pytest.raises(ValueError, match="longer"):
        neighbours.neighbour_updates(stream.withColumn("x", F.lit(1)), k=5, stretch=5)
