"""Streams over folders that grow: restarts, batches run again, late events, timers, and state that ends."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest import streaming
from palimpsest.streaming import stateful as S

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "job long, event_id long, at timestamp, kind string"


def moment(minutes):
    return START + dt.timedelta(minutes=minutes)


def add(spark, folder, name, rows, schema=SCHEMA):
    """One more file of the stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))


def fold(rows, upto):
    """The queue's transitions by one fold in plain Python; upto: what is due by then has happened."""
    micros = lambda t: int((t - START).total_seconds() * 1e6)
    out = []
    for job in {r[0] for r in rows}:
        status, tries, due = None, 0, None

        def late(until, job=job):
            nonlocal status, tries, due
            while due is not None and due <= until:
                if status == "retry":
                    out.append((job, due, "created", tries))
                    status, due = "created", None
                else:
                    out.append((job, due, "expired", tries))
                    fail(due)

        def fail(at, job=job):
            nonlocal status, tries, due
            if tries < 1:
                tries += 1
                status, due = "retry", at + 30 * 10**6
                out.append((job, at, "retry", tries))
            else:
                out.append((job, at, "failed", tries))
                status, tries, due = None, 0, None

        for _, _, t, kind in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            at = micros(t)
            late(at)
            if kind == "submit" and status is None:
                status, tries = "created", 0
                out.append((job, at, "created", 0))
            elif kind == "start" and status == "created":
                status, due = "active", at + 45 * 60 * 10**6
                out.append((job, at, "active", tries))
            elif kind == "fail" and status == "active":
                fail(at)
            elif kind == "done" and status == "active":
                out.append((job, at, "completed", tries))
                status, tries, due = None, 0, None
        late(micros(upto))
    return sorted(out)


def told(df):
    return sorted((r.job, int((r["at"].replace(tzinfo=r["at"].tzinfo or dt.timezone.utc).astimezone(dt.timezone.utc) - START).total_seconds() * 1e6), r.state, r.tries) for r in df.withColumn("at", F.col("at")).collect())


@pytest.fixture(scope="module")
def history():
    rng = random.Random(9)
    rows, minute = [], 0.0
    for i in range(600):
        minute += rng.choice([0.2, 0.4, 1, 3, 20])
        rows.append((rng.randrange(6), i, moment(minute), rng.choice(["submit", "submit", "start", "start", "fail", "done"])))
    return rows


def test_queue_over_restarts(spark, tmp_path, history):
    """Five files, read in three runs, the last batch of a run run again: the transitions of one fold, each once."""
    cuts = [history[i * 120 : (i + 1) * 120] for i in range(5)]
    path = f"file://{tmp_path}/out"
    for run, names in enumerate(([0, 1], [2], [3, 4])):
        for n in names:
            add(spark, tmp_path / "in", f"f{n}", cuts[n])
        out = streaming.drain(S.job_transitions(stream(spark, tmp_path / "in")), "append", path=path, typed_state=True)
        assert told(out) == fold([r for c in cuts[: names[-1] + 1] for r in c], cuts[names[-1]][-1][2] - dt.timedelta(hours=1)), run
        commits = sorted((int(f) for f in os.listdir(f"{tmp_path}/out/progress/commits") if f.isdigit()), reverse=True)
        os.remove(f"{tmp_path}/out/progress/commits/{commits[0]}")  # as if the driver had died before the commit
        crc = f"{tmp_path}/out/progress/commits/.{commits[0]}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    again = streaming.drain(S.job_transitions(stream(spark, tmp_path / "in")), "append", path=path, typed_state=True)
    assert told(again) == fold(history, history[-1][2] - dt.timedelta(hours=1))


def test_queue_state_ends(spark, tmp_path):
    """A completed job, one that has failed for good, and one that was left alone: none of them has state in the end; a queued one has."""
    rows = [(1, 1, moment(0), "submit"), (1, 2, moment(1), "start"), (1, 3, moment(2), "done"), (2, 4, moment(3), "submit"), (2, 5, moment(4), "start"), (3, 6, moment(5), "submit"), (4, 7, moment(500), "submit"), (4, 8, moment(900), "submit")]
    add(spark, tmp_path / "in", "f", rows)
    path = f"file://{tmp_path}/out"
    out = streaming.drain(S.job_transitions(stream(spark, tmp_path / "in")), "append", path=path, typed_state=True)
    got = [(r[0], r[2], r[3]) for r in sorted(told(out), key=lambda r: (r[0], r[1]))]
    assert got == [(1, "created", 0), (1, "active", 0), (1, "completed", 0), (2, "created", 0), (2, "active", 0), (2, "expired", 0), (2, "retry", 1), (2, "created", 1), (3, "created", 0), (4, "created", 0)]
    with streaming.state_store(spark, streaming.ROCKS):
        left = spark.read.format("statestore").option("stateVarName", "job").load(f"{path}/progress")
        assert sorted(r["key"]["job"] for r in left.select("key").collect()) == [2, 3, 4]


def test_tail_over_restarts(spark, tmp_path):
    """State up to a position, then the tail: nothing is lost or told twice, whatever is sent again; a key is closed by its terminal event."""
    schema = "k long, n long, at timestamp, kind string"
    rows = [(k, i, moment(i), "end" if (k, i) in ((0, 24), (1, 5), (2, 38)) else "go") for i in range(60) for k in [i % 4]]
    known = spark.createDataFrame([(0, 8, False), (1, 5, True), (2, 10, False)], "k long, position long, ended boolean")
    path = f"file://{tmp_path}/out"

    def run():
        tail = S.live_tail(stream(spark, tmp_path / "in", schema), known, "k", "n", "at", F.col("kind") == "end")
        return sorted((r.k, r.n) for r in streaming.drain(tail, "append", path=path, typed_state=True).collect())

    want = [(k, i) for k, i, _, _ in rows if (k == 0 and 8 < i <= 24) or (k == 2 and 10 < i) or k == 3]
    want = sorted(x for x in want if x[0] != 2 or x[1] <= 38)
    add(spark, tmp_path / "in", "a", rows[:20], schema)
    assert run() == [x for x in want if x[1] < 20]
    add(spark, tmp_path / "in", "b", rows[15:40], schema)  # five of them again
    add(spark, tmp_path / "in", "c", rows[38:], schema)
    assert run() == want
    assert run() == want


def test_tail_of_rows(spark, tmp_path):
    """Events with columns of the names that the operator uses, without a position, and told twice in one batch; a state of several rows a key and one without a position. Keys go in as rows, not as frames."""
    schema = "k long, n long, at timestamp, kind string, position long, ended string"
    rows = [(k, None if i == 7 else i, moment(i), "end" if (k, i) == (1, 6) else "go", i * 10, "x") for i in [3, 1, 2, 2, 7, 5, 6, 4, 8] for k in (1, 2, 3)]
    known = spark.createDataFrame([(1, 2, False), (1, 3, False), (2, None, False), (3, 1, False), (3, 0, True)], "k long, position long, ended boolean")
    add(spark, tmp_path / "in", "a", rows, schema)
    tail = S.live_tail(stream(spark, tmp_path / "in", schema), known, "k", "n", "at", F.col("kind") == "end")
    got = sorted((r.k, r.n, r.position, r.ended) for r in streaming.drain(tail, "append", typed_state=True).collect())
    assert got == [(k, i, i * 10, "x") for k, i in [(1, 4), (1, 5), (1, 6), *((2, i) for i in (1, 2, 3, 4, 5, 6, 8))]]
    assert "transformWithState" in S.live_tail.__code__.co_names


def test_merged_table(spark, tmp_path):
    """The newest event of a key wins however late others come; a batch that is run again changes nothing; two versions are kept."""
    schema = "k long, n long, at timestamp, kind string"
    first = {"last": F.max(F.struct("at", "n", "kind")), "n": F.count("*")}
    path = f"file://{tmp_path}/out"

    def run():
        out = streaming.merge_table(stream(spark, tmp_path / "in", schema), ["k"], first, {"last": "max", "n": "sum"}, path)
        return sorted((r.k, r["last"]["kind"], r.n) for r in out.collect())

    add(spark, tmp_path / "in", "a", [(1, 1, moment(10), "x"), (1, 2, moment(20), "y"), (2, 3, moment(5), "z")], schema)
    assert run() == [(1, "y", 2), (2, "z", 1)]
    add(spark, tmp_path / "in", "b", [(1, 4, moment(15), "late"), (2, 5, moment(50), "w")], schema)
    add(spark, tmp_path / "in", "c", [(3, 6, moment(0), "v")], schema)
    want = [(1, "y", 3), (2, "w", 2), (3, "v", 1)]
    assert run() == want
    last = max(int(f) for f in os.listdir(f"{tmp_path}/out/progress/commits") if f.isdigit())
    os.remove(f"{tmp_path}/out/progress/commits/{last}")
    if os.path.exists(crc := f"{tmp_path}/out/progress/commits/.{last}.crc"):
        os.remove(crc)
    assert run() == want
    assert len([f for f in os.listdir(f"{tmp_path}/out") if f.startswith("version=")]) == 2


def test_windows_and_late_events(spark, tmp_path):
    """Windows in append mode are told once, when they have ended; an event behind the watermark is in none; the state of ended ones is gone."""
    schema = "k long, n long, at timestamp, kind string"
    path = f"file://{tmp_path}/out"

    def run():
        out = streaming.tumbling(stream(spark, tmp_path / "in", schema), "at", "1 hour", late="30 minutes").agg(F.count("*").alias("c"))
        return sorted((int((r.w.start.replace(tzinfo=r.w.start.tzinfo or dt.timezone.utc).astimezone(dt.timezone.utc) - START).total_seconds() // 3600), r.c) for r in streaming.drain(out, "append", path=path).collect())

    add(spark, tmp_path / "in", "a", [(1, i, moment(10 * i), "x") for i in range(18)], schema)  # three hours
    assert run() == [(0, 6), (1, 6)]  # the third ends half an hour after the watermark
    add(spark, tmp_path / "in", "b", [(1, 90, moment(30), "late"), (1, 91, moment(170), "in time"), (1, 92, moment(400), "x")], schema)
    assert run() == [(0, 6), (1, 6), (2, 7)]
    state = spark.read.format("statestore").load(f"{path}/progress")
    assert state.count() == 1  # the window that is open


def test_nothing(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    assert streaming.drain(S.job_transitions(stream(spark, tmp_path / "in")), "append", typed_state=True).count() == 0
    assert streaming.merge_table(stream(spark, tmp_path / "in"), ["job"], {"n": F.count("*")}, {"n": "sum"}).count() == 0
