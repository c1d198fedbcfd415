import datetime as dt
import math

import pytest

from lectern.streaming import flows, state
from lectern.streaming.delivery import DeliveryLog

T0 = dt.datetime(2024, 1, 1)
JOB = "job_id string, ts timestamp, seq int, event string, message string"
SESSION = "session_id string, ts timestamp, seq int, event string, n int, message string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def arriving(spark, path, batches, ddl):
    """Every batch of rows as a file, taken one a micro-batch."""
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def drained(tmp_path, stream, mode="update"):
    """All rows that came out, in order, and the query's progress."""
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option(
        "checkpointLocation",
        str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query.recentProgress


def run(spark, tmp_path, batches, ddl, make, mode="update"):
    return drained(tmp_path, make(arriving(spark, str(tmp_path / "src"), batches, ddl)), mode)[0]


def test_job_states(spark, tmp_path):
    batches = [
        [("a", at(0), 0, "pending", None), ("b", at(0), 2, "done", None), ("c", at(0), 3, "pending", None)],
        [("a", at(1), 1, "generating", None), ("a", at(1), 4, "pending", None), ("c", at(2), 4, "cancelled", None)],
        [("c", at(3), 5, "done", None), ("a", at(9), 6, "error", "boom")],
    ]
    rows = run(spark, tmp_path, batches, JOB, flows.job_state_stream)
    assert [(r.job_id, r.status, r.error) for r in sorted(rows, key=lambda r: (r.job_id, r.completed_at or T0))] == [
        ("a", "pending", None),
        ("a", "generating", None),
        ("a", "error", "boom"),
        ("c", "pending", None),
        ("c", "cancelled", None),
    ]
    last = {r.job_id: (r.started_at, r.completed_at) for r in rows}
    assert last == {"a": (at(1), at(9)), "c": (None, at(2))}


def test_finished_jobs_are_forgotten_after_a_time(spark, tmp_path):
    """A late event finds a job finished while it is kept; then its state goes, and the id may begin anew. A job that has not finished stays."""
    hour = 3600
    batches = [
        [("a", at(0), 0, "pending", None), ("a", at(1), 1, "done", None), ("open", at(2), 2, "pending", None)],
        [("a", at(hour // 2), 3, "pending", None)],
        [("clock", at(3 * hour), 4, "done", None)],
        [("clock", at(4 * hour), 5, "done", None)],
        [("a", at(5 * hour), 6, "pending", None), ("open", at(5 * hour), 7, "done", None)],
    ]
    make = lambda s: flows.job_state_stream(s, keep="1 hour", delay="10 minutes")
    out, progress = drained(tmp_path, make(arriving(spark, str(tmp_path / "src"), batches, JOB)))
    assert sorted((r.job_id, r.status) for r in out) == [("a", "done"), ("a", "pending"), ("open", "done"), ("open", "pending")]
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(rows) > rows[3] > 0  # between: two jobs and a timer, then one job


def sessions(spark, tmp_path, batches, **options):
    rows = run(spark, tmp_path, batches, SESSION, lambda s: flows.session_state_stream(s, **options))
    return rows, {r.session_id: r for r in rows}


def test_session_states(spark, tmp_path):
    batches = [
        [("s", at(0), 0, "start", 2, None), ("s", at(1), 1, "chunk_ready", 1, None), ("t", at(0), 4, "start", 0, None), ("u", at(0), 5, "start", 3, None)],
        [("s", at(2), 2, "chunk_ready", 0, None), ("s", at(3), 3, "chunk_ended", None, None), ("u", at(1), 6, "blocked", None, None)],
        [("s", at(4), 7, "chunk_ended", None, None), ("u", at(5), 8, "gesture", None, None)],
        [("s", at(6), 9, "resume", None, None), ("u", at(6), 10, "failed", None, "no device"), ("t", at(6), 11, "gesture", None, None)],
        [("u", at(7), 12, "resume", None, None)],
    ]
    rows, last = sessions(spark, tmp_path, batches)
    seen = lambda name: [(r.status, r.current_index, r.buffered_index, r.needs_gesture, r.error) for r in rows if r.session_id == name]
    assert seen("s") == [("playing", 0, -1, False, None), ("playing", 1, 1, False, None), ("finished", 2, 1, False, None), ("finished", 2, 1, False, None)]
    assert seen("t") == [("finished", 0, -1, False, None)] * 2
    failed = "Playback failed: no device"
    assert seen("u") == [
        ("playing", 0, -1, False, None),
        ("paused", 0, -1, True, state.BLOCKED),
        ("playing", 0, -1, False, state.BLOCKED),
        ("paused", 0, -1, False, failed),
        ("playing", 0, -1, False, failed),  # the text of the last error stays
    ]
    assert last["u"].total_chunks == 3


def test_sessions_pause_and_stop_from_every_state(spark, tmp_path):
    one = lambda name, *events: [(name, at(k), k, e, n, m) for k, (e, n, m) in enumerate(events)]
    start, pause, resume, stop, ended = (("start", 2, None), ("pause", None, None), ("resume", None, None), ("stop", None, None), ("chunk_ended", None, None))
    ready = lambda n: ("chunk_ready", n, None)
    rows = [
        *one("idle", pause),
        *one("resumed", resume),
        *one("done", start, ended, ended, pause),
        *one("again", start, ended, ended, pause, resume),
        *one("ended while paused", start, pause, ended, ended),
        *one("player", start, ("player_error", None, None)),
        *one("stopped", start, ready(0), stop, ready(1)),
        *one("restarted", ready(0), start, stop, start, ready(1)),
        *one("before", ready(0), ready(1), start),
    ]
    _, last = sessions(spark, tmp_path, [rows])
    got = {k: (r.status, r.current_index, r.buffered_index, r.error) for k, r in last.items()}
    assert got == {
        "idle": ("paused", 0, -1, None),
        "resumed": ("playing", 0, -1, None),
        "done": ("paused", 2, -1, None),
        "again": ("finished", 2, -1, None),
        "ended while paused": ("paused", 2, -1, None),
        "player": ("paused", 0, -1, state.PLAYER),
        "stopped": ("idle", 0, -1, None),
        "restarted": ("playing", 0, 1, None),
        "before": ("playing", 0, -1, None),
    }


def test_ready_chunks_are_runs_and_sessions_expire(spark, tmp_path):
    """A thousand ready chunks are as many state rows as one; after a day without events all rows of the session are gone."""
    n = 1000
    order = sorted(range(n), key=lambda k: (k * 619) % n)  # far from sorted
    batches = [
        [("s", at(0), 0, "start", n, None), *[("s", at(1), 1 + k, "chunk_ready", c, None) for k, c in enumerate(order)]],
        [("tick", at(90_000), 0, "start", 1, None)],
        [("tick", at(200_000), 0, "pause", None, None)],
    ]
    stream = flows.session_state_stream(arriving(spark, str(tmp_path / "src"), batches, SESSION), keep="1 day")
    out, progress = drained(tmp_path, stream)
    assert [r.buffered_index for r in out if r.session_id == "s"] == [n - 1]
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert rows[0] < 12 and rows[-1] <= rows[0]


class Held:
    """A map of state as the handle gives it."""

    def __init__(self):
        self.d = {}

    def getMapState(self, *_):
        return Held()

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d[k]

    def updateValue(self, k, v):
        self.d[k] = v

    def removeKey(self, k):
        del self.d[k]

    def iterator(self):
        return iter(list(self.d.items()))


def test_runs_are_like_a_set():
    import random

    for seed in range(30):
        r = random.Random(seed)
        runs, plain = state.Runs(Held()), set()
        for _ in range(60):
            n = r.randrange(40)
            runs.add(n)
            plain.add(n)
            end = -1
            while end + 1 in plain:
                end += 1
            assert runs.end(0) == end
            gaps = sum(k + 1 not in plain for k in plain)
            assert len(runs.ends.d) == len(runs.begins.d) == gaps
            assert all(runs.holds(k) == (k in plain) for k in range(-1, 41))


def test_fan_out_serves_a_failed_consumer_again(spark, tmp_path):
    stream = arriving(spark, str(tmp_path / "in"), [[(k,)] for k in range(4)], "id long")
    seen, failures, down = {"bad": [], "good": [], "late": []}, [], [True]

    def sink(name):
        def take(batch, number):
            if name == "bad" and down[0]:
                raise RuntimeError("no")
            seen[name] += [(number, r.id) for r in batch.collect()]

        return take

    sinks, log, check = {n: sink(n) for n in ("bad", "good")}, str(tmp_path / "log"), str(tmp_path / "c")
    flows.fan_out(stream, sinks, check, log, failures).awaitTermination()
    assert seen["bad"] == [] and seen["good"] == [(k, k) for k in range(4)]
    assert [(n, b) for n, b, _ in failures] == [("bad", 0)] * 4 and failures[0][2] == "no"
    spark.createDataFrame([(4,)], "id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    sinks["late"] = sink("late")  # subscribes now, and gets batches from now on
    down[0] = False
    flows.fan_out(stream, sinks, check, log, failures).awaitTermination()  # a restart
    assert {n: [i for _, i in rows] for n, rows in seen.items()} == {"bad": [0, 1, 2, 3, 4], "good": [0, 1, 2, 3, 4], "late": [4]}
    assert flows.redeliver(spark, sinks, log) == {"bad": 0, "good": 0, "late": 0}


def test_delivery_log(spark, tmp_path):
    log = DeliveryLog(spark, str(tmp_path / "log"))
    assert log.batches() == [] and log.last("a") is None and log.serve({"a": print}) == {"a": 0}
    log.subscribe("a", -1)
    log.write(spark.range(3), 0)
    log.write(spark.range(2), 0)  # tried again
    log.write(spark.range(5), 1)
    got = []
    assert log.serve({"a": lambda b, n: got.append((n, b.count()))}) == {"a": 0} and got == [(0, 2), (1, 5)]
    log.subscribe("b", 0)
    assert log.prune(["a", "b"]) == [0] and log.batches() == [1]
    log.subscribe("a", 7)  # known: keeps its place
    assert log.last("a") == 1
    log.unsubscribe("b")
    assert log.last("b") is None and log.prune(["a", "b"]) == [1]


MESSAGE = "worker string, id long, at timestamp, kind string, type string, message string"


def correlated(spark, tmp_path, batches, **options):
    log = arriving(spark, str(tmp_path / "src"), batches, MESSAGE)
    requests = log.filter("kind = 'request'").select("worker", "id", log["at"].alias("requested_at"))
    responses = log.filter("kind = 'response'").select("worker", "id", log["at"].alias("responded_at"), "type", "message")
    failures = log.filter("kind = 'failure'").select("worker", log["at"].alias("failed_at"), "message")
    rows, progress = drained(tmp_path, flows.correlate_stream(requests, responses, failures, **options), "append")
    assert len({(r.worker, r.id) for r in rows}) == len(rows)
    return {(r.worker, r.id): (r.outcome, r.message) for r in rows}, progress


def test_requests_end_in_one_way(spark, tmp_path):
    ask = lambda w, i, s: (w, i, at(s), "request", None, None)
    say = lambda w, i, s, t, m: (w, i, at(s), "response", t, m)
    batches = [
        [ask("w", 1, 0), ask("w", 2, 0), ask("w", 3, 0), ask("v", 1, 0), ask("w", 4, 0), say("w", 1, 1, "progress", None), say("w", 9, 1, "result", "of none")],
        [say("w", 1, 60, "result", "ok"), say("w", 3, 70, "error", "no"), say("w", 5, 80, "result", "early")],
        [ask("w", 5, 75), ask("w", 6, 90), ("w", None, at(100), "failure", None, "crashed"), ask("w", 7, 110)],
        [say("w", 6, 120, "result", "after the crash"), say("v", 1, 700, "result", "too late"), ask("w", 8, 5000)],
        [ask("w", 10, 9000)],
    ]
    got, progress = correlated(spark, tmp_path, batches, timeout="10 minutes", delay="1 minute")
    assert got == {
        ("w", 1): ("resolved", "ok"),
        ("w", 2): ("rejected", "crashed"),
        ("w", 3): ("rejected", "no"),
        ("w", 4): ("rejected", "crashed"),
        ("v", 1): ("rejected", "timed out"),
        ("w", 5): ("resolved", "early"),  # its answer came in before it
        ("w", 6): ("rejected", "crashed"),
        ("w", 7): ("rejected", "timed out"),
        ("w", 8): ("rejected", "timed out"),
    }
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert rows[-1] < max(rows)  # answers for no request and what has ended are gone


def test_requests_without_workers_time_out(spark, tmp_path):
    requests = arriving(spark, str(tmp_path / "a"), [[(2**60 + 1, at(0))], [(5, at(4000))], [(6, at(9000))]], "id long, requested_at timestamp")
    responses = arriving(spark, str(tmp_path / "b"), [[(7, at(0), "result", None)]], "id long, responded_at timestamp, type string, message string")
    rows, _ = drained(tmp_path, flows.correlate_stream(requests, responses), "append")
    assert sorted((r.worker, r.id, r.requested_at, r.outcome, r.message) for r in rows) == [
        ("", 5, at(4000), "rejected", "timed out"),
        ("", 2**60 + 1, at(0), "rejected", "timed out"),
    ]


def test_highlight_stream(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, [0.0, 1.0, 2.0]), (2, 0, None)], "doc_id int, chunk_index int, word_timings array<double>")
    sentences = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 0, 2), (2, 0, 4, 3), (2, 0, 5, 0), (2, 0, 6, 1)], "doc_id int, chunk_index int, global_index int, n_words int")
    nan = math.nan
    rows = [[(1, 0, 0.5, 3.0), (1, 0, 2.5, 3.0), (1, 0, 1.0, 0.0), (1, 5, 1.0, 3.0)], [(2, 0, 2.9, 4.0), (2, 0, 3.0, 4.0), (2, 0, nan, 4.0), (2, 0, 1.0, nan)]]
    got = run(spark, tmp_path, rows, "doc_id int, chunk_index int, time double, duration double", lambda s: flows.highlight_stream(s, chunks, sentences), "append")
    assert sorted((r.doc_id, str(r.time), r.sentence_index, r.word_index) for r in got) == [
        (1, "0.5", 0, 0),
        (1, "2.5", 1, 0),
        (2, "2.9", 4, 2),
        (2, "3.0", 6, 0),
        (2, "nan", 4, 0)
    ]


@pytest.mark.parametrize("text,micros", [("10 minutes", 600_000_000), ("1 day", 86_400_000_000), ("90 seconds", 90_000_000)])
def test_intervals(text, micros):
    assert flows._micros(text) == micros
    assert state.timer_at(1) == 1 and state.timer_at(1000) == 1 and state.timer_at(1001) == 2


def test_waiting_requests_are_one_row_of_state_for_each_shard(spark, tmp_path):
    """Many requests, of which every third is answered, a failure amid them, and then all of the others at their deadline; their number does not make the calls of state."""
    ask = [("w", k, at(k), "request", None, None) for k in range(600)]
    say = [("w", k, at(k + 1), "response", "result", f"m{k}") for k in range(0, 600, 3)]
    got, progress = correlated(spark, tmp_path, [[*ask, *say, ("w", None, at(299), "failure", None, "crashed")], [("w", 9999, at(9000), "request", None, None)]])
    assert got == {("w", k): ("resolved", f"m{k}") if k % 3 == 0 else ("rejected", "crashed" if k < 300 else "timed out") for k in range(600)}
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(rows) <= 16 * 3


@pytest.mark.parametrize("shards", [1, 3])
def test_jobs_and_sessions_share_rows_of_state(spark, tmp_path, shards):
    """Many jobs, and many sessions, are a few rows of state; each of them ends, stays and goes on its own."""
    hour = 3600
    jobs = [
        [("j%03d" % k, at(k), k, "pending", None) for k in range(200)],
        [("j%03d" % k, at(200 + k), 200 + k, "done" if k % 2 else "generating", None) for k in range(200)],
        [("clock", at(5 * hour), 900, "pending", None)],
        [("clock", at(6 * hour), 901, "generating", None)],
        [("j%03d" % k, at(6 * hour), 1000 + k, "pending", None) for k in range(200)],
    ]
    make = lambda s: flows.job_state_stream(s, keep="1 hour", shards=shards)
    out, progress = drained(tmp_path, make(arriving(spark, str(tmp_path / "src"), jobs, JOB)))
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(rows) <= 3 * shards
    seen = {}
    for r in out:
        seen.setdefault(r.job_id, []).append(r.status)
    assert seen == {"clock": ["pending", "generating"], **{"j%03d" % k: ["pending", "done", "pending"] if k % 2 else ["pending", "generating"] for k in range(200)}}

    names = ["s%02d" % k for k in range(60)]
    batches = [
        [*[(s, at(0), 0, "start", 9, None) for s in names], *[(s, at(1 + c), 1 + c, "chunk_ready", c, None) for s in names for c in (0, 1, 3, 5)]],
        [(s, at(9), 9, "chunk_ready", 2 if k % 2 else 4, None) for k, s in enumerate(names)],
        [("tick", at(3 * hour), 10, "pause", None, None)],
        [("tick", at(4 * hour), 11, "pause", None, None)],
        [(s, at(4 * hour), 12, "chunk_ready", 1, None) for s in names],
    ]
    (tmp_path / "two").mkdir()
    stream = flows.session_state_stream(arriving(spark, str(tmp_path / "two" / "src"), batches, SESSION), keep="1 hour", shards=shards)
    out, progress = drained(tmp_path / "two", stream)
    assert max(p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators) <= 3 * shards
    buffered = {s: [(r.status, r.buffered_index) for r in out if r.session_id == s] for s in names}
    assert buffered == {s: [("playing", 1), ("playing", 3 if k % 2 else 1), ("idle", -1)] for k, s in enumerate(names)}
