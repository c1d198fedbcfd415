"""Keyed states of streams: jobs, reading sessions, and requests that wait for their answers.

All of them are driven by event time: what they keep has a timer and goes when the watermark has passed it, so a state store holds what is
alive and not all that ever was. Times are microseconds since 1970, timers milliseconds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_first = itemgetter(0)
TERMINAL = ("done", "error", "cancelled")


def timer_at(micros: int) -> int:
    """The first whole millisecond that is not before a time."""
    return -(-micros // 1000)


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> list:
    parts = [p for p in rows if len(p)]
    return list(pd.concat(parts).sort_values(by, kind="stable").itertuples(index=False)) if parts else []


def _text(x):
    return None if x is None or x != x else x


class Sharded(StatefulProcessor):
    """A state of many keys, dealt by a hash to shards, whose rows of a batch are applied in memory.

    Calls of state cost more than the events, so a shard's keys are one row of state, an array for each field, read and written once a batch, with one timer at
    the first deadline. A subclass applies the events to its keys and tells the time at which a key goes; a key without such a time stays.
    """

    FIELDS: dict[str, str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{name} array<{kind}>" for name, kind in {"id": "string", **self.FIELDS}.items())
        self.state = handle.getValueState("state", f"timer long, {arrays}")

    def apply(self, kept: dict, events: list) -> Iterator[tuple]:
        """Brings kept (id: list of fields) up to date, and gives the rows to put out."""
        raise NotImplementedError

    def deadline(self, fields: list) -> int | None:
        """The time, in milliseconds, at which a key goes."""
        raise NotImplementedError

    def _read(self) -> tuple[int, dict]:
        if not self.state.exists():
            return 0, {}
        timer, ids, *fields = self.state.get()
        return timer, dict(zip(ids, map(list, zip(*fields))))

    def _write(self, timer: int, kept: dict, fired: bool = False) -> None:
        first = min((at for f in kept.values() if (at := self.deadline(f)) is not None), default=0)
        if timer and not fired and timer != first:
            self.handle.deleteTimer(timer)
        if first and (fired or timer != first):
            self.handle.registerTimer(first)
        if kept:
            self.state.update((first, list(kept), *map(list, zip(*kept.values()))))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = _ordered(rows, ["us", "seq"])
        timer, kept = self._read()
        out = list(self.apply(kept, events))
        if out:
            self._write(timer, kept)
            yield pd.DataFrame({name: pd.Series(values, dtype=self.TYPES.get(name, "object")) for name, values in zip(self.NAMES, zip(*out))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        timer, kept = self._read()
        if timer == at:  # and not an older one
            due = lambda f: (t := self.deadline(f)) is not None and (t <= at or t < passed)
            self._write(timer, {id_: f for id_, f in kept.items() if not due(f)}, fired=True)
        yield from ()

    def close(self) -> None:
        pass


class JobStates(Sharded):
    """The last states of a shard's jobs. Events are applied by time and sequence; a finished job stays as it is, and only a pending or generating one can be cancelled.

    A finished job is kept for ``keep`` microseconds after its last event, so that late events find it finished; then its state goes, and an
    event that makes the same id pending begins a new job. Jobs that have not finished stay.
    """

    NAMES = ["job_id", "status", "error", "started_us", "completed_us"]
    TYPES = {"started_us": "Int64", "completed_us": "Int64"}
    FIELDS = {"status": "string", "error": "string", "started_us": "long", "completed_us": "long"}

    def __init__(self, keep: int):
        self.keep = keep

    def apply(self, kept: dict, events: list) -> Iterator[tuple]:
        changed = {}
        for e in events:
            job = kept.get(e.job_id)
            if job is None:
                if e.event != "pending":
                    continue  # for a job that is not known
                job = kept[e.job_id] = ["pending", None, None, None]
            elif job[0] in TERMINAL or e.event == "pending":
                continue  # late, or pending already
            else:
                job[0] = e.event
            if e.event == "generating":
                job[2] = int(e.us)
            elif e.event in TERMINAL:
                job[3], job[1] = int(e.us), _text(e.message) if e.event == "error" else None
            changed[e.job_id] = job
        return ((id_, *job) for id_, job in changed.items())

    def deadline(self, fields: list) -> int | None:
        return timer_at(fields[3] + self.keep) if fields[0] in TERMINAL else None


class Runs:
    """A set of whole numbers as runs without a gap, each kept under its first and its last number: adding one touches two runs at most."""

    def __init__(self, handle):
        self.ends = handle.getMapState("ends", "first int", "last int")
        self.begins = handle.getMapState("begins", "last int", "first int")
        self.firsts = sorted(first for (first,), _ in self.ends.iterator())

    def add(self, n: int) -> None:
        if self.holds(n):
            return
        first = self.begins.getValue((n - 1,))[0] if self.begins.containsKey((n - 1,)) else n
        last = self.ends.getValue((n + 1,))[0] if self.ends.containsKey((n + 1,)) else n
        if first < n:
            self.begins.removeKey((n - 1,))
        else:
            insort(self.firsts, n)
        if last > n:
            self.ends.removeKey((n + 1,))
            del self.firsts[bisect_left(self.firsts, n + 1)]
        self.ends.updateValue((first,), (last,))
        self.begins.updateValue((last,), (first,))

    def holds(self, n: int) -> bool:
        before = bisect_right(self.firsts, n)
        return before > 0 and self.ends.getValue((self.firsts[before - 1],))[0] >= n

    def end(self, n: int) -> int:
        """The last number of the run that begins with n; n - 1 without one."""
        return self.ends.getValue((n,))[0] if self.ends.containsKey((n,)) else n - 1


class _Map(dict):
    """A map in memory with the calls of a map of state."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(self.items())


class _Runs(Runs):
    """Runs in memory, from their first and last numbers in a row."""

    def __init__(self, flat: list[int]):
        pairs = list(zip(flat[::2], flat[1::2]))
        maps = {"ends": _Map(((a,), (b,)) for a, b in pairs), "begins": _Map(((b,), (a,)) for a, b in pairs)}
        self.getMapState = lambda name, *_: maps[name]
        super().__init__(self)

    def flat(self) -> list[int]:
        return [n for first in self.firsts for n in (first, self.ends[(first,)][0])]


BLOCKED, PLAYER = "Browser blocked autoplay. Click play to continue.", "Audio player error"


class SessionStates(Sharded):
    """A shard's reading sessions, each of them idle, playing, paused or finished, its current chunk, how far it is buffered, and the last error's text.

    Events: start (n chunks), pause, resume, gesture (a click, which resumes a blocked session only), stop, chunk_ready (n), chunk_ended,
    blocked (no gesture yet), failed (playing failed, with a message), player_error. A session pauses from every state, resumes from all but
    finished, and is paused by a failure, whose text stays. Chunks may become ready in any order, before the start or after a stop too; the
    buffered index is the end of the unbroken run from 0. It is set back by start and stop, and followed while the session is
    subscribed, which is from start to stop. Ready chunks are kept as runs, so the state grows with the gaps and not with the chunks.

    A session's state goes ``keep`` microseconds after its last event.
    """

    NAMES = ["session_id", "status", "current_index", "buffered_index", "total_chunks", "needs_gesture", "error"]

    TYPES = {}
    FIELDS = {
        "status": "string",
        "current": "int",
        "buffered": "int",
        "total": "int",
        "needs_gesture": "boolean",
        "error": "string",
        "subscribed": "boolean",
        "last_us": "long",
        "ready": "array<int>",
    }

    def __init__(self, keep: int):
        self.keep = keep

    def apply(self, kept: dict, events: list) -> Iterator[tuple]:
        each: dict = {}
        for e in events:
            each.setdefault(e.session_id, []).append(e)
        for id_, its in each.items():
            kept[id_] = self._session(kept.get(id_) or ["idle", 0, -1, 0, False, None, False, 0, []], its)
            yield id_, *kept[id_][:6]

    def _session(self, known: list, events: list) -> list:
        status, current, buffered, total, gesture, error, subscribed, last, flat = known
        ready = _Runs(flat)
        for e in events:
            n = 0 if e.n is None or e.n != e.n else int(e.n)
            kind = e.event
            if kind == "start":
                total = n
                if total <= 0:
                    status = "finished"
                else:
                    status, current, buffered, subscribed = "playing", 0, -1, True
            elif kind == "pause":
                status = "paused"
            elif kind == "resume" and status != "finished" or kind == "gesture" and gesture and status != "finished":
                status, gesture = "playing", False
            elif kind == "stop":
                status, current, buffered, subscribed = "idle", 0, -1, False
            elif kind == "chunk_ready":
                ready.add(n)
                if subscribed:
                    buffered = min(ready.end(0), total - 1)
            elif kind == "chunk_ended":
                current += 1
            elif kind in ("blocked", "failed", "player_error"):
                status = "paused"
                gesture = kind == "blocked" if kind != "player_error" else gesture
                error = BLOCKED if kind == "blocked" else PLAYER if kind == "player_error" else f"Playback failed: {_text(e.message) or ''}"
            if status == "playing" and total > 0 and current >= total:
                status = "finished"
        last = max(last, *(int(e.us) for e in events)) if last else max(int(e.us) for e in events)
        return [status, current, buffered, total, gesture, error, subscribed, last, ready.flat()]

    def deadline(self, fields: list) -> int | None:
        return timer_at(fields[7] + self.keep)


REQUEST, RESPONSE, FAILURE = 0, 1, 2


class PendingRequests(StatefulProcessor):
    """Requests of one worker's shard that wait for their answers.

    A final answer within the timeout ends its request, an error answer or a failure of the worker rejects it, and a timer rejects what is
    left at the deadline. An answer that comes in before its request is kept for the timeout; one for no request is dropped then.

    A key's rows of a batch are applied in memory: its state is one row of what waits, read and written once a batch, with one timer at the first deadline.
    """

    NAMES = ["worker", "id", "requested_us", "outcome", "message"]

    def __init__(self, timeout: int, id_type: str):
        self.timeout, self.id_type = timeout, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ids = f"array<{self.id_type}>"
        self.state = handle.getValueState(
            "waiting", f"timer long, ids {ids}, us array<long>, early_ids {ids}, early_us array<long>, types array<string>, messages array<string>"
        )

    def _read(self) -> tuple[int, dict, dict]:
        """The timer that is set, pending requests (id: time) and early answers (id: time, type, message)."""
        if not self.state.exists():
            return 0, {}, {}
        timer, ids, us, early_ids, *early = self.state.get()
        return timer, dict(zip(ids, us)), dict(zip(early_ids, zip(*early)))

    def _write(self, timer: int, pending: dict, early: dict, fired: bool = False) -> None:
        waits = [*pending.values(), *(e[0] for e in early.values())]
        first = timer_at(min(waits) + self.timeout) if waits else 0
        if timer and not fired and timer != first:
            self.handle.deleteTimer(timer)
        if first and (fired or timer != first):
            self.handle.registerTimer(first)
        if waits:
            us, types, messages = ([e[k] for e in early.values()] for k in range(3))
            self.state.update((first, list(pending), list(pending.values()), list(early), us, types, messages))
        elif timer:
            self.state.clear()

    def _answer(self, id_, requested: int, us: int, kind: str, message) -> tuple | None:
        if not requested <= us <= requested + self.timeout:
            return None
        return id_, requested, "rejected" if kind == "error" else "resolved", _text(message)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, pending, early = self._read()
        # Times of pending requests in order, so that a failure finds those it rejects; one that has been answered goes when it is met.
        times = sorted((us, id_) for id_, us in pending.items())
        out = []
        for e in _ordered(rows, ["us", "kind"]):
            id_, us, done = e.id if isinstance(e.id, str) else int(e.id), int(e.us), None
            if e.kind == REQUEST:
                if id_ in early:
                    done = self._answer(id_, us, *early.pop(id_))
                if done is None and id_ not in pending:
                    pending[id_] = us
                    insort(times, (us, id_))
            elif e.kind == RESPONSE:
                if id_ in pending:
                    done = self._answer(id_, pending[id_], us, e.type, e.message)
                    if done:
                        del pending[id_]
                elif id_ not in early:
                    early[id_] = us, e.type, _text(e.message)
            else:
                low, high = bisect_left(times, us - self.timeout, key=_first), bisect_right(times, us, key=_first)
                for requested, i in times[low:high]:
                    if pending.get(i) == requested:
                        del pending[i]
                        out.append((i, requested, "rejected", _text(e.message)))
                del times[low:high]
            if done:
                out.append(done)
        self._write(timer, pending, early)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        timer, pending, early = self._read()
        if timer != at:
            return  # an older one
        due = lambda us: (t := timer_at(us + self.timeout)) <= at or t < passed
        out = [(key[0], id_, us, "rejected", "timed out") for id_, us in pending.items() if due(us)]
        left = {id_: us for id_, us in pending.items() if not due(us)}
        self._write(timer, left, {id_: e for id_, e in early.items() if not due(e[0])}, fired=True)
        if out:
            yield pd.DataFrame(out, columns=self.NAMES)

    def close(self) -> None:
        pass
