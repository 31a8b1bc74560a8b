"""Sessions that the clock ends: what is open expires when its time is up, not when the next event happens to come.

The machine of sessions.py with deadlines: a problem that nothing solved is given up after Policy.open_for, entries that were
found and never reported on after Policy.found_for, and a silent session is forgotten after `idle`. Over a stream these are
event-time timers of transformWithState, one a session, and the state is one typed row a session; over a batch the same
deadlines come between the events. Both say the same, wherever micro-batches are cut, as long as no event is later than
the watermark allows: such events are dropped before the machine sees them, and what they would have changed has been
said already.

Drafts show the other kind of clock: their state has a native time to live in processing time, and is gone when that is up.

transformWithState keeps its state in RocksDB; the session's provider is set where it is another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .limits import DRAFT_LIFE
from .sessions import SAID, Machine, Policy, Session, _frame, _told, classified

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ["at", "kind", "key", "line", "outcome"]
_SAY = Row(*(x.split()[0] for x in SAID.split(", ")))

#: A session's state, in the order of Session's fields, and when it is forgotten.
STATE = (
    "problem struct<since:long,line:string>, failed struct<since:long,key:string,solved:boolean>, missed struct<since:long,told:boolean>, "
    "found struct<since:long,ids:array<string>,told:boolean,asked:boolean,solved_at:long>, shown struct<since:long,ids:array<string>,used:boolean,reported:boolean,asked:boolean>, "
    "last long, said int, solved int, shared int, asks int, asked_at long, seen array<string>, producers array<string>, known array<string>, forget long"
)


def with_rocksdb(spark: SparkSession) -> None:
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


class Clocked(Machine):
    """The machine, with what the clock says."""

    def deadlines(self, s: Session) -> list[int]:
        found = [s.problem[0] + self.policy.open_for] if s.problem else []
        return [*found, s.found[0] + self.policy.found_for + 1] if s.found else found

    def expire(self, s: Session, now: float) -> Iterator[tuple]:
        """(at, say, line, ids, since) of all that was over by now, in order of time; it is no part of the session any more."""
        out = []
        if s.problem and now >= s.problem[0] + self.policy.open_for:
            out.append((s.problem[0] + self.policy.open_for, "problem_expired", s.problem[1], [], s.problem[0]))
            s.problem = None
        if s.found and now > s.found[0] + self.policy.found_for:
            out.append((s.found[0] + self.policy.found_for + 1, "unreported", "", list(s.found[1]), None))
            s.found = None
        yield from sorted(out, key=lambda x: x[0])

    def take(self, name: str, s: Session, e) -> Iterator[tuple]:
        """What the clock says up to an event, then what the event says."""
        yield from self.end(name, s, e.at)
        yield from _told(self, name, s, e)

    def end(self, name: str, s: Session, now: float) -> Iterator[tuple]:
        for at, say, line, ids, since in self.expire(s, now):
            yield name, at, say, line, ids, since


def replayed_on_time(events: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """All that is said over whole sessions, expiries included. Sessions are read in time order and never held."""
    machine = Clocked(policy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = None, Session()
        for batch in batches:
            out: list[tuple] = []
            for e in batch.itertuples(index=False):
                if e.session != current:
                    out.extend(machine.end(current, s, float("inf")))
                    current, s = e.session, Session()
                out.extend(machine.take(current, s, e))
            yield _frame(out)
        yield _frame(list(machine.end(current, s, float("inf"))))

    return classified(events).repartition("session").sortWithinPartitions("session", *_ORDER).mapInPandas(run, SAID)


class SessionClock(StatefulProcessor):
    """One session: its state, and a timer at its next deadline."""

    def __init__(self, policy: Policy, idle: int) -> None:
        self.machine, self.idle = Clocked(policy), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _read(self) -> tuple[Session, int]:
        found = self.state.get()
        if found is None:
            return Session(), 0
        values = [list(x) if isinstance(x, (Row, tuple, list)) else x for x in found]
        return Session(**dict(zip((f.name for f in fields(Session)), values[:-1], strict=True))), values[-1]

    def _keep(self, s: Session, forget: int) -> None:
        values = [getattr(s, f.name) for f in fields(Session)]
        self.state.update((*(tuple(v) if isinstance(v, list) and i < 5 else v for i, v in enumerate(values)), forget))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(min([forget, *self.machine.deadlines(s)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, forget = self._read()
        # Of one session and one micro-batch; its order is time's, as in a batch.
        for e in sorted(rows, key=lambda r: tuple((r[c] is None, r[c]) for c in _ORDER)):
            for said in self.machine.take(key[0], s, e):
                yield _SAY(*said)
            forget = max(forget, e.at + self.idle)
        self._keep(s, forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, forget = self._read()
        now = expiredTimerInfo.getExpiryTimeInMs()
        for said in self.machine.end(key[0], s, now):
            yield _SAY(*said)
        if now >= forget:
            for said in self.machine.end(key[0], s, float("inf")):
                yield _SAY(*said)
            self.state.clear()
        else:
            self._keep(s, forget)

    def close(self) -> None:
        pass


def streamed_on_time(events: DataFrame, policy: Policy = Policy(), idle: str = "12 hours") -> DataFrame:  # noqa: B008
    """The same over a stream with a watermark on `at`."""
    with_rocksdb(events.sparkSession)
    clock = SessionClock(policy, max(int(pd.Timedelta(idle).total_seconds() * 1000), policy.open_for))
    return classified(events).groupBy("session").transformWithState(clock, SAID, "Append", "EventTime")


# --- Drafts with a time to live --------------------------------------------------------------------------------------

ANSWERED = "draft_id string, action string, answer string"


class Drafts(StatefulProcessor):
    """A draft is pending for its life, counted from when it came; approving or discarding it settles it once."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.draft = handle.getValueState("draft", "state string", self.life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for e in sorted(rows, key=lambda r: r["id"]):
            found = self.draft.get()
            if e["action"] == "create":
                answer = "known" if found else "pending"
                if not found:
                    self.draft.update(("pending",))
            elif found and found[0] == "pending":
                answer = "published" if e["action"] == "approve" else "discarded"
                self.draft.update((answer,))
            else:
                answer = "settled" if found else "gone"
            yield Row("draft_id", "action", "answer")(key[0], e["action"], answer)

    def close(self) -> None:
        pass


def streamed_drafts(events: DataFrame, life: int = DRAFT_LIFE) -> DataFrame:
    """draft_id, action, answer of a stream of (id, draft_id, action create, approve or discard): pending, published, discarded,
    known (created again), settled (answered before) or gone (never there, or its life is over)."""
    with_rocksdb(events.sparkSession)
    rows = events.where("draft_id IS NOT NULL AND id IS NOT NULL").select("id", "draft_id", F.coalesce("action", F.lit("")).alias("action"))
    return rows.groupBy("draft_id").transformWithState(Drafts(life), ANSWERED, "Append", "ProcessingTime")
