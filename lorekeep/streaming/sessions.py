"""Sessions of agents as a keyed stream: what a session's events call for, and what solving a problem took.

Events are classified by column expressions (error lines, signatures, commands), so that the state machine, the only part in
Python, sees small rows: when, what kind, and a few short values. The same machine serves a stream
(applyInPandasWithState, a state a session) and a batch (sessions sorted within partitions and read as they come).

Raw events: session string, at timestamp, event string (failure, success, prompt, stop; null where unknown), tool string,
command, response, error string, exit_code int, interrupted boolean, outcome, entry_id string. All but session and at may be
null. Events of equal time are taken in the order of their other columns. Rows without session or time are dropped.

What comes out, a row for each thing to say or to record: session, at, say (failed, hidden_error, stage_failed, silent_stage,
publish, report, ask_report, ask_share, ask_shown, known, unaided, aided), line, ids, since (of effort: when the problem began).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import error_keys, lines, shell

# Fixed values of the contract: names of tools, what a search replies, exit codes in an error, and how much of a tail counts.
SHELLS = ("Bash", "PowerShell")
SEARCH, REPORT, PUBLISH, BRIEF = (rf"(?:^|_){name}$" for name in ("search", "report", "publish", "brief"))
NO_MATCH = r"(?m)^No \S+ in the \S+ colony matches"
MATCHES = r"<[a-z]+_trails\b"
EXIT_CODE = r"^Exit code (\d+)\r?\n?"
TAIL_LINES = 25
ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HELPED = ("worked", "partially_worked")

MINUTE = 60_000


@dataclass(frozen=True)
class Policy:
    """What a session may be told. Times are milliseconds."""

    private: bool = False
    failures_only: bool = False
    apart: int = 20_000
    most: int = 30
    open_for: int = 45 * MINUTE
    found_for: int = 12 * 60 * MINUTE
    asks: int = 3
    asks_apart: int = 30 * MINUTE
    seen: int = 40
    producers: int = 20
    ids: int = 5
    shown: int = 50


SAID = "session string, at long, say string, line string, ids array<string>, since long"


def _apart(rows: DataFrame, **columns: Column) -> DataFrame:
    """More columns, by a generator of one row each: what stands after it names them and does not repeat their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _failure_line(output: Column) -> Column:
    return lines.once(lines.last_error_line(output, loose=True), lambda loose: F.when(loose != "", loose).otherwise(lines.tool_message(lines.last_line(output))))


def _lost_stage(tail: Column) -> Column:
    """What an earlier stage of a pipeline said when it could not run; else empty."""
    piped = F.contains(F.coalesce("command", F.lit("")), F.lit("|"))

    def told(stage: Column) -> Column:
        looked = ~stage.rlike(r"not found\s*$") & stage.rlike(shell.LOOKING)
        return F.when((stage != "") & ~looked, F.coalesce(F.nullif(lines.last_line(stage), F.lit("")), F.substring(stage, 1, lines.LINE_CHARS))).otherwise("")

    return F.when(piped, lines.once(error_keys.strip(F.regexp_extract(tail, f"({lines.SHELL_FAILURE})", 1)), told)).otherwise("")


def classified(events: DataFrame) -> DataFrame:
    """The rows that the machine reads. A kind is: miss, hit (of a search), brief, report, publish, shown, fail, works, stop."""
    text = F.coalesce("response", F.lit(""))
    said = F.regexp_extract(F.coalesce("error", F.lit("")), EXIT_CODE, 1)
    code = F.coalesce("exit_code", F.when(said != "", said).cast("int"))
    # Arrow functions take columns, so the command is studied first, once.
    rows = events.where("session IS NOT NULL AND at IS NOT NULL").withColumn("code", code)
    shelled = F.col("tool").isin(*SHELLS)
    rows = rows.withColumn("does", F.when(shelled, shell.studied(F.when(shelled, F.coalesce("command", F.lit(""))), F.col("code"))))
    failed = (F.col("event") == "failure") | (F.col("event").isNull() & F.coalesce(F.col("code") != 0, F.lit(False)))
    fails = F.col("does").isNotNull() & failed
    works = F.col("does").isNotNull() & ~failed & F.col("event").isNotNull() & ~F.col("does.probe")
    output = F.regexp_replace(F.coalesce("error", F.lit("")), EXIT_CODE, "")
    tail = F.array_join(F.slice(F.reverse(F.split(text, r"\r?\n")), 1, TAIL_LINES), "\u0000")
    tail = F.array_join(F.reverse(F.split(tail, "\u0000")), "\n")
    # Lines are looked for once, and only where they may be asked for.
    rows = _apart(
        rows, failure_line=F.when(fails, lines.once(output, _failure_line)),
        ends=F.when(works, lines.once(tail, lambda x: F.struct(lines.last_error_line(x).alias("line"), _lost_stage(x).alias("stage")))),
    )
    failure_line, ended, stage = F.col("failure_line"), F.col("ends.line"), F.col("ends.stage")
    excused = F.coalesce("interrupted", F.lit(False)) | F.coalesce(F.col("code").isin(*shell.STOPPED), F.lit(False)) | F.col("does.probe") | F.col("does.answers")
    excused = excused | (F.coalesce(F.col("code") == 1, F.lit(False)) & F.col("does.condition")) | failure_line.rlike(lines.USAGE_LINE)
    tool = F.coalesce("tool", F.lit(""))
    kind = (
        F.when(F.col("event") == "stop", "stop")
        .when(F.col("event") == "prompt", "shown")
        .when(tool.rlike(SEARCH) & text.rlike(NO_MATCH), "miss")
        .when(tool.rlike(SEARCH) & text.rlike(MATCHES), "hit")
        .when(tool.rlike(BRIEF), "brief")
        .when(tool.rlike(REPORT), "report")
        .when(tool.rlike(PUBLISH), "publish")
        .when(fails & ~excused, "fail")
        .when(works, "works")
    )
    rows, kind = _apart(rows, kind=kind).where("kind IS NOT NULL"), F.col("kind")
    line = F.when(kind == "fail", failure_line).when(kind == "works", F.when(ended != "", ended).otherwise(stage)).when(kind == "miss", F.substring("error", 1, lines.LINE_CHARS))
    told = F.when(kind == "works", F.when(ended != "", "hidden_error").when(stage != "", "stage_failed")).when(kind == "report", F.col("outcome"))
    ids = F.when(kind.isin("hit", "shown"), shell.entry_ids(text)).when(kind == "report", F.array(F.lower("entry_id")))
    return rows.withColumn("line", line).select(
        "session", F.unix_millis(F.col("at").cast("timestamp")).alias("at"), "kind", F.col("does.key").alias("key"), F.coalesce("line", F.lit("")).alias("line"),
        error_keys.signature(F.coalesce("line", F.lit(""))).alias("sig"), ids.alias("ids"), told.alias("outcome"),
        F.when((F.col("kind") == "works") & (F.trim(text) == ""), F.nullif(F.col("does.producer"), F.lit(""))).alias("producer"), F.col("at").alias("time"),
    )


@dataclass
class Session:
    """What is remembered of a session; every list is bounded by the policy, every text by its column."""

    problem: list | None = None  # [since, line]
    failed: list | None = None  # [since, key, solved]
    missed: list | None = None  # [since, told]
    found: list | None = None  # [since, ids, told, asked, solved at]
    shown: list | None = None  # [since, ids, used, reported, asked]
    last: int | None = None
    said: int = 0
    solved: int = 0
    shared: int = 0
    asks: int = 0
    asked_at: int | None = None
    seen: list = field(default_factory=list)
    producers: list = field(default_factory=list)
    known: list = field(default_factory=list)

    @classmethod
    def read(cls, raw: str | None) -> Session:
        """What was written; a new session where that is damaged or of another shape."""
        try:
            got = json.loads(raw or "{}")
            own = cls(**got)
        except (TypeError, ValueError):
            return cls()
        lists = [getattr(own, f.name) for f in fields(cls)[-3:]]
        numbers = [own.said, own.solved, own.shared, own.asks]
        sizes = {"problem": 2, "failed": 3, "missed": 2, "found": 5, "shown": 5}
        records = all(getattr(own, n) is None or (isinstance(getattr(own, n), list) and len(getattr(own, n)) == k) for n, k in sizes.items())
        sound = records and all(isinstance(x, list) for x in lists) and all(isinstance(x, int) for x in numbers)
        return own if sound else cls()

    def write(self) -> str:
        return json.dumps(asdict(self))


class Machine:
    """One event after the other; each kind has a method that changes the session and yields (say, line, ids, since)."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def step(self, s: Session, e) -> Iterator[tuple]:
        yield from getattr(self, e.kind)(s, e)

    def _within(self, since: int | None, now: int, span: int) -> bool:
        return since is not None and now - since < span

    def _open(self, s: Session, now: int) -> list | None:
        return s.problem if s.problem and self._within(s.problem[0], now, self.policy.open_for) else None

    def _may_say(self, s: Session, e) -> bool:
        rested = s.last is None or e.at - s.last >= self.policy.apart
        return s.said < self.policy.most and rested and not (e.sig and e.sig in s.seen)

    def _saying(self, s: Session, e, say: str) -> tuple:
        s.last, s.said = e.at, s.said + 1
        s.seen = [*s.seen, *filter(None, [e.sig])][-self.policy.seen :]
        return say, e.line, [], None

    def miss(self, s: Session, e) -> Iterator[tuple]:
        s.missed = [e.at, False]
        return iter(())

    def hit(self, s: Session, e) -> Iterator[tuple]:
        s.missed, s.found = None, [e.at, list(e.ids)[: self.policy.ids], False, False, None] if len(e.ids) else None
        return iter(())

    def shown(self, s: Session, e) -> Iterator[tuple]:
        new = [i for i in (e.ids if e.ids is not None else []) if i not in s.known][: self.policy.ids]
        if new:
            s.shown, s.known = [e.at, new, False, False, False], [*s.known, *new][-self.policy.shown :]
            yield "known", "", new, None

    def brief(self, s: Session, e) -> Iterator[tuple]:
        if s.shown and not s.shown[3]:
            s.shown[2] = True
        return iter(())

    def report(self, s: Session, e) -> Iterator[tuple]:
        problem, solved_at = self._open(s, e.at), s.found[4] if s.found else None
        s.found = None
        if s.shown:
            s.shown[3] = True
        sound = [i for i in (e.ids if e.ids is not None else []) if i and len(i) == 36]
        if problem and sound and e.outcome in HELPED:
            s.problem = None
            yield "aided", problem[1], sound, problem[0], solved_at

    def publish(self, s: Session, e) -> Iterator[tuple]:
        s.shared, s.asked_at = s.solved, e.at
        return iter(())

    def fail(self, s: Session, e) -> Iterator[tuple]:
        s.problem = self._open(s, e.at) or ([e.at, e.line] if e.line else None)
        s.failed = [e.at, e.key, False]
        if self._may_say(s, e):
            yield self._saying(s, e, "failed")

    def works(self, s: Session, e) -> Iterator[tuple]:
        if self.policy.failures_only:
            return
        same = s.failed is not None and s.failed[1] == e.key
        if same and not s.failed[2] and self._within(s.failed[0], e.at, self.policy.open_for):
            s.failed[2], s.solved = True, s.solved + 1
        if same and s.said < self.policy.most:
            if s.missed and not s.missed[1] and self._within(s.missed[0], e.at, self.policy.open_for):
                s.missed[1], s.said = True, s.said + 1
                problem, s.problem = self._open(s, e.at), None
                yield "publish", "", [], None
                if problem:
                    yield "unaided", problem[1], [], problem[0]
                return
            if s.found and not s.found[2] and self._within(s.found[0], e.at, self.policy.open_for):
                s.found[2], s.found[4], s.said = True, e.at, s.said + 1
                yield "report", "", s.found[1], None
                return
        if e.outcome is not None:
            if self._may_say(s, e):
                yield self._saying(s, e, e.outcome)
                if e.outcome == "stage_failed":
                    s.failed = [e.at, e.key, False]
        elif e.producer and e.producer not in s.producers and s.said < self.policy.most:
            s.last, s.said = e.at, s.said + 1
            s.producers = [*s.producers, e.producer][-self.policy.producers :]
            yield "silent_stage", e.producer, [], None

    def stop(self, s: Session, e) -> Iterator[tuple]:
        if not self.policy.private:
            if s.found and not s.found[2] and not s.found[3] and e.at - s.found[0] <= self.policy.found_for:
                s.found[3] = True
                yield "ask_report", "", s.found[1], None
            return
        new = s.solved > s.shared
        relied = s.shown if s.shown and s.shown[2] and not s.shown[3] and not s.shown[4] else None
        rested = not self._within(s.asked_at, e.at, self.policy.asks_apart)
        if (new or relied) and s.asks < self.policy.asks and rested:
            s.asks, s.asked_at = s.asks + 1, e.at
            s.shared = s.solved if new else s.shared
            if relied:
                relied[4] = True
            yield "ask_share" if new else "ask_shown", "", relied[1] if relied else [], None


def _told(machine: Machine, session: str, s: Session, e) -> Iterator[tuple]:
    for say, line, ids, since, *until in machine.step(s, e):
        yield session, (until[0] if until and until[0] is not None else e.at), say, line, list(ids), since


_COLUMNS = [x.split()[0] for x in SAID.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"since": "Int64"})


_ORDER = ["at", "kind", "key", "line", "outcome"]


def replayed(events: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """All that is said over whole sessions. A session is read in time order and never held: only its state is."""
    machine = Machine(policy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = None, Session()
        for batch in batches:
            out: list[tuple] = []
            for e in batch.itertuples(index=False):
                if e.session != current:
                    current, s = e.session, Session()
                out.extend(_told(machine, current, s, e))
            yield _frame(out)

    rows = classified(events)
    return rows.repartition("session").sortWithinPartitions("session", *_ORDER).mapInPandas(run, SAID)


def streamed(events: DataFrame, policy: Policy = Policy(), idle: str = "12 hours") -> DataFrame:  # noqa: B008
    """The same over a stream with a watermark on `at`; a session's state goes when the watermark is `idle` past its last event.

    Within a batch a session's events are taken in time order; what comes later than a batch is taken when it comes."""
    machine, wait = Machine(policy), int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = Session.read(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(_ORDER, kind="stable")  # of one session and one micro-batch
        out = [x for e in rows.itertuples(index=False) for x in _told(machine, key[0], s, e)]
        state.update((s.write(),))
        state.setTimeoutTimestamp(max(int(rows["at"].max()), state.getCurrentWatermarkMs()) + wait)
        yield _frame(out)

    rows = classified(events)  # time carries the watermark
    return rows.groupBy("session").applyInPandasWithState(run, SAID, "state string", "append", "EventTimeTimeout")


def note(say: Column, line: Column, ids: Column) -> Column:
    """What is said, as one sentence."""
    entries = F.array_join(ids, ", ")
    return (
        F.when(say == "failed", F.concat(F.lit("A command just failed."), F.when(line != "", F.concat(F.lit(" Last error line: «"), line, F.lit("».")) ).otherwise(""), F.lit(" Search for the exact error line before you try a fix.")))
        .when(say == "hidden_error", F.concat(F.lit("A command finished with exit 0, but its output ends with what looks like an error: «"), line, F.lit("».")))
        .when(say == "stage_failed", F.concat(F.lit("A pipeline finished with exit 0, but an earlier stage could not run: «"), line, F.lit("».")))
        .when(say == "silent_stage", F.concat(F.lit("`"), line, F.lit("` ran inside a pipeline that printed nothing and exited 0: this says nothing about whether it worked.")))
        .when(say == "publish", F.lit("The command that failed earlier now succeeds, and nothing was known about that error: publish the fix if you verified it."))
        .when(say == "report", F.concat(F.lit("The command that failed earlier now succeeds: report on the entry you followed ("), entries, F.lit(").")))
        .when(say.isin("ask_report", "ask_shown"), F.concat(F.lit("Before you finish, report on each entry that you relied on ("), entries, F.lit(").")))
        .when(say == "ask_share", F.lit("Before you finish, share what you solved."))
        .when(say == "known", F.concat(F.lit("Known about this task: "), entries))
    )
