"""Limits that depend on what came before, by key: which reports count, drafts that expire, effort records that are stored, and
hourly counters. Each is a step over one event and a small state, for a batch (keys sorted within partitions) and for a stream
alike. States forget what is older than the limit's time, so they are bounded by what one key does in that time.

Rows without key or time are dropped. Events of one time are taken in the order of id.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract; times in milliseconds.
HOUR = 3_600_000
DAY = 24 * HOUR
ADDRESSES_A_DAY, REPORTS_AN_HOUR = 3, 20
DRAFT_LIFE, DRAFTS_AN_HOUR = HOUR // 2, 30
EFFORT_APART, EFFORTS_A_DAY, REPORTED_WITHIN = HOUR, 60, 2 * DAY
TRAILS_AN_HOUR = 30
RAISES = ("worked", "partially_worked")

Step = Callable[[dict, object], Iterator[tuple]]


def over_batch(rows: DataFrame, key: str, step: Step, schema: str) -> DataFrame:
    """step over each key's rows in order of at and id; a key of any size is read as it comes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if getattr(row, key) != current:
                    current, state = getattr(row, key), {}
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    some = rows.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withColumn("at", F.unix_millis(F.col("at").cast("timestamp")))
    return some.repartition(key).sortWithinPartitions(key, "at", "id").mapInPandas(run, schema)


def over_stream(rows: DataFrame, key: str, step: Step, schema: str, keep: int) -> DataFrame:
    """The same for a stream with a watermark on at; a key's state goes when nothing came for keep milliseconds."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = json.loads(state.get[0]) if state.exists else {}
        part = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")  # of one key and one micro-batch
        out = [x for row in part.itertuples(index=False) for x in step(own, row)]
        state.update((json.dumps(own),))
        state.setTimeoutTimestamp(max(int(part["at"].max()), state.getCurrentWatermarkMs()) + keep)
        yield pd.DataFrame(out, columns=names)

    some = rows.where(F.col(key).isNotNull() & F.col("at").isNotNull()).withColumn("time", F.col("at")).withColumn("at", F.unix_millis(F.col("at").cast("timestamp")))
    return some.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", "EventTimeTimeout")


def _recent(state: dict, name: str, now: int, span: int) -> list:
    """The entries [at, ...] of a list that are younger than span; what is older is forgotten."""
    state[name] = [x for x in state.get(name, []) if now - x[0] < span]
    return state[name]


# --- Reports ---------------------------------------------------------------------------------------------------------

COUNTED = "id long, trail_id string, address string, at long, counts boolean"


def report_of_trail(state: dict, r) -> Iterator[tuple]:
    """One report an agent and day, three agents an address and day, nothing that raises a trail from its author or the author's
    address of that day. r: id, trail_id, agent, address, outcome, author, author_address, at."""
    today = _recent(state, "counted", r.at, DAY)
    raises = r.outcome in RAISES
    own = raises and (r.agent == r.author or (r.address is not None and r.address == r.author_address))
    again = any(agent == r.agent for _, agent, _ in today)
    crowd = r.address is not None and len({agent for _, agent, address in today if address == r.address} - {r.agent}) >= ADDRESSES_A_DAY
    counts = not (own or again or crowd)
    if counts:
        today.append([r.at, r.agent, r.address])
    yield r.id, r.trail_id, r.address, r.at, counts


def report_of_address(state: dict, r) -> Iterator[tuple]:
    """Of reports that count for their trails, twenty an address and hour count."""
    hour = _recent(state, "counted", r.at, HOUR)
    counts = bool(r.counts) and len(hour) < REPORTS_AN_HOUR
    if counts:
        hour.append([r.at])
    yield r.id, r.trail_id, r.address, r.at, counts


def counted_reports(reports: DataFrame) -> DataFrame:
    """id, trail_id, address, at, counts of a batch: by trail, then by address. Reports without an address have no limit of addresses."""
    by_trail = over_batch(reports, "trail_id", report_of_trail, COUNTED)
    known, other = by_trail.where("address IS NOT NULL"), by_trail.where("address IS NULL")
    return over_batch(known.withColumn("at", F.timestamp_millis("at")), "address", report_of_address, COUNTED).unionByName(other)


# --- Drafts ----------------------------------------------------------------------------------------------------------

DRAFTED = "draft_id string, at long, state string"


def draft(state: dict, e) -> Iterator[tuple]:
    """A draft is pending for half an hour; approving it twice publishes it once. e: id, draft_id, action, at."""
    if e.action == "create" and not state:
        state.update(at=e.at, state="pending")
        yield e.draft_id, e.at, "pending"
    elif state.get("state") == "pending" and e.action in ("approve", "discard"):
        late = e.at - state["at"] >= DRAFT_LIFE
        state["state"] = "expired" if late else {"approve": "published", "discard": "discarded"}[e.action]
        yield e.draft_id, e.at, state["state"]


def drafts(events: DataFrame) -> DataFrame:
    return over_batch(events, "draft_id", draft, DRAFTED)


# --- Effort ----------------------------------------------------------------------------------------------------------

EFFORT = "id long, person string, at long, answer string"


def effort(state: dict, e) -> Iterator[tuple]:
    """What is answered to a person's record: stored, repeated, not_reported or too_many. Reports of the same person come in the same
    stream. e: id, person, what (report, record), role, fingerprint, trail_id, outcome, author, at."""
    if e.what == "report":
        if e.outcome == "worked" and e.author != e.person:
            _recent(state, "reports", e.at, REPORTED_WITHIN).append([e.at, e.trail_id])
        return
    day = _recent(state, "stored", e.at, DAY)
    if len(day) >= EFFORTS_A_DAY:
        answer = "too_many"
    elif any(role == e.role and key == e.fingerprint and e.at - at < EFFORT_APART for at, role, key in day):
        answer = "repeated"
    elif e.role == "aided" and e.trail_id not in [x[1] for x in _recent(state, "reports", e.at, REPORTED_WITHIN)]:
        answer = "not_reported"
    else:
        answer = "stored"
        day.append([e.at, e.role, e.fingerprint])
    yield e.id, e.person, e.at, answer


def effort_answers(events: DataFrame) -> DataFrame:
    return over_batch(events, "person", effort, EFFORT)


# --- Quotas and counters ---------------------------------------------------------------------------------------------

ALLOWED = "id long, caller string, at long, allowed boolean"


def quota(most: int, span: int) -> Step:
    """At most so many calls in any stretch of so many milliseconds. e: id, caller, at."""

    def step(state: dict, e) -> Iterator[tuple]:
        own = _recent(state, "calls", e.at, span)
        allowed = len(own) < most
        if allowed:
            own.append([e.at])
        yield e.id, e.caller, e.at, allowed

    return step


def within_quota(calls: DataFrame, most: int = TRAILS_AN_HOUR, span: int = HOUR) -> DataFrame:
    return over_batch(calls, "caller", quota(most, span), ALLOWED)


def hourly_counters(searches: DataFrame) -> DataFrame:
    """hour, key, searches; of a stream, hours are kept for two hours after they end."""
    rows = searches.withWatermark("at", "2 hours") if searches.isStreaming else searches
    counted = rows.groupBy(F.window("at", "1 hour"), "key").agg(F.count("*").alias("searches"))
    return counted.select(F.col("window.start").alias("hour"), "key", "searches")


def last_of(items: Column, most: int) -> Column:
    """The last so many items of a list."""
    return F.when(F.size(items) > most, F.slice(items, -most, most)).otherwise(items)


def latest(rows: DataFrame, most: int = 14) -> DataFrame:
    """The latest activity, newest first, as a page shows it."""
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(most)
