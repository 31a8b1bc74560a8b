"""Streams that are stopped, started again and cut anywhere: timers, interval joins and growing transcripts say what a batch says."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import pytest
from lorekeep.sources.transcript_stream import PAIRS, Transcripts, pairs_between
from lorekeep.sources.transcripts import paired_calls, read_lines, steps
from lorekeep.streaming import timers
from lorekeep.streaming.effort_join import vouched
from lorekeep.streaming.limits import effort_answers
from lorekeep.streaming.sessions import Policy, replayed
from pyspark.sql import functions as F
from test_sessions import A, B, EVENTS, FOUND, NONE, PLAIN, START, failure, report, search, success, table

HOUR = 3_600_000


class Feed:
    """A folder that gets one file after another, and a query over it that starts anew each time from its checkpoint."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build = spark, folder, schema, build
        (folder / "in").mkdir()
        self.progress = []

    def run(self, rows=None):
        if rows is not None:
            rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        self.progress += [p for p in query.recentProgress]
        return self.found()

    def run_until(self, rows, many):
        """For queries that go on by the clock: until so many rows are there."""
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        out = self.build(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        query = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").start()
        until = time.time() + 120
        while len(self.found()) < many and time.time() < until:
            time.sleep(0.5)
        query.stop()
        return self.found()

    def found(self):
        try:
            return self.spark.read.parquet(f"{self.folder}/out").collect()
        except Exception:
            return []

    def state_rows(self):
        return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in self.progress if p["stateOperators"]]


def by_session(rows):
    return sorted((r.session, r.at, r.say, r.line, tuple(r.ids), r.since) for r in rows)


SILENT = {
    "silent": ([failure(0, "make", "Error: a")], [("problem_expired", 45 * 60_000)]),
    "solved": ([failure(0, "make", "Error: b"), search(5, NONE), success(60, "make", "ok")], []),
    "reported": ([failure(0, "pytest", "FAILED x::y"), search(5, FOUND), report(60)], []),
    "ignored": ([search(0, FOUND)], [("unreported", 12 * HOUR + 1)]),
    "late_again": ([failure(0, "make", "Error: c"), failure(44 * 60, "make", "Error: d"), failure(46 * 60, "make", "Error: e")], [("problem_expired", 45 * 60_000), ("problem_expired", 91 * 60_000)]),
}
BEGIN = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)


def test_what_the_clock_says_in_a_batch(spark):
    found = by_session(timers.replayed_on_time(table(spark, SILENT)).collect())
    mine = {k: sorted((say, at - BEGIN) for s, at, say, *_ in found if s == k and say in ("problem_expired", "unreported")) for k in SILENT}
    assert mine == {k: sorted(v) for k, (_, v) in SILENT.items()}
    # All else is what the machine without a clock says.
    plain = table(spark, {k: v for k, v in PLAIN.items() if k != "ask_late"})
    assert [x for x in by_session(timers.replayed_on_time(plain).collect()) if x[2] not in ("problem_expired", "unreported")] == by_session(replayed(plain).collect())


def test_timers_fire_when_a_session_falls_silent(spark, tmp_path):
    """Each batch is a start from the checkpoint; the expiry comes with the watermark and not with an event of its session."""
    feed = Feed(spark, tmp_path, EVENTS, lambda s: timers.streamed_on_time(s.withWatermark("at", "10 minutes")))
    all_events = {k: v for k, v in SILENT.items()}
    feed.run(table(spark, all_events))
    said = [r for r in by_session(feed.found()) if r[2] == "problem_expired"]
    assert [r[0] for r in said] == ["late_again"]  # a later event of the session itself
    feed.run(table(spark, {"other": ([success(3 * 3600, "make", "x")], [])}))
    feed.run(table(spark, {"other": ([success(3 * 3600 + 60, "make", "x")], [])}))
    said = {(r[0], r[1] - BEGIN) for r in by_session(feed.found()) if r[2] == "problem_expired"}
    assert said == {("silent", 45 * 60_000), ("late_again", 45 * 60_000), ("late_again", 91 * 60_000)}
    # An event later than the watermark is dropped: the problem that it would have solved stays expired.
    before = len(feed.found())
    feed.run(table(spark, {"silent": ([search(60, NONE), success(100, "make", "ok")], [])}))
    assert len(feed.found()) == before and sum(o.get("numRowsDroppedByWatermark", 0) for p in feed.progress for o in p["stateOperators"]) >= 2
    for hours in (30, 31, 60, 61):
        feed.run(table(spark, {"other": ([success(hours * 3600, "make", "x")], [])}))
    assert {r[0] for r in by_session(feed.found()) if r[2] == "unreported"} == {"ignored"}
    whole = {k: v for k, v in SILENT.items()}
    assert [x for x in by_session(feed.found())] == by_session(timers.replayed_on_time(table(spark, whole)).collect())
    assert feed.state_rows()[-1] <= 2  # silent sessions are forgotten


def test_batches_cut_anywhere(spark, tmp_path):
    """Events in order of time, cut at random: the same as in one batch, but for what is still open at the end."""
    rng = random.Random(5)
    events = [(rng.randrange(40 * 3600), k, make) for k in range(12) for make in (lambda t: failure(t, "make", "Error: a"), lambda t: failure(t, "npm ci", "Error: q"), lambda t: search(t, NONE), lambda t: search(t, FOUND), lambda t: success(t, "make", "ok"), lambda t: report(t, B), lambda t: report(t, A, "failed")) * 2]
    events.sort(key=lambda x: x[:2])
    rows = table(spark, {f"s{k}": ([make(t) for t, o, make in events if o == k], []) for k in range(12)}).orderBy("at").collect()
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    policy = Policy(apart=0)
    feed = Feed(spark, tmp_path, EVENTS, lambda s: timers.streamed_on_time(s.withWatermark("at", "0 seconds"), policy, idle="20 hours"))
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        feed.run(spark.createDataFrame(rows[a:b], EVENTS))
    for t in (200, 201):
        feed.run(table(spark, {"end": ([success(t * 3600, "make", "x")], [])}))
    assert by_session(feed.found()) == by_session(timers.replayed_on_time(spark.createDataFrame(rows, EVENTS), policy).collect())


def test_drafts_live_for_their_time(spark, tmp_path):
    schema = "id long, draft_id string, action string"
    feed = Feed(spark, tmp_path, schema, lambda s: timers.streamed_drafts(s, life=30_000))
    feed.run_until(spark.createDataFrame([(1, "a", "create"), (2, "a", "create"), (3, "b", "create"), (4, "c", "approve"), (5, None, "create"), (6, "d", "create"), (7, "d", None)], schema), 6)
    feed.run_until(spark.createDataFrame([(8, "a", "approve"), (9, "a", "approve")], schema), 8)
    time.sleep(31)
    found = [tuple(r) for r in feed.run_until(spark.createDataFrame([(10, "b", "approve"), (11, "b", "create")], schema), 10)]
    assert sorted(found) == sorted([("a", "create", "pending"), ("a", "create", "known"), ("b", "create", "pending"), ("c", "approve", "gone"), ("d", "create", "pending"), ("d", "", "discarded"), ("a", "approve", "published"), ("a", "approve", "settled"), ("b", "approve", "gone"), ("b", "create", "pending")])


# --- Effort ----------------------------------------------------------------------------------------------------------

SIDES = "kind string, id long, person string, trail_id string, outcome string, author string, at timestamp"


def test_records_and_reports(spark, tmp_path):
    rng = random.Random(7)
    rows = [("record" if rng.random() < 0.5 else "report", i, f"p{rng.randrange(6)}", f"t{rng.randrange(5)}", rng.choice(["worked", "worked", "failed"]), f"p{rng.randrange(6)}", START + dt.timedelta(minutes=rng.randrange(9 * 24 * 60))) for i in range(700)]
    rows += [("report", 900, None, "t1", "worked", "p1", START), ("report", 901, "p1", None, "worked", None, START), ("record", 902, None, "t1", None, None, START), ("report", 903, "q", "t1", "worked", None, START), ("record", 904, "q", "t1", None, None, START), ("record", 905, "q", "t1", None, None, START + dt.timedelta(days=2))]
    whole = spark.createDataFrame(rows, SIDES)
    sides = lambda df: (df.where("kind = 'record'"), df.where("kind = 'report'"))
    found = {r.id: r.reported for r in vouched(*sides(whole)).collect()}
    told = [r for r in rows if r[0] == "report" and r[4] == "worked" and r[5] != r[2]]
    assert found == {r[1]: any(t[2] == r[2] and t[3] == r[3] and t[2] is not None and dt.timedelta(0) <= r[6] - t[6] < dt.timedelta(days=2) for t in told) for r in rows if r[0] == "record"}
    assert found[904] and not found[905] and not found[902]
    # The machine of limits.py, which sees both in one order, says the same of each aided record.
    events = whole.where("person IS NOT NULL").select("id", "person", F.col("kind").alias("what"), F.lit("aided").alias("role"), F.col("id").cast("string").alias("fingerprint"), "trail_id", "outcome", "author", "at")
    answers = {r.id: r.answer for r in effort_answers(events.withColumn("id", F.when(F.col("what") == "report", F.col("id") - 10_000).otherwise(F.col("id")))).collect()}
    assert {i: a != "not_reported" for i, a in answers.items()} == {i: f for i, f in found.items() if i != 902}
    # A stream, started again after every file, in order of time with some disorder.
    order = sorted(rows, key=lambda r: (r[6] + dt.timedelta(minutes=rng.randrange(40)), r[1]))
    feed = Feed(spark, tmp_path, SIDES, lambda s: vouched(*sides(s)))
    for a in range(0, len(order), 250):
        feed.run(spark.createDataFrame(order[a : a + 250], SIDES))
    most = max(feed.state_rows())
    for days in (30, 31):
        feed.run(spark.createDataFrame([(kind, 1000 + days, "z", "z", "worked", None, START + dt.timedelta(days=days)) for kind in ("record", "report")], SIDES))
    streamed = {r.id: r.reported for r in feed.found() if r.id < 1000}
    assert streamed == found and len([r for r in feed.found() if r.id < 1000]) == len(found)
    assert feed.state_rows()[-1] < 10 < most


# --- Transcripts -----------------------------------------------------------------------------------------------------


def call(i, *names, **more):
    return json.dumps({"step_index": i, "type": "PLANNER_RESPONSE", "tool_calls": [{"name": n, "args": {"k": n, "deep": [1]}} for n in names], **more})


def result(i, text):
    return json.dumps({"step_index": i, "type": "GENERIC", "content": text})


def transcript(rng, n):
    lines, i = [], 0
    for _ in range(n):
        names = [f"n{rng.randrange(9)}" for _ in range(rng.randrange(4))]
        lines.append(call(i, *names))
        i += 1
        for name in names:
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "not json", "[1]", '{"half": ']))
            lines.append(result(i, f"r {name} é"))
            i += 1
        lines += [json.dumps({"step_index": i, "type": "USER_INPUT", "content": "x"})] * (rng.random() < 0.3)
        i += 1
    return "\n".join(lines).encode() + b"\n"


def lines_of(data):
    at = 0
    for line in data.split(b"\n"):
        yield at + len(line), line
        at += len(line) + 1


def test_pairs_between_any_two_sizes():
    rng = random.Random(1)
    for _ in range(30):
        data = transcript(rng, 12)
        whole = list(pairs_between(lines_of(data), 0))
        cuts = [0, *sorted(rng.randrange(len(data)) for _ in range(rng.randrange(8))), len(data)]
        parts = [list(pairs_between(lines_of(data[:b]), a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert [x for p in parts for x in p] == whole and len(whole) > 3


def test_growing_transcripts(spark, tmp_path):
    """Files grow between triggers, a query stops and starts again: each pair comes once; a batch and the windows agree."""
    spark.dataSource.register(Transcripts)
    rng, folder = random.Random(3), tmp_path / "in"
    folder.mkdir()
    data = {f"{k}.jsonl": transcript(rng, 20) for k in "abc"}
    data["never.jsonl"] = "\n".join([call(0, "a"), result(1, "x"), call(2, "b", "c"), result(3, "y"), call(4, "d"), result(5, "z"), ""]).encode()
    done = dict.fromkeys(data, 0)

    def start():
        stream = spark.readStream.format("transcripts").option("path", str(folder)).load()
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")

    def grow(share):
        for name, text in data.items():
            to = len(text) if share == 1 else rng.randrange(done[name], len(text))
            with (folder / name).open("ab") as f:
                f.write(text[done[name] : to])
            done[name] = to

    for share in (0.2, 0.4, 0.6, 0.8, 1):
        grow(share)
        assert start().trigger(availableNow=True).start().awaitTermination(120)
    found = sorted((r.session.rpartition("/")[2], r.step_index, r.n, r.name, r.result) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = spark.read.format("transcripts").option("path", str(folder)).load()
    assert found == sorted((r.session.rpartition("/")[2], r.step_index, r.n, r.name, r.result) for r in batch.collect())
    windows = paired_calls(steps(read_lines(spark, str(folder)).where("line NOT LIKE '{\"half%'")))
    assert found == sorted((r.session.rpartition("/")[2], r.step_index, r.n, r.name, r.result) for r in windows.collect())
    assert [x[1:] for x in found if x[0] == "never.jsonl"] == [(0, 0, "a", "x")] and len(found) > 40
    assert batch.schema == spark.createDataFrame([], PAIRS).schema and {r.args["deep"] for r in batch.collect()} == {"[1]"}


@pytest.mark.parametrize("made", [False, True])
def test_no_transcripts(spark, tmp_path, made):
    spark.dataSource.register(Transcripts)
    if made:
        (tmp_path / "x").mkdir()
        (tmp_path / "x" / "empty.jsonl").write_text("")
    assert spark.read.format("transcripts").option("path", str(tmp_path / "x")).load().count() == 0
