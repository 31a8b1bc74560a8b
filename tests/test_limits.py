"""Limits over time by key, over a batch and over a stream."""

import datetime as dt

from lorekeep.streaming import limits

START = dt.datetime(2024, 1, 1)
REPORT = "id long, trail_id string, agent string, address string, outcome string, author string, author_address string, at timestamp"


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_reports(spark):
    rows = [
        (1, "t", "a", "x", "worked", "me", "home", at(0)), (2, "t", "a", "x", "failed", "me", "home", at(23)), (3, "t", "a", "x", "failed", "me", "home", at(24)), (4, "t", "me", "y", "worked", "me", "home", at(1)), (5, "t", "me", "y", "failed", "me", "home", at(1)),
        (6, "t", "b", "home", "partially_worked", "me", "home", at(2)), (7, "t", "c", "x", "worked", "me", "home", at(3)), (8, "t", "d", "x", "worked", "me", "home", at(3)), (9, "t", "e", "x", "worked", "me", "home", at(4)), (10, "t", "f", None, "worked", "me", None, at(4)),
        *((100 + i, f"u{i}", "z", "busy", "worked", "me", "home", at(50 + i / 100)) for i in range(22)), (200, "v", "z", "busy", "worked", "me", "home", at(52)),
    ]
    found = {r.id: r.counts for r in limits.counted_reports(spark.createDataFrame(rows, REPORT)).collect()}
    assert {i: c for i, c in found.items() if i < 100} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: True, 8: True, 9: False, 10: True}
    assert [found[100 + i] for i in range(22)] == [True] * 20 + [False] * 2 and found[200]


def test_drafts(spark):
    rows = [("a", "create", 0), ("a", "approve", 0.2), ("a", "approve", 0.3), ("b", "create", 0), ("b", "approve", 0.6), ("c", "create", 0), ("c", "discard", 0.1), ("c", "approve", 0.2), ("d", "approve", 0)]
    events = spark.createDataFrame([(i, d, x, at(h)) for i, (d, x, h) in enumerate(rows)], "id long, draft_id string, action string, at timestamp")
    assert sorted((r.draft_id, r.state) for r in limits.drafts(events).where("state <> 'pending'").collect()) == [("a", "published"), ("b", "expired"), ("c", "discarded")]


def test_efforts(spark):
    rows = [
        ("record", "unaided", "k", None, None, None, 0), ("record", "unaided", "k", None, None, None, 0.5), ("record", "unaided", "k", None, None, None, 1), ("record", "aided", "k", "t", None, None, 1), ("report", None, None, "t", "worked", "other", 2),
        ("record", "aided", "k", "t", None, None, 3), ("record", "aided", "m", "t", None, None, 51), ("report", None, None, "s", "worked", "p", 52), ("record", "aided", "n", "s", None, None, 53),
    ]
    schema = "id long, person string, what string, role string, fingerprint string, trail_id string, outcome string, author string, at timestamp"
    events = spark.createDataFrame([(i, "p", *r[:-1], at(r[-1])) for i, r in enumerate(rows)] + [(100 + i, "q", "record", "unaided", f"k{i}", None, None, None, at(i / 100)) for i in range(62)], schema)
    found = {r.id: r.answer for r in limits.effort_answers(events).collect()}
    assert {i: a for i, a in found.items() if i < 100} == {0: "stored", 1: "repeated", 2: "stored", 3: "not_reported", 5: "stored", 6: "not_reported", 8: "not_reported"}
    assert [found[100 + i] for i in range(62)] == ["stored"] * 60 + ["too_many"] * 2


def test_quota_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", at(i / 10)) for i in range(60)] + [(99, None, at(0))], "id long, caller string, at timestamp")
    batch = sorted((r.id, r.allowed) for r in limits.within_quota(rows, most=3).collect())
    assert len(batch) == 60 and sum(a for _, a in batch) == 3 * 2 * 6
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withWatermark("at", "1 day")
    out = limits.over_stream(raw, "caller", limits.quota(3, limits.HOUR), limits.ALLOWED, keep=limits.HOUR)
    query = out.writeStream.format("memory").queryName("quota_in_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.id, r.allowed) for r in spark.table("quota_in_stream").collect()) == batch


def test_hourly_counters_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(at(i / 4), "k") for i in range(40)], "at timestamp, key string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = limits.hourly_counters(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("hours_in_stream").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.hour, r.searches) for r in spark.table("hours_in_stream").collect()) == sorted((r.hour, r.searches) for r in limits.hourly_counters(rows).collect())
