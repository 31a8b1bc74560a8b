"""Transcripts: damaged lines, usage in a window, calls with their results; files of one line, of many, and of several splits."""

import datetime as dt
import json

from lorekeep.operators.stats import fail_then_fix, usage_sums
from lorekeep.sources.transcripts import paired_calls, read_lines, steps, usage_lines
from pyspark.sql import functions as F


def answer(at, name, **usage):
    return json.dumps({"type": "assistant", "timestamp": at, "uuid": f"u-{at}", "message": {"id": name, "model": "m1", "usage": usage}})


def test_usage_in_a_window(spark, tmp_path):
    lines = [
        answer("2024-01-01T09:00:00Z", "before", input_tokens=1000, output_tokens=1000),
        answer("2024-01-01T10:00:00Z", "a", input_tokens=1, output_tokens=50, cache_read_input_tokens=20_000, cache_creation_input_tokens=500),
        '{"type": "assistant", "usage": damaged',
        answer("2024-01-01T10:01:00Z", "a", input_tokens=1, output_tokens=150, cache_read_input_tokens=20_000, cache_creation_input_tokens=500),
        answer("2024-01-01T10:02:00Z", "b", input_tokens=2, output_tokens=250, cache_read_input_tokens=21_000, cache_creation_input_tokens=500),
        json.dumps({"type": "user", "timestamp": "2024-01-01T10:01:30Z", "message": {"usage": {"input_tokens": 7}}}),
        answer("2024-01-01T12:00:00Z", "after", input_tokens=1000, output_tokens=1000),
    ]
    (tmp_path / "one.jsonl").write_text("\n".join(lines) + "\n\n")
    rows = usage_lines(read_lines(spark, str(tmp_path)), F.lit("2024-01-01T09:30:00Z").cast("timestamp"), F.lit("2024-01-01T11:00:00Z").cast("timestamp"))
    found = usage_sums(rows).first().asDict()
    assert {k: v for k, v in found.items() if k != "session"} == {"input_tokens": 3, "output_tokens": 400, "cache_read_tokens": 41_000, "cache_write_tokens": 1_000, "turns": 2, "model": "m1"}


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        found = [json.loads(r.line)["n"] for r in rows.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(range(20_000))


def test_calls_and_results(spark, tmp_path):
    call = lambda i, *names: json.dumps({"step_index": i, "type": "PLANNER_RESPONSE", "tool_calls": [{"name": n, "args": {"k": n}} for n in names]})
    result = lambda i, text: json.dumps({"step_index": i, "type": "GENERIC", "content": text})
    (tmp_path / "s.jsonl").write_text("\n".join([call(1, "a", "b"), result(2, "ra"), result(3, "rb"), "not json", call(4, "c"), result(5, "rc"), call(6, "d", "e"), result(7, "rd")]))
    found = sorted((r.step_index, r.n, r.name, r.result) for r in paired_calls(steps(read_lines(spark, str(tmp_path)))).collect())
    assert found == [(1, 0, "a", "ra"), (1, 1, "b", "rb"), (4, 0, "c", "rc")]  # the last is not answered wholly: it is read again later


def test_failures_and_what_mended_them(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("s", "k", 1, at(0), False), ("s", "k", 2, at(10), False), ("s", "k", 3, at(30), True), ("s", "k", 4, at(31), True), ("s", "k", 5, at(40), False), ("s", "k", 6, at(86), True), ("s", "other", 7, at(1), True), ("t", "k", 8, at(5), True)]
    found = fail_then_fix(spark.createDataFrame(rows, "session string, key string, event_id long, at timestamp, ok boolean"))
    assert sorted((r.event_id, r.fix_id) for r in found.collect()) == [(1, 3), (2, 3)]
