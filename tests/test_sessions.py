"""Scenarios of sessions: what is said, once, when; the same over a batch and over a stream."""

from __future__ import annotations

import datetime as dt

import pytest
from lorekeep.functions import shell
from lorekeep.streaming.sessions import Policy, Session, classified, note, replayed, streamed
from pyspark.sql import functions as F

EVENTS = "session string, at timestamp, event string, tool string, command string, response string, error string, exit_code int, interrupted boolean, outcome string, entry_id string"
A, B = "0b5e6c1a-2f3d-4e5f-8a9b-0c1d2e3f4a5b", "9f8e7d6c-5b4a-4321-8fed-cba987654321"
NONE = "No entry in the public colony matches this error yet (fingerprint fp2_0).\nSolve it."
FOUND = f'<lore_trails untrusted="true">\nx\n\n## Trail 1 of 2 · id {A}\nstrength 0.4\n```\n## Trail 9 of 9 · id {A.replace("0", "1")}\n```\n\n## Trail 2 of 2 · id {B.upper()}\n</lore_trails>'
START = dt.datetime(2024, 1, 1)


def failure(seconds, command, output, code=1, **more):
    return seconds, {"event": "failure", "tool": "Bash", "command": command, "error": f"Exit code {code}\n{output}", **more}


def success(seconds, command, output, **more):
    return seconds, {"event": "success", "tool": "Bash", "command": command, "response": output, **more}


def search(seconds, reply):
    return seconds, {"event": "success", "tool": "x__search", "response": reply, "error": "boom"}


def report(seconds, entry=A, outcome="worked"):
    return seconds, {"event": "success", "tool": "x__report", "entry_id": entry, "outcome": outcome}


def stop(seconds):
    return seconds, {"event": "stop"}


PUBLISH = lambda s: (s, {"event": "success", "tool": "x__publish"})
BRIEF = lambda s: (s, {"event": "success", "tool": "x__brief"})
PROMPT = lambda s, ids: (s, {"event": "prompt", "response": "\n".join(f"## Trail {i + 1} of {len(ids)} · id {x}" for i, x in enumerate(ids))})

# session: events, what is said (with its line or entries)
PLAIN = {
    "failure": ([failure(0, "npm ci", "npm warn x\nnpm error ERESOLVE could not resolve")], [("failed", "npm error ERESOLVE could not resolve")]),
    "interrupt": ([failure(0, "npm test", "x", interrupted=True)], []),
    "stopped": ([failure(i, "npm test", "Error: x", code=c) for i, c in enumerate((124, 130, 137, 143))], []),
    "no_line": ([failure(0, "cd /srv/app && ./check.sh", "src/a.java 0")], [("failed", "")]),
    "tool_line": ([failure(0, "fontcache check serif", "fontcache: table 'serif' was built for another locale")], [("failed", "fontcache: table 'serif' was built for another locale")]),
    "usage": ([failure(0, "acmectl --verbos", "acmectl: unrecognized option '--verbos'")], []),
    "answer": ([failure(0, "kubectl diff -f d/", "diff -u x y"), failure(1, "kubectl diff -f d/", "error: no such type", code=2)], [("failed", "error: no such type")]),
    "condition": ([failure(0, "for b in a b; do [ $n -gt 1 ] && echo big; done", "b=9")], []),
    "probe": ([failure(0, "cd app; grep -c x f | wc -l", "0"), success(1, "docker logs api", "ERROR: old"), failure(30, "cd app && mvn test | grep FAIL", "Error: boom")], [("failed", "Error: boom")]),
    "hidden": ([success(0, "kubectl exec pod -- psql | tail -1", "x\nERROR:  relation missing")], [("hidden_error", "ERROR: relation missing")]),
    "plain": ([success(i, "npm run build", t) for i, t in enumerate(['{"error": null}', "0 errors, 0 warnings", "no error found"])], []),
    "stage": ([success(0, "deploy.sh 2>&1 | tail -5", "bash: deploy.sh: command not found")], [("stage_failed", "bash: deploy.sh: command not found")]),
    "looking": ([success(0, "run; lsx M* 2>&1 | head", "README\nls: cannot access 'M*': No such file or directory")], []),
    "silent": ([success(0, "mvn test | grep FAIL", ""), success(60, "mvn test | grep FAIL", " ")], [("silent_stage", "mvn test")]),
    "repeated": ([failure(0, "psql", "psql: error: port 5432 failed"), failure(60, "psql", "psql: error: port 5433 failed"), failure(120, "psql", "psql: error: other")], [("failed", "psql: error: port 5432 failed"), ("failed", "psql: error: other")]),
    "apart": ([failure(0, "make", "Error: a"), failure(15, "make", "Error: b"), failure(25, "make", "Error: b")], [("failed", "Error: a"), ("failed", "Error: b")]),
    "most": ([failure(i * 30, "make", f"Error: {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}q") for i in range(35)], [("failed", f"Error: {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}q") for i in range(30)]),
    "publish": ([failure(0, "npm install", "Error: b"), search(5, NONE), success(60, "npm install --force", "ok"), success(90, "npm install", "ok")], [("failed", "Error: b"), ("publish", ""), ("unaided", "Error: b")]),
    "other_program": ([failure(0, "npm install", "Error: b"), search(5, NONE), success(60, "python app.py", "ok"), success(46 * 60, "npm install", "ok")], [("failed", "Error: b")]),
    "report": ([failure(0, "npm i", "Error: b"), search(5, FOUND), success(60, "npm i", "ok"), success(90, "npm i", "ok"), report(100)], [("failed", "Error: b"), ("report", [A, B]), ("aided", "Error: b")]),
    "reported": ([failure(0, "pytest", "FAILED x::y"), search(5, FOUND), report(20, outcome="failed"), success(60, "pytest -q", "ok")], [("failed", "FAILED x::y")]),
    "replaced": ([failure(0, "make", "Error: a"), search(1, FOUND), search(2, NONE), success(30, "make", "done")], [("failed", "Error: a"), ("publish", ""), ("unaided", "Error: a")]),
    "ask": ([search(0, FOUND), stop(1), stop(2)], [("ask_report", [A, B])]),
    "ask_late": ([search(0, FOUND), stop(13 * 3600)], []),
    "known": ([PROMPT(0, [A]), PROMPT(1, [A]), PROMPT(2, [A, B])], [("known", [A]), ("known", [B])]),
}
PRIVATE = {
    "share": ([failure(0, "helm up", "Error: a"), stop(1), success(2, "helm up", "ok"), stop(3), stop(4)], [("failed", "Error: a"), ("ask_share", "")]),
    "shared": ([failure(0, "helm up", "Error: a"), success(1, "helm up", "ok"), PUBLISH(2), stop(3), failure(40, "helm up", "Error: b"), success(41, "helm up", "ok"), stop(3000)], [("failed", "Error: a"), ("failed", "Error: b"), ("ask_share", "")]),
    "relied": ([PROMPT(0, [A]), stop(1), BRIEF(2), stop(3), stop(4)], [("known", [A]), ("ask_shown", [A])]),
    "three_asks": ([x for k in range(5) for x in (failure(k * 4000, "make", f"Error: {'abcde'[k]}"), success(k * 4000 + 1, "make", "ok"), stop(k * 4000 + 2))], [x for k in range(5) for x in [("failed", f"Error: {'abcde'[k]}"), ("ask_share", "")][: 2 if k < 3 else 1]]),
}


def table(spark, scenarios):
    names = [x.split()[0] for x in EVENTS.split(", ")]
    rows = [tuple({"session": k, "at": START + dt.timedelta(seconds=s), **e}.get(n) for n in names) for k, (events, _) in scenarios.items() for s, e in events]
    return spark.createDataFrame(rows, EVENTS)


def said(rows, scenarios):
    out = {k: [] for k in scenarios}
    for r in sorted(rows, key=lambda r: (r.session, r.at)):
        out[r.session].append((r.say, list(r.ids) if r.say in ("report", "known", "ask_report", "ask_shown") else r.line))
    return out


@pytest.mark.parametrize("private", [False, True])
def test_scenarios(spark, private):
    scenarios = PRIVATE if private else PLAIN
    found = replayed(table(spark, scenarios), Policy(private=private)).collect()
    assert said(found, scenarios) == {k: expected for k, (_, expected) in scenarios.items()}


def test_failures_only_and_empty(spark):
    rows = table(spark, {k: PLAIN[k] for k in ("hidden", "failure", "publish")})
    assert {(r.session, r.say) for r in replayed(rows, Policy(failures_only=True)).collect()} == {("failure", "failed"), ("publish", "failed")}
    assert replayed(rows.limit(0)).count() == 0 and classified(rows.withColumn("session", F.lit(None).cast("string"))).count() == 0


def test_efforts_last_from_the_first_failure(spark):
    found = {r.session: (r.at - START.replace(tzinfo=dt.UTC).timestamp() * 1000, r.since - START.replace(tzinfo=dt.UTC).timestamp() * 1000) for r in replayed(table(spark, {k: PLAIN[k] for k in ("publish", "report")})).where("say LIKE '%aided'").collect()}
    assert found == {"publish": (60_000, 0), "report": (60_000, 0)}


def test_stream_says_the_same(spark, tmp_path):
    scenarios = {k: v for k, v in PLAIN.items() if k not in ("most",)}
    table(spark, scenarios).coalesce(1).write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in").withWatermark("at", "1 day")
    query = streamed(raw).writeStream.format("memory").queryName("said_in_stream").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert said(spark.table("said_in_stream").collect(), scenarios) == {k: expected for k, (_, expected) in scenarios.items()}


def test_damaged_state_is_a_new_session():
    assert Session.read("{") == Session.read('{"problem": 3}') == Session.read('{"other": 1}') == Session.read('{"seen": "x"}') == Session()
    kept = Session(problem=[1, "x"], seen=["a"])
    assert Session.read(kept.write()) == kept


def test_notes(spark):
    rows = spark.createDataFrame([("failed", "Error: x", []), ("report", "", [A, B])], "say string, line string, ids array<string>")
    texts = [r[0] for r in rows.select(note(F.col("say"), F.col("line"), F.col("ids"))).collect()]
    assert "«Error: x»" in texts[0] and f"{A}, {B}" in texts[1]


@pytest.mark.parametrize("command, code, expected", [
    ("kubectl diff -f deploy/", 1, True), ("kubectl diff -f deploy/", 2, False), ("gh pr checks 183", 8, True), ("gh pr checks 183", 1, False), ("cd infra && tofu plan -detailed-exitcode", 2, True),
    ("terraform plan", 2, False), ("systemctl is-active nginx", 3, True), ("npm test", 1, False), ("kubectl apply -f d/ && kubectl diff -f d/", 1, False), ("cd app && mvn test | grep FAIL", 1, False), ("x", None, False), ("", 1, False),
])
def test_exit_codes_that_answer(command, code, expected):
    assert shell.answers(command, code) is expected


def test_commands(spark):
    keys = {"npm install --legacy-peer-deps": "npm install", "sudo NODE_ENV=test npm install x": "npm install", "pip install -r r.txt": "pip install", "make": "make", "cd /srv/app && mvn -q test 2>&1 | tail -20": "mvn test", "export J=/j; ./gradlew --no-daemon build": "./gradlew build", "make > build.log 2>&1": "make", "cd /srv/app": ""}
    assert {k: shell.command_key(k) for k in keys} == keys
    producers = {"npm test | grep x": "npm test", "cd a && mvn test 2>&1 | tail -5": "mvn test", "set -o pipefail; npm test | grep x": "", "ls | grep x": "", "cargo build | mine": "", "./gradlew build | tail": "./gradlew build", "npm test": ""}
    assert {k: shell.silent_producer(k) for k in producers} == producers
    conditions = {"ls x && [ -f y ] && echo found": True, "test -d /x || mkdir /x": False, "[ -f a ]": True, "a && [ -f x ]": False, "[ a ] && run": True, "if [ -f x ]; then npm ci; fi": False, "[ a ] | cat": False}
    assert {k: shell.condition_ends(k) for k in conditions} == conditions
    rows = spark.createDataFrame([("npm test | grep x", 1)], "command string, code int").select(shell.studied("command", "code").alias("s")).select("s.*").first()
    assert tuple(rows) == ("npm test", False, False, False, "npm test")


def test_lines_are_looked_for_once(spark):
    """Each shape of a line stands once in the plan for each text that it is looked for in, whatever asks for it."""
    text = dict.fromkeys(("session", "event", "tool", "command", "response", "error", "outcome", "entry_id"), "string") | {"at": "timestamp", "exit_code": "int", "interrupted": "boolean"}
    plan = classified(spark.range(3).select(*(F.col("id").cast("string").try_cast(kind).alias(name) for name, kind in text.items())))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("BUILD (?:FAILURE|FAILED)") == 1 and plan.count("Traceback") == 2  # of an error's output; and of a reply's tail
