"""Validation of documents: the issues of each format, and that a document is parsed once however many rules it has."""

from __future__ import annotations

import json

import pytest
from lorekeep import schema
from pyspark.sql import functions as F

ID = "01234567-89ab-cdef-0123-456789abcdef"
AGENT = {"model": "m", "framework": "f"}
TRAIL = {
    "protocol_version": "1.2", "agent_info": AGENT, "tags": ["a", "b"], "environment": {"os": "linux", "runtime": {"name": "python", "version": "3"}, "packages": [{"name": "numpy"}]},
    "problem": {"error_type": "E", "summary": "s" * 20, "raw_logs": "l"}, "effort": {"failed_attempts": 3, "wall_time_seconds": 1.5, "measured": True},
    "solution": {"root_cause": "r" * 10, "steps": ["abc"], "shell_commands_executed": [], "code_patches": [], "verification_method": {"type": "none", "description": "abc"}},
}
OUTCOME = {"protocol_version": "1.0", "solution_id": ID, "outcome": "worked", "agent_info": AGENT}
RECORD = {"role": "aided", "error": "e" * 8, "effort": {"turns": 1}, "trail_id": ID}


def but(document: dict, path: str, value) -> str:
    """The document with another value at a path; without it for None."""
    found = json.loads(json.dumps(document))
    *parents, last = [int(p) if p.isdigit() else p for p in path.split("/")]
    own = found
    for p in parents:
        own = own[p]
    if value is None:
        del own[last]
    else:
        own[last] = value
    return json.dumps(found)


CASES = [
    ("TRAIL", json.dumps(TRAIL), []), ("OUTCOME", json.dumps(OUTCOME), []), ("EFFORT_RECORD", json.dumps(RECORD), []), ("OUTCOME", None, None), ("OUTCOME", "{", [("", "must be JSON")]), ("OUTCOME", "[1]", [("", "must be object")]), ("TRAIL", "null", [("", "must be object")]),
    ("TRAIL", but(TRAIL, "tags", ["a", "a", "A"]), [("/tags", "must not repeat items"), ("/tags/2", "must match ^[a-z0-9][a-z0-9._+-]{0,63}$")]),
    ("TRAIL", but(TRAIL, "effort/failed_attempts", 1.5), [("/effort/failed_attempts", "must be integer")]), ("TRAIL", but(TRAIL, "effort/measured", "yes"), [("/effort/measured", "must be boolean")]),
    ("TRAIL", but(TRAIL, "solution/steps", []), [("/solution/steps", "must have at least 1 items")]), ("TRAIL", but(TRAIL, "problem/raw_logs", None), [("/problem/raw_logs", "is required")]), ("TRAIL", but(TRAIL, "environment/os", 7), [("/environment/os", "must be string")]),
    ("OUTCOME", json.dumps(OUTCOME | {"a~/b": 1}), [("/a~0~1b", "is not a field of the format")]), ("OUTCOME", but(OUTCOME, "agent_info/model", ""), [("/agent_info/model", "must be at least 1 characters")]), ("EFFORT_RECORD", but(RECORD, "trail_id", None), [("/trail_id", "is required")]),
]


@pytest.mark.parametrize("spec", ["TRAIL", "OUTCOME", "EFFORT_RECORD"])
def test_issues(spark, spec):
    own = [(i, text, found) for i, (name, text, found) in enumerate(CASES) if name == spec]
    rows = spark.createDataFrame([c[:2] for c in own], "id int, text string").select("id", schema.validate(F.col("text"), getattr(schema, spec)).alias("issues")).collect()
    assert {r.id: r.issues and [tuple(x) for x in r.issues] for r in rows} == {i: found for i, _, found in own}


@pytest.mark.parametrize("spec", ["TRAIL", "OUTCOME", "EFFORT_RECORD"])
def test_documents_are_parsed_once(spark, spec):
    plan = spark.createDataFrame([("{}",)], "text string").select(schema.validate(F.col("text"), getattr(schema, spec)).alias("issues"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json") == 1
