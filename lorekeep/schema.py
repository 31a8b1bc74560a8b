"""The document formats: what their fields may hold, the Spark schemas, and validation compiled to column expressions.

A document is JSON text. It is parsed to a VARIANT, so that types and unknown fields are seen as written, and each rule is
an expression over it: no Python runs per row. The issues of a document come as array<struct<path, message>>, with JSON
pointers, in the order of the fields below.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.lines import once


@dataclass(frozen=True)
class Spec:
    kind: str
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    never: str | None = None
    one_of: tuple[str, ...] = ()
    fields: dict[str, Spec] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    item: Spec | None = None
    unique: bool = False
    closed: bool = True


def text(least=None, most=None, pattern=None, never=None) -> Spec:
    return Spec("string", least, most, pattern, never)


def one_of(*values: str) -> Spec:
    return Spec("string", one_of=values)


def whole(least=None, most=None) -> Spec:
    return Spec("integer", least, most)


def record(required: str = "", closed: bool = True, **fields: Spec) -> Spec:
    return Spec("object", fields=fields, required=tuple(required.split()), closed=closed)


def many(item: Spec, least=None, most=None, unique=False) -> Spec:
    return Spec("array", least, most, item=item, unique=unique)


# Fixed values of the formats: fields, lengths in code points, patterns and enumerations.
_HEX_ID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
SLUG = text(pattern=r"^[a-z0-9][a-z0-9._+-]{0,63}$")
VERSION = text(pattern=r"^1\.[0-9]+$")
CATEGORY = one_of("dependency", "build", "runtime", "configuration", "network", "authentication", "permissions", "api_contract", "data", "concurrency", "tooling", "platform", "other")
AGENT = record(
    "model framework",
    model=text(1, 128), framework=text(1, 64), framework_version=text(most=64), agent_id=text(pattern="^[A-Za-z0-9_-]{8,64}$"), sdk_version=text(most=32),
)
PACKAGE = record(
    "name",
    name=text(1, 128), version=text(most=64),
    ecosystem=one_of("pypi", "npm", "cargo", "go", "maven", "nuget", "rubygems", "composer", "conda", "apt", "brew", "apk", "winget", "system", "other"),
)
ENVIRONMENT = record(
    "os runtime packages",
    os=one_of("linux", "macos", "windows", "freebsd", "other"), os_version=text(most=64), arch=one_of("x86_64", "arm64", "x86", "arm", "riscv64", "other"),
    container=one_of("none", "docker", "podman", "kubernetes", "wsl", "vm", "sandbox", "other"),
    runtime=record("name version", name=SLUG, version=text(1, 64)), packages=many(PACKAGE, most=50),
)
DEAD_END = record("approach why_it_failed", approach=text(1, 500), why_it_failed=text(1, 500))
PROBLEM = record(
    error_type=text(1, 128, r"^[^\x{0}-\x{1f}\x{7f}-\x{9f}\x{2028}\x{2029}<>]+$"), error_message=text(most=1000), summary=text(20, 1000), task_context=text(most=1000),
    raw_logs=text(1, 16000), category=CATEGORY, failed_approaches=many(DEAD_END, most=20),
)
COMMAND = record(
    "command purpose",
    command=text(1, 2000), purpose=text(3, 500), shell=one_of("bash", "sh", "zsh", "fish", "powershell", "cmd", "other"), requires_elevation=Spec("boolean"), exit_code=whole(),
)
PATCH = record("file_path diff", file_path=text(1, 512, never=r"^(/|[A-Za-z]:[\\/]|~)"), language=SLUG, description=text(most=500), diff=text(1, 20000))
CHECK = record(
    "type description",
    type=one_of("test_suite", "command_exit_zero", "rerun_task", "http_check", "build_success", "manual_inspection", "none"), description=text(3, 1000), command=text(most=2000), evidence=text(most=2000),
)
SOLUTION = record(
    root_cause=text(10, 2000), steps=many(text(3, 1000), 1, 30), shell_commands_executed=many(COMMAND, most=50), code_patches=many(PATCH, most=20), verification_method=CHECK,
)
_TOKENS = {k: whole(0, 10_000_000) for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")}
EFFORT = record("failed_attempts", failed_attempts=whole(0, 10_000), tokens_spent=whole(0), wall_time_seconds=Spec("number", 0), **_TOKENS, turns=whole(0, 10_000), measured=Spec("boolean"))
TRAIL = record(
    "protocol_version agent_info problem solution",
    kind=one_of("fix", "procedure", "fact"), review_after=text(pattern=r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"),
    source=record("type", type=one_of("agent", "handover", "document", "person"), ref=text(most=500), revision=text(most=80)),
    protocol_version=VERSION, agent_info=AGENT, environment=ENVIRONMENT, problem=PROBLEM, solution=SOLUTION, effort=EFFORT, tags=many(SLUG, most=10, unique=True),
)
OUTCOME = record(
    "protocol_version solution_id outcome agent_info",
    protocol_version=VERSION, solution_id=text(pattern=f"^{_HEX_ID}$"), outcome=one_of("worked", "partially_worked", "failed", "not_applicable"), agent_info=AGENT, environment=ENVIRONMENT, notes=text(most=1000),
)
EFFORT_RECORD = record(
    "role error effort",
    protocol_version=VERSION, role=one_of("unaided", "aided"), error=text(8, 2000), trail_id=text(pattern=f"(?i)^{_HEX_ID}$"),
    effort=record(**_TOKENS, turns=whole(0, 10_000), wall_time_seconds=whole(0, 86_400)), agent_info=AGENT,
)
#: What an entry needs besides, by kind: of itself, its problem and its solution.
NEEDED = {
    "fix": (("environment", "effort"), ("error_type", "summary", "raw_logs"), ("root_cause", "steps", "shell_commands_executed", "code_patches", "verification_method")),
    "knowledge": ((), ("summary", "task_context"), ("steps",)),
}
CONTEXT_LEAST = 10

_ISSUES = "array<struct<path:string,message:string>>"
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def _issue(broken: Column, path: Column, message: str) -> Column:
    one = F.array(F.struct(path.alias("path"), F.lit(message).alias("message")))
    return F.when(broken, one).otherwise(F.array().cast(_ISSUES)).cast(_ISSUES)


def _all(*found: Column) -> Column:
    return F.concat(*found) if found else F.array().cast(_ISSUES)


def _pointer(path: Column, key: Column | str) -> Column:
    key = F.lit(key) if isinstance(key, str) else F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(path, F.lit("/"), key)


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    seen = F.schema_of_variant(v)
    if kind in ("integer", "number"):
        number = seen.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        value = F.try_variant_get(v, "$", "double")
        return number & ((value == F.floor(value)) if kind == "integer" else F.lit(True))
    return F.startswith(seen, F.lit(_KINDS[kind]))


def _missing(keys: Column, names: tuple[str, ...], path: Column) -> list[Column]:
    return [_issue(~F.array_contains(keys, n), _pointer(path, n), "is required") for n in names]


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


#: As what a value is read whose rules are several.
_READ = {"string": "string", "boolean": "boolean", "integer": "double", "number": "double", "array": "array<variant>"}


def issues(v: Column, spec: Spec, path: Column) -> Column:
    """What is wrong with a variant that is there. The variant, the value read from it and an object's keys are read once."""

    def checked(v: Column) -> Column:
        if spec.kind == "object":
            found = once(_keys(v), lambda keys: _of_object(v, keys, spec, path))
        else:
            found = once(F.try_variant_get(v, "$", _READ[spec.kind]), lambda value: _of_value(value, spec, path))
        good = F.coalesce(_is(v, spec.kind), F.lit(False))
        return F.when(good, found).otherwise(_issue(F.lit(True), path, f"must be {spec.kind}"))

    return once(v, checked)


def _of_object(v: Column, keys: Column, spec: Spec, path: Column) -> Column:
    found = _missing(keys, spec.required, path)
    for name, own in spec.fields.items():
        there = F.array_contains(keys, name)
        found.append(F.when(there, issues(_get(v, name), own, _pointer(path, name))).otherwise(F.array().cast(_ISSUES)))
    if spec.closed:
        strange = F.array_except(keys, F.array(*map(F.lit, spec.fields)))
        found.append(F.transform(strange, lambda k: F.struct(_pointer(path, k).alias("path"), F.lit("is not a field of the format").alias("message"))))
    return _all(*found).cast(_ISSUES)


def _of_value(value: Column, spec: Spec, path: Column) -> Column:
    found: list[Column] = []
    if spec.kind == "string":
        if spec.one_of:
            found.append(_issue(~value.isin(*spec.one_of), path, f"must be one of {', '.join(spec.one_of)}"))
        if spec.least is not None:
            found.append(_issue(F.length(value) < spec.least, path, f"must be at least {spec.least} characters"))
        if spec.most is not None:
            found.append(_issue(F.length(value) > spec.most, path, f"must be at most {spec.most} characters"))
        if spec.pattern:
            found.append(_issue(~value.rlike(spec.pattern), path, f"must match {spec.pattern}"))
        if spec.never:
            found.append(_issue(value.rlike(spec.never), path, "is not allowed here"))
    elif spec.kind in ("integer", "number"):
        if spec.least is not None:
            found.append(_issue(value < spec.least, path, f"must be at least {spec.least}"))
        if spec.most is not None:
            found.append(_issue(value > spec.most, path, f"must be at most {spec.most}"))
    elif spec.kind == "array":
        if spec.least is not None:
            found.append(_issue(F.size(value) < spec.least, path, f"must have at least {spec.least} items"))
        if spec.most is not None:
            found.append(_issue(F.size(value) > spec.most, path, f"must have at most {spec.most} items"))
        if spec.unique:
            plain = F.transform(value, lambda x: F.to_json(x))
            found.append(_issue(F.size(F.array_distinct(plain)) < F.size(plain), path, "must not repeat items"))
        found.append(F.flatten(F.transform(value, lambda x, i: issues(x, spec.item, _pointer(path, i.cast("string"))))))
    return _all(*found).cast(_ISSUES)


def _by_kind(v: Column) -> Column:
    knowledge = F.coalesce(_get(v, "kind", "string").isin("procedure", "fact"), F.lit(False))

    def needs(kind: str) -> Column:
        own, problem, solution = NEEDED[kind]
        found = _missing(_keys(v), own, F.lit(""))
        for name, names in (("problem", problem), ("solution", solution)):
            part = _get(v, name)
            found += [F.when(part.isNotNull(), x).otherwise(F.array().cast(_ISSUES)) for x in _missing(_keys(part), names, F.lit(f"/{name}"))]
        return _all(*found)

    short = _issue(F.coalesce(F.length(F.try_variant_get(v, "$.problem.task_context", "string")) < CONTEXT_LEAST, F.lit(False)), F.lit("/problem/task_context"), f"must be at least {CONTEXT_LEAST} characters")
    return F.when(knowledge, F.concat(needs("knowledge"), short)).otherwise(needs("fix"))


def validate(document: Column, spec: Spec = TRAIL) -> Column:
    """The issues of a JSON document; text that is no JSON has one, null gives null."""

    def of_document(v: Column) -> Column:
        found = issues(v, spec, F.lit(""))
        if spec is TRAIL:
            found = F.when(F.coalesce(_is(v, "object"), F.lit(False)), F.concat(found, _by_kind(v))).otherwise(found)
        if spec is EFFORT_RECORD:
            found = F.concat(found, _issue(F.coalesce((_get(v, "role", "string") == "aided") & _get(v, "trail_id").isNull(), F.lit(False)), F.lit("/trail_id"), "is required"))
        return F.when(v.isNotNull(), found).when(document.isNotNull(), _issue(F.lit(True), F.lit(""), "must be JSON"))

    return once(F.try_parse_json(document), of_document)


def ddl(spec: Spec) -> str:
    """The Spark type of a format, for reading documents with an explicit schema."""
    if spec.kind == "object":
        return f"struct<{','.join(f'{n}:{ddl(s)}' for n, s in spec.fields.items())}>"
    if spec.kind == "array":
        return f"array<{ddl(spec.item)}>"
    return {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}[spec.kind]
