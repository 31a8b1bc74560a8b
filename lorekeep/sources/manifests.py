"""What a project declares in its own files: packages with versions, and the runtime. Arrays and regular expressions only.

files: project, file (name below the project's folder), text. A project has at most one row a known file, so what is
gathered for it is bounded. What cannot be parsed is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import normal_name

# Files that are read, in order, and the shapes of what they say.
REQUIREMENTS = ("requirements.txt", "requirements-dev.txt", "requirements/base.txt", "requirements/prod.txt")
NODE_FIELDS = ("dependencies", "devDependencies", "optionalDependencies")
LOCKS = ("poetry.lock", "uv.lock")
PYTHON_MARKS = ("pyproject.toml", "requirements.txt", "Pipfile", "setup.py")
VERSION_FILES = (".nvmrc", ".node-version", ".python-version")
KNOWN = tuple(dict.fromkeys(("package.json", "package-lock.json", *REQUIREMENTS, *PYTHON_MARKS, *LOCKS, *VERSION_FILES)))
NOT_REGISTRY = r"(?i)^(workspace:|file:|link:|portal:|git|github:|https?:|npm:)|[\\/]"
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:(===?|~=)\s*([A-Za-z0-9.*+!_-]+))?"
PROJECT_LIST = r"(?ms)^\[project\].*?^dependencies\s*=\s*\[(.*?)^\]"
POETRY_TABLE = r"(?ms)^\[tool\.poetry\.dependencies\]\s*$(.*?)(?=^\[|\z)"
POETRY_ENTRY = r'(?m)^([A-Za-z0-9][A-Za-z0-9._-]*)\s*=\s*(?:"([^"]*)"|\{[^}]*version\s*=\s*"([^"]*)"[^}]*\})'
LOCKED_BLOCK = r"\n\[\[package\]\][ \t\r]*(?=\n|\z)"
LOCKED_NAME, LOCKED_VERSION = (rf'(?m)^{field}\s*=\s*"([^"]+)"' for field in ("name", "version"))
MOST = 30

_PAIR = "struct<name:string,version:string>"


def _pair(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _empty() -> Column:
    return F.array().cast(f"array<{_PAIR}>")


def requirement(line: Column) -> Column:
    """`numpy[extra]==1.24.4 ; marker # note` -> (numpy, 1.24.4); only pins give a version; null for what names no package."""
    spec = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"[#;].*$", ""), r"^\s+|\s+$", ""), r"\r$", ""))
    outside = F.regexp_replace(spec, r"\[[^\]]*\]", "")
    pin = F.regexp_extract(spec, REQUIREMENT, 3)
    good = (spec != "") & ~F.startswith(spec, F.lit("-")) & ~outside.rlike(r"[\\/@]|://") & spec.rlike(REQUIREMENT)
    version = F.when((pin != "") & ~F.contains(pin, F.lit("*")), pin)
    return F.when(good, _pair(F.regexp_extract(spec, REQUIREMENT, 1), version))


def _some(found: Column) -> Column:
    return F.coalesce(F.filter(found, lambda p: p.isNotNull()), _empty())


def _node(text: Column, lock: Column, scoped: bool) -> Column:
    manifest = F.from_json(text, f"name string, {', '.join(f'{n} map<string,string>' for n in NODE_FIELDS)}")
    locked = F.from_json(lock, "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")

    def one(e: Column) -> Column:
        spec = F.trim(e["value"])
        installed = F.coalesce(F.try_element_at(locked["packages"], F.concat(F.lit("node_modules/"), e["key"]))["version"], F.try_element_at(locked["dependencies"], e["key"])["version"])
        own = F.coalesce(e["key"] == manifest["name"], F.lit(False))
        good = spec.isNotNull() & ~own & ~spec.rlike(NOT_REGISTRY) & (F.lit(scoped) | ~F.startswith(e["key"], F.lit("@")))
        return F.when(good, _pair(e["key"], F.coalesce(installed, spec)))

    return F.concat(*(_some(F.transform(F.map_entries(manifest[n]), one)) for n in NODE_FIELDS))


def _pyproject(text: Column) -> Column:
    listed = F.transform(F.regexp_extract_all(F.regexp_extract(text, PROJECT_LIST, 1), F.lit('"([^"]+)"'), F.lit(1)), requirement)
    entries = F.regexp_extract_all(F.regexp_extract(text, POETRY_TABLE, 1), F.lit(POETRY_ENTRY), F.lit(0))

    def one(e: Column) -> Column:
        name = F.regexp_extract(e, POETRY_ENTRY, 1)
        spec = F.trim(F.concat(F.regexp_extract(e, POETRY_ENTRY, 2), F.regexp_extract(e, POETRY_ENTRY, 3)))
        return F.when(F.lower(name) != "python", _pair(name, F.when((spec != "") & ~spec.rlike(NOT_REGISTRY), spec)))

    return F.concat(_some(listed), _some(F.transform(entries, one)))


def _locked(text: Column) -> Column:
    """array of (normal name, version) of the packages of a lock file."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), LOCKED_BLOCK)
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    one = lambda b: _pair(normal_name(F.regexp_extract(b, LOCKED_NAME, 1)), F.regexp_extract(b, LOCKED_VERSION, 1))
    return F.filter(F.transform(blocks, one), lambda p: (p["name"] != "") & (p["version"] != ""))


def _by_project(files: DataFrame) -> DataFrame:
    return files.where(F.col("file").isin(*KNOWN)).groupBy("project").agg(*(F.max(F.when(F.col("file") == n, F.col("text"))).alias(n) for n in KNOWN))


def _file(name: str) -> Column:
    return F.col(f"`{name}`")


def packages(files: DataFrame, query: Column | None = None, most: int = MOST, scoped: bool = False, only_named: bool = False) -> DataFrame:
    """project, packages array<struct<name, version>>: Node's, then Python's, the first of a name; those the text names come first."""
    lines = lambda n: F.transform(F.split(F.coalesce(_file(n), F.lit("")), "\n"), requirement)
    python = F.concat(*(_some(lines(n)) for n in REQUIREMENTS), F.coalesce(_pyproject(_file("pyproject.toml")), _empty()))
    locks = F.concat(_locked(_file("uv.lock")), F.reverse(_locked(_file("poetry.lock"))))  # the first of a name counts: uv.lock's
    pinned = lambda p: F.try_element_at(F.filter(F.col("locks"), lambda x: x["name"] == normal_name(p["name"])), F.lit(1))["version"]
    rows = _by_project(files).withColumns({"python": python, "locks": locks})
    node = F.coalesce(_node(_file("package.json"), _file("package-lock.json"), scoped), _empty())
    every = F.concat(node, F.transform("python", lambda p: _pair(p["name"], F.coalesce(pinned(p), p["version"]))))
    rows = rows.withColumn("every", every).withColumn("keys", F.transform("every", lambda p: normal_name(p["name"])))
    rows = rows.withColumn("first", F.filter("every", lambda p, i: F.array_position(F.col("keys"), normal_name(p["name"])) == i + 1))
    said = F.lower(query) if query is not None else F.lit("")
    named = lambda p: (said != "") & F.regexp_like(said, F.concat(F.lit(r"(^|[^a-z0-9._@/-])\Q"), F.lower(p["name"]), F.lit(r"\E($|[^a-z0-9._-])")))
    there = F.filter("first", named)
    ordered = there if only_named else F.concat(there, F.filter("first", lambda p: ~named(p)))
    return rows.select("project", F.slice(ordered, 1, most).alias("packages"))


def runtimes(files: DataFrame) -> DataFrame:
    """project, runtime struct<name, version>: node or python, null where both or neither is there; a version only if pinned."""
    first = lambda n: F.regexp_replace(F.trim(F.regexp_replace(F.substring_index(_file(n), "\n", 1), r"\s+$", "")), "(?i)^v", "")
    version = lambda n: F.when(first(n).rlike(r"^[0-9]+\.[0-9]+(\.[0-9]+)?\z"), first(n))
    node = _file("package.json").isNotNull()
    python = F.coalesce(*(_file(n) for n in PYTHON_MARKS)).isNotNull()
    found = F.when(node & ~python, _pair(F.lit("node"), F.coalesce(version(".nvmrc"), version(".node-version")))).when(python & ~node, _pair(F.lit("python"), version(".python-version")))
    return _by_project(files).select("project", found.alias("runtime"))
