"""Versions and package names, as column expressions. Null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what of a version counts.
VERSION = r"^[\s^~=<>!vV]*([0-9]+)(?:\.([0-9]+))?"


def _number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=[0-9])", "")


def major_of(version: Column) -> Column:
    """The major, or major.minor while the major is 0; null without a number."""
    major, minor = _number(F.regexp_extract(version, VERSION, 1)), _number(F.regexp_extract(version, VERSION, 2))
    return F.when((major == "0") & (minor != ""), F.concat(F.lit("0."), minor)).when(major != "", major)


def package_mismatches(mine: Column, trail: Column) -> Column:
    """Of array<struct<name, version>>: mine whose first versioned namesake in trail has another major, in my order."""

    def one(m: Column) -> Column:
        same = F.filter(trail, lambda p: (F.lower(p["name"]) == F.lower(m["name"])) & major_of(p["version"]).isNotNull())
        named = F.try_element_at(same, F.lit(1))
        return F.when((m["name"] != "") & (major_of(named["version"]) != major_of(m["version"])), F.struct(m["name"].alias("name"), m["version"].alias("yours"), named["version"].alias("trail")))

    return F.coalesce(F.filter(F.transform(mine, one), lambda x: x.isNotNull()), F.array().cast("array<struct<name:string,yours:string,trail:string>>"))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def parse_package(spec: Column) -> Column:
    """name==version or name@version, parted at the last separator, == before @; without one, the version is null."""
    by = lambda sep: F.struct(F.regexp_extract(spec, f"(?s)^(.+){sep}(.*)$", 1).alias("name"), F.regexp_extract(spec, f"(?s)^(.+){sep}(.*)$", 2).alias("version"))
    plain = F.struct(spec.alias("name"), F.lit(None).cast("string").alias("version"))
    return F.when(spec.rlike("(?s)^.+==.*$"), by("==")).when(spec.rlike("(?s)^.+@.*$"), by("@")).when(spec.isNotNull(), plain)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by numeric parts between . + and -; missing and other parts are 0."""
    parts = lambda v: F.transform(F.split(v, "[.+-]"), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0)))
    signs = F.zip_with(parts(a), parts(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    found = F.coalesce(F.try_element_at(F.filter(signs, lambda s: s != 0), F.lit(1)), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), found)


# Names that runtimes go by.
RUNTIMES = {
    "node": ["node", "nodejs", "node.js"],
    "python": ["python", "python3", "py", "cpython"],
    "go": ["go", "golang"],
    "dotnet": ["dotnet", ".net", "netcore"],
    "java": ["java", "jvm", "openjdk"],
    "cpp": ["cpp", "c++"],
}


def canonical_runtime(name: Column) -> Column:
    aliases = F.create_map(*(F.lit(x) for to, names in RUNTIMES.items() for n in names for x in (n, to)))
    low = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(aliases, low), low)
