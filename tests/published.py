"""The published examples of the formats: inputs go through the operators, SQL has the expected values."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import error_keys, names, redaction, versions
from lorekeep.sources import manifests

_PAIRS = "array<struct<name:string,version:string>>"


@cache
def examples(name: str):
    return json.loads((Path(__file__).parent / "vectors" / f"{name}.json").read_text(encoding="utf-8"))


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(columns: list[str], rows: list[tuple]) -> str:
    """SQL that gives these rows."""
    body = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(columns)})"


def _numbered(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")


def _spelled(pairs) -> str:
    return ";".join(f"{p['name']}@{p['version'] if p['version'] is not None else '?'}" for p in pairs)


def _spell(pairs) -> F.Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("@"), F.coalesce(p["version"], F.lit("?")))), ";")


def published_message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, [(r["message"],) for r in examples("message_keys")], "message string")
    return rows.select("i", error_keys.normalize(F.col("message")).alias("normalized"), error_keys.fp2(F.col("message")).alias("fingerprint"))


def published_typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, [(r["runtime"], r["error_type"], r["message"]) for r in examples("typed_keys")], "runtime string, error_type string, message string")
    kind, text = F.col("error_type"), F.col("message")
    return rows.select("i", error_keys.normalize_typed(kind, text).alias("normalized"), error_keys.fp1(F.col("runtime"), kind, text).alias("fingerprint"))


def published_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output, what redacting it again gives, and the counts by kind."""
    rows = _numbered(spark, [(r["input"],) for r in examples("redaction")], "input string").withColumn("r", redaction.redact(F.col("input")))
    rows = rows.withColumn("again", redaction.redact(F.col("r.text"))["text"])
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("r.kinds")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.select("i", F.col("r.text").alias("output"), "again", kinds.alias("kinds"))


def published_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, [(r["text"],) for r in examples("names")["names"]], "text string")
    return rows.select("i", F.array_join(names.placeholder_names(F.col("text")), ";").alias("names"))


def published_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, [(r["query"], r["message"]) for r in examples("names")["conflicts"]], "query string, message string")
    return rows.select("i", names.names_conflict(names.placeholder_names(F.col("query")), names.placeholder_names(F.col("message"))).alias("conflict"))


def published_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, [(None if r["version"] is None else str(r["version"]),) for r in examples("versions")["major"]], "version string")
    return rows.select("i", versions.major_of(F.col("version")).alias("major"))


def published_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda r, side: None if r[side] is None else [(p.get("name"), p.get("version")) for p in r[side]]
    rows = _numbered(spark, [(pairs(r, "yours"), pairs(r, "trail")) for r in examples("versions")["mismatch"]], f"yours {_PAIRS}, trail {_PAIRS}")
    found = versions.package_mismatches(F.col("yours"), F.col("trail"))
    return rows.select("i", F.array_join(F.transform(found, lambda p: F.concat_ws("@", p["name"], p["yours"], p["trail"])), ";").alias("mismatches"))


def _files(spark: SparkSession, cases: list[dict]) -> DataFrame:
    rows = [(str(i), name, text if isinstance(text, str) else json.dumps(text)) for i, r in enumerate(cases) for name, text in r["files"].items()]
    return spark.createDataFrame(rows, "project string, file string, text string")


def published_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases are read together where their options are the same."""
    cases = examples("packages")["packages"]
    out = None
    for options in {json.dumps(r["options"], sort_keys=True) for r in cases}:
        own, said = [str(i) for i, r in enumerate(cases) if json.dumps(r["options"], sort_keys=True) == options], json.loads(options)
        found = manifests.packages(_files(spark, cases).where(F.col("project").isin(own)), F.lit(said["query"]) if said.get("query") else None, said.get("max", manifests.MOST), bool(said.get("scoped")), bool(said.get("onlyNamed")))
        out = found if out is None else out.unionByName(found)
    every = spark.createDataFrame([(str(i),) for i in range(len(cases))], "project string")  # a project without known files has no packages
    return every.join(out, "project", "left").select(F.col("project").cast("int").alias("i"), F.coalesce(_spell(F.col("packages")), F.lit("")).alias("packages"))


def published_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = examples("packages")["runtime"]
    every = spark.createDataFrame([(str(i),) for i in range(len(cases))], "project string")
    r = F.col("runtime")
    spelled = F.when(r.isNotNull(), F.concat(r["name"], F.lit("@"), F.coalesce(r["version"], F.lit("?"))))
    return every.join(manifests.runtimes(_files(spark, cases)), "project", "left").select(F.col("project").cast("int").alias("i"), spelled.alias("runtime"))


QUERIES = {f.__name__: f for f in (published_message_keys, published_typed_keys, published_redaction, published_names, published_conflicts, published_majors, published_mismatches, published_packages, published_runtimes)}


def _runtime(r) -> str | None:
    return None if r is None else f"{r['name']}@{r.get('version') or '?'}"


SQL = {
    "published_message_keys": values(["i", "normalized", "fingerprint"], [(i, r["normalized"], r["fingerprint"]) for i, r in enumerate(examples("message_keys"))]),
    "published_typed_keys": values(["i", "normalized", "fingerprint"], [(i, r["normalized"], r["fingerprint"]) for i, r in enumerate(examples("typed_keys"))]),
    "published_redaction": values(["i", "output", "again", "kinds"], [(i, r["output"], r["output"], ";".join(f"{k}={n}" for k, n in sorted(r["kinds"].items()))) for i, r in enumerate(examples("redaction"))]),
    "published_names": values(["i", "names"], [(i, ";".join(sorted(r["names"]))) for i, r in enumerate(examples("names")["names"])]),
    "published_conflicts": values(["i", "conflict"], [(i, r["conflict"]) for i, r in enumerate(examples("names")["conflicts"])]),
    "published_majors": values(["i", "major"], [(i, r["major"]) for i, r in enumerate(examples("versions")["major"])]),
    "published_mismatches": values(["i", "mismatches"], [(i, ";".join(f"{p['name']}@{p['yours']}@{p['trail']}" for p in r["expected"])) for i, r in enumerate(examples("versions")["mismatch"])]),
    "published_packages": values(["i", "packages"], [(i, _spelled({"name": p["name"], "version": p.get("version")} for p in r["expected"])) for i, r in enumerate(examples("packages")["packages"])]),
    "published_runtimes": values(["i", "runtime"], [(i, _runtime(r["expected"])) for i, r in enumerate(examples("packages")["runtime"])]),
}
