"""The write path: assembly of an entry from a session, defaults, gate, risk, merging, verdicts, and pages of the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import canonical_runtime

PAGE = 50
SUMMARY_CHARS = 20
LOGS_CHARS = 16_000
PROTOCOL = "1.0"
NO_LOGS = "(none provided)"

#: Our own rule table: which commands carry which risk (flag, level, pattern).
RISKS = [
    ("pipe_to_shell", "high", r"(?:curl|wget)\b[^|;&]*\|\s*(?:sudo\s+)?(?:ba|z|da)?sh\b"),
    ("recursive_delete", "high", r"\brm\s+(?:-[a-zA-Z]*\s+)*-[a-zA-Z]*(?:r[a-zA-Z]*f|f[a-zA-Z]*r)"),
    ("credential_access", "high", r"\.ssh/id_|\.aws/credentials|\.netrc\b|/etc/shadow\b"),
    ("obfuscation", "high", r"base64\s+(?:-d|--decode)\b[^|;&]*\|\s*(?:ba|z|da)?sh\b|\beval\s+[\"'$(]"),
    ("privilege_escalation", "medium", r"\bsudo\b|\bsu\s+-|\bchmod\s+[0-7]*[4-7][0-7]{3}\b"),
    ("open_permissions", "medium", r"\bchmod\s+(?:-R\s+)?0?777\b"),
]


def feed_page(rows: DataFrame, sort: str, key: str, after: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """The next rows by sort (largest first), then key, after the one row in after: a keyset page, no offset is counted."""
    if after is not None:
        last = after.select(F.col(sort).alias("last_sort"), F.col(key).alias("last_key"))  # one row
        later = (F.col(sort) < F.col("last_sort")) | ((F.col(sort) == F.col("last_sort")) & (F.col(key) > F.col("last_key")))
        rows = rows.join(F.broadcast(last), later).drop("last_sort", "last_key")
    return rows.orderBy(F.desc(sort), F.asc(key)).limit(min(size, PAGE))


#: What a feed may be sorted by, largest first, and the column that says it.
SORTS = {"strength": "strength", "recent": "last_success_at", "followed": "followed", "new": "created_at"}


def feed(entries: DataFrame, sort: str, key: str = "entry_id", runtime: str | None = None, category: str | None = None, after: DataFrame | None = None, size: int = PAGE) -> DataFrame:
    """A page of the feed: strongest, last confirmed, most followed (whatever came of it) or newest first; of one runtime by any of its
    names, and of one category. entries: key, strength, last_success_at, created_at, worked, partially_worked, failed[, runtime, category]."""
    counts = [F.coalesce(c, F.lit(0)) for c in ("worked", "partially_worked", "failed")]
    rows = entries.withColumn("followed", counts[0] + counts[1] + counts[2])
    if runtime is not None:
        rows = rows.where(canonical_runtime(F.col("runtime")) == canonical_runtime(F.lit(runtime)))
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return feed_page(rows, SORTS[sort], key, after, size)


def assembled(steps: DataFrame, least_failures: int = 1) -> DataFrame:
    """Per session: the last failure is the error, the first a dead end, the last fix the solution; ready if both are there.

    steps: session, pos, kind (failure, fix or other), text. Only first and last are kept while grouping, so a session of
    any length is a bounded state."""
    failure, fix = F.col("kind") == "failure", F.col("kind") == "fix"
    found = steps.groupBy("session").agg(
        F.count("*").alias("turns"), F.count_if(failure).alias("failures"),
        F.max_by(F.when(failure, F.col("text")), F.when(failure, F.col("pos"))).alias("error"), F.min_by(F.when(failure, F.col("text")), F.when(failure, F.col("pos"))).alias("first_try"),
        F.max_by(F.when(fix, F.col("text")), F.when(fix, F.col("pos"))).alias("fix"),
    )
    ready = F.col("fix").isNotNull() & (F.col("failures") >= least_failures)
    return found.withColumns({"error_message": F.substring("error", 1, 1000), "ready": ready, "summary": F.rpad(F.substring("error", 1, 280), F.greatest(F.length(F.substring("error", 1, 280)), F.lit(SUMMARY_CHARS)), ".")})


#: Fixed values of the format: characters of what was tried, and dead ends of one entry.
APPROACH_CHARS, MOST_DEAD_ENDS = 500, 20


def dead_ends(steps: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """session, n (from 1), approach, why_it_failed: all that did not work in a session, in order: each failure but the last, which is the
    problem itself, then each entry that was followed and did not help, or only partly.

    steps: session, pos, kind (failure, fix or other), approach, text (the failure's message); tried: session, pos, entry_id, outcome,
    notes. A row for each, so a session of any length is only sorted."""
    order = Window.partitionBy("session").orderBy("pos")
    failures = steps.where("kind = 'failure'").withColumn("next", F.lead("pos").over(order)).where("next IS NOT NULL")
    rows = failures.select("session", F.lit(0).alias("part"), "pos", F.substring(F.coalesce("approach", F.lit("")), 1, APPROACH_CHARS).alias("approach"), F.coalesce("text", F.lit("")).alias("why_it_failed"))
    if tried is not None:
        plain = F.when(F.col("outcome") == "failed", "it did not work in this environment").otherwise("it only partly worked")
        why = F.substring(F.coalesce(F.nullif("notes", F.lit("")), plain), 1, APPROACH_CHARS)
        followed = tried.where(F.col("outcome").isin("failed", "partially_worked"))
        rows = rows.unionByName(followed.select("session", F.lit(1).alias("part"), "pos", F.concat(F.lit("Followed entry "), F.col("entry_id").cast("string")).alias("approach"), why.alias("why_it_failed")))
    n = F.row_number().over(Window.partitionBy("session").orderBy("part", "pos"))
    return rows.select("session", n.alias("n"), "approach", "why_it_failed")


def with_dead_ends(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries by session with failed_approaches: the first of their dead ends, as many as the format takes."""
    own = found.where(f"n <= {MOST_DEAD_ENDS}").groupBy("session").agg(F.sort_array(F.collect_list(F.struct("n", "approach", "why_it_failed"))).alias("found"))
    listed = F.transform(F.coalesce("found", F.array()), lambda x: F.struct(x["approach"].alias("approach"), x["why_it_failed"].alias("why_it_failed")))
    return entries.join(own, "session", "left").withColumn("failed_approaches", F.coalesce(listed, F.array().cast("array<struct<approach:string,why_it_failed:string>>"))).drop("found")


def gate(failures: Column, verified: Column, covered: Column, least: int = 1) -> Column:
    """Whether a draft may be offered: enough failed attempts, verified, and no entry that works covers it."""
    return (failures >= least) & F.coalesce(verified, F.lit(False)) & ~F.coalesce(covered, F.lit(False))


def with_defaults(entries: DataFrame) -> DataFrame:
    """protocol_version, kind and raw_logs where they are missing; the tail of logs that are too long, where errors stand."""
    logs = F.when(F.length("raw_logs") > LOGS_CHARS, F.substring(F.col("raw_logs"), -LOGS_CHARS, LOGS_CHARS)).otherwise(F.coalesce("raw_logs", F.lit(NO_LOGS)))
    return entries.withColumns({"protocol_version": F.coalesce("protocol_version", F.lit(PROTOCOL)), "kind": F.coalesce("kind", F.lit("fix")), "raw_logs": logs})


def risk_flags(command: Column) -> Column:
    """array<struct<flag, level>> of a command by our rule table."""
    found = F.array(*(F.when(command.rlike(p), F.struct(F.lit(flag).alias("flag"), F.lit(level).alias("level"))) for flag, level, p in RISKS))
    return F.filter(found, lambda x: x.isNotNull())


def risk_level(commands: Column) -> Column:
    """The highest level over an array of commands: low, medium or high."""
    levels = F.flatten(F.transform(commands, lambda c: F.transform(risk_flags(c), lambda f: f["level"])))
    return F.when(F.array_contains(levels, "high"), "high").when(F.array_contains(levels, "medium"), "medium").otherwise("low")


def merged(entries: DataFrame) -> DataFrame:
    """entries: entry_id, same (a digest of what makes two entries one); per group, the first id and how many."""
    return entries.groupBy("same").agg(F.min("entry_id").alias("merged_into"), F.count("*").alias("entries"))


def verdict(valid: Column, sensitive: Column, judged: Column, good: Column, merged_into: Column | None = None) -> list[Column]:
    """status and reason. What only a closed model could judge stays queued."""
    bad, unknown = F.coalesce(sensitive, F.lit(False)), ~F.coalesce(judged, F.lit(False))
    status = F.when(~valid | bad, "rejected")
    reason = F.when(~valid, "invalid_trail").when(bad, "sensitive_content")
    if merged_into is not None:
        status = status.when(merged_into.isNotNull(), "merged")
    status = status.when(unknown, "queued").when(good, "indexed").otherwise("rejected")
    return [status.alias("status"), reason.when(~unknown & ~good, "low_quality").alias("reason")]


def allowed_kind(kind: Column, private: bool) -> Column:
    """Procedures and facts are taken by private stores only."""
    return F.lit(private) | ~kind.isin("procedure", "fact")


def review_due(review_after: Column, as_of: Column) -> Column:
    """Whether the day asked for has come; days that do not exist are no days."""
    return F.coalesce(F.to_date(F.try_to_timestamp(review_after, F.lit("yyyy-MM-dd"))) <= F.to_date(as_of), F.lit(False))


def all_pages(pages: DataFrame, key: str, most: int = 2_000) -> DataFrame:
    """What a reader has after paging: the first row of each key, at most so many. pages: rows with page and place in it."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("page", "place"))
    return pages.withColumn("seen", first).where("seen = 1").drop("seen").orderBy("page", "place").limit(most)


DECLARED = "profile string, effort boolean, task_search boolean, keep_personal boolean, worklog_scopes array<string>, people_detail string, holdout_percent int"


def declared(text: Column) -> Column:
    """What a colony declares about itself, field by field of its type or its default; null without a known profile."""
    raw = F.from_json(text, "map<string,string>")
    value = lambda name: F.try_element_at(raw, F.lit(name))
    true = lambda name: F.coalesce(value(name) == "true", F.lit(False)) & F.coalesce(F.get_json_object(text, f"$.{name}") == "true", F.lit(False)) & ~text.rlike(f'"{name}"\\s*:\\s*"')
    scopes = F.filter(F.try_variant_get(F.try_parse_json(text), "$.worklog_scopes", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    percent = F.when(~text.rlike(r'"holdout_percent"\s*:\s*"') & value("holdout_percent").rlike(r"^[0-9]{1,2}(?:\.0+)?\z"), value("holdout_percent").try_cast("double").cast("int"))
    detail = value("people_detail")
    found = F.struct(
        value("profile").alias("profile"), true("effort").alias("effort"), true("task_search").alias("task_search"), true("keep_personal").alias("keep_personal"),
        F.coalesce(F.slice(F.transform(scopes, lambda v: v.cast("string")), 1, 50), F.array().cast("array<string>")).alias("worklog_scopes"),
        F.when(detail.isin("named", "aggregate"), detail).alias("people_detail"), F.when(percent <= 20, percent).otherwise(0).alias("holdout_percent"),
    )
    return F.when(value("profile").isin("public", "organisation"), found)
