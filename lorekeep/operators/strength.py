"""Outcome counts and what follows from them: strength with decay, its course over time, scores and ratios.

as_of is always given, never the clock's time, so a query has one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published formula.
Z = 1.96
HALF_LIFE_DAYS = 90.0
#: Procedures and facts age more slowly.
HALF_LIFE_KNOWLEDGE = 365.0
DEFAULT_QUALITY = 0.7
TOKENS_CREDIT = 200_000
OUTCOMES = ("worked", "partially_worked", "failed", "not_applicable")


def days_between(now: Column, then: Column) -> Column:
    """Days, not below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 8.64e10)


def wilson_lower(successes: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of Wilson's interval, not below 0."""
    p = successes / n
    inner = F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), (p + z * z / (2 * n) - z * F.sqrt(inner)) / (1 + z * z / n))


def half_life(kind: Column) -> Column:
    return F.when(kind.isin("procedure", "fact"), HALF_LIFE_KNOWLEDGE).otherwise(HALF_LIFE_DAYS)


def strength(worked: Column, partial: Column, failed: Column, days: Column, quality: Column | None = None, confirmed: Column | None = None, half: Column | float = HALF_LIFE_DAYS) -> Column:
    """Two votes of the entry's quality are added to those counted; a person's confirmations count as successes."""
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(quality, F.lit(DEFAULT_QUALITY)) if quality is not None else F.lit(DEFAULT_QUALITY)))
    won = worked if confirmed is None else worked + confirmed
    n = (won + partial + failed + 2).cast("double")
    return wilson_lower(won + 0.5 * partial + 2 * q, n) * F.pow(F.lit(0.5), days / half)


def outcome_counts(reports: DataFrame, *keys: str) -> DataFrame:
    """worked, partially_worked, failed, not_applicable, followed and last_success by keys: one pass, one shuffle."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    found = reports.groupBy(*keys).agg(*counts, F.max(F.when(F.col("outcome") == "worked", F.col("at"))).alias("last_success"), F.min("at").alias("first_at"))
    return found.withColumn("followed", F.col("worked") + F.col("partially_worked") + F.col("failed"))


def strength_table(reports: DataFrame, as_of: Column, *keys: str, quality: Column | None = None) -> DataFrame:
    """outcome_counts with the strength at as_of; without a success, age counts from the first report."""
    days = days_between(as_of, F.coalesce("last_success", "first_at"))
    return outcome_counts(reports, *keys).withColumn("strength", strength(F.col("worked"), F.col("partially_worked"), F.col("failed"), days, quality))


def strength_curve(reports: DataFrame, key: str) -> DataFrame:
    """Strength at the end of each day on which there was a report, from counts and the last success so far."""
    days = reports.groupBy(key, F.date_trunc("day", "at").alias("day")).agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES[:3]), F.max(F.when(F.col("outcome") == "worked", F.col("at"))).alias("success"), F.min("at").alias("first_at")
    )
    so_far = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = days.select(key, "day", *(F.sum(o).over(so_far).alias(o) for o in OUTCOMES[:3]), F.last("success", ignorenulls=True).over(so_far).alias("success"), F.first("first_at").over(so_far).alias("first_at"))
    age = days_between(F.col("day") + F.expr("INTERVAL 1 DAY"), F.coalesce("success", "first_at"))
    return runs.select(key, "day", *OUTCOMES[:3], strength(F.col("worked"), F.col("partially_worked"), F.col("failed"), age).alias("strength"))


def top_per_key(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first rows of each key; Spark keeps only so many per key and task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def tokens_saved(reports: DataFrame, spent: str = "tokens_spent") -> DataFrame:
    """Tokens of followed entries, credited once per report that worked, capped per report."""
    return reports.where(F.col("outcome") == "worked").agg(F.coalesce(F.sum(F.least(F.col(spent), F.lit(TOKENS_CREDIT))), F.lit(0)).cast("long").alias("tokens_saved"), F.count("*").alias("reports"))


def ratio(part: Column, base: Column, least: int) -> Column:
    """Percent, rounded half up, only where the base is large enough to say something."""
    return F.when(base >= least, F.floor(100 * part / base + 0.5).cast("double"))


def votes_counted(reports: DataFrame, per_address: int = 3, per_hour: int = 20) -> DataFrame:
    """Reports with counted and the reason if not, in batch: by UTC day and hour instead of sliding windows.

    Not counted: an author's own success, a success from the address that published that day, a second report of an
    agent on an entry in a day, agents beyond per_address of an address on an entry in a day, and then all beyond
    per_hour of an address in an hour. Ties go by report_id.
    """
    day, hour = F.date_trunc("day", "at"), F.date_trunc("hour", "at")
    raises = F.col("outcome").isin("worked", "partially_worked")
    own = raises & ((F.col("agent") == F.col("author")) | ((F.col("address") == F.col("author_address")) & (day == F.date_trunc("day", "published_at"))))
    rows = reports.withColumns({"day": day, "hour": hour, "own": F.coalesce(own, F.lit(False))})
    in_time = ("at", "report_id")
    per_agent = Window.partitionBy("entry", "agent", "day", "own").orderBy(*in_time)
    rows = rows.withColumn("again", F.row_number().over(per_agent) > 1).withColumn("open", ~F.col("own") & ~F.col("again"))
    at_address = Window.partitionBy("entry", "address", "day", "open").orderBy(*in_time)
    rows = rows.withColumn("crowded", F.col("open") & (F.row_number().over(at_address) > per_address)).withColumn("open", F.col("open") & ~F.col("crowded"))
    in_hour = Window.partitionBy("address", "hour", "open").orderBy(*in_time)
    rows = rows.withColumn("flood", F.col("open") & (F.row_number().over(in_hour) > per_hour))
    reason = F.when(F.col("own"), "own_trail").when(F.col("again"), "already_reported_today").when(F.col("crowded") | F.col("flood"), "address_limit")
    return rows.withColumns({"not_counted_reason": reason, "counted": reason.isNull()}).drop("own", "again", "open", "crowded", "flood", "hour", "day")


def caveats(reports: DataFrame, most: int = 3) -> DataFrame:
    """Per entry, the newest notes: one an agent and day (the later replaces), none of reports that do not apply."""
    noted = reports.where(F.col("note").isNotNull() & (F.col("outcome") != "not_applicable"))
    one = Window.partitionBy("entry", "agent", F.date_trunc("day", "at")).orderBy(F.desc("at"), F.desc("report_id"))
    noted = noted.withColumn("n", F.row_number().over(one)).where("n = 1")
    newest = Window.partitionBy("entry").orderBy(F.desc("at"), F.desc("report_id"))
    noted = noted.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    return noted.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "outcome", "note", "at"))), lambda c: F.struct(c["outcome"], c["note"], c["at"])).alias("caveats"))
