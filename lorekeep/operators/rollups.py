"""Daily figures as partial aggregates that add up: stored by batch, merged when they are read, and the distinct agents of the last
days from mergeable sketches.

A partial is a row for each day and key of one batch: how many events, sums of measures, and the agents, as a list as long as they are
few (EXACT) and as a sketch. A batch is written under its name, and replaces itself when it is written again, so a stream
that repeats a batch after a failure changes nothing, and late events add to their own day. Whatever the batches are, the
merged table is that of all events together: sums are sums, lists unite, sketches unite.

Distinct agents over a span of days unite the days' partials. As long as every day has its list, the number is exact; with
sketches of 2^LG_K registers its standard error is 1.04 / sqrt(2^LG_K). A day counts for the span's days and no longer.

Where numbers must be exact for any number of agents, partials keep a row for each agent too (by_agent): they are stored, replaced
and added up in the same way, at a row for each agent and day in place of one for each day.

Rows without a time or a key are dropped; a null agent is nobody; null measures add nothing. No rows, no days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXACT, LG_K = 64, 12
#: Fixed value of the contract: days that an agent counts among those who asked.
ASKED_DAYS = 60


def partials(events: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """day, key, n, measures, agents array<string> (null: too many), sketch. events: at, key, agent, measures."""
    own = events.where("at IS NOT NULL AND key IS NOT NULL").select(F.to_date("at").alias("day"), "key", F.col("agent").cast("string").alias("agent"), *measures)
    sums = own.groupBy("day", "key").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures), F.hll_sketch_agg("agent", LG_K).alias("sketch"))
    once = own.where("agent IS NOT NULL").select("day", "key", "agent").distinct()
    # So many a day and key that a list shows whether there are more.
    few = once.withColumn("i", F.row_number().over(Window.partitionBy("day", "key").orderBy("agent"))).where(f"i <= {EXACT + 1}")
    lists = few.groupBy("day", "key").agg(F.sort_array(F.collect_list("agent")).alias("agents"))
    none = F.array().cast("array<string>")
    rows = sums.join(lists, ["day", "key"], "left").withColumn("agents", F.coalesce("agents", none))
    return rows.select("day", "key", "n", *measures, F.when(F.size("agents") <= EXACT, F.col("agents")).alias("agents"), "sketch")


def _united(rows: DataFrame, by: list[str], measures: tuple[str, ...]) -> DataFrame:
    every = F.every(F.col("agents").isNotNull())
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in measures), F.hll_union_agg("sketch").alias("sketch"),
        F.when(every, F.array_distinct(F.flatten(F.collect_list("agents")))).alias("agents"),
    )


def merged(rows: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """Partials of several batches as one for each day and key."""
    found = _united(rows, ["day", "key"], measures)
    return found.select("day", "key", "n", *measures, F.when(F.size("agents") <= EXACT, F.sort_array("agents")).alias("agents"), "sketch")


def agents_of(agents: str = "agents", sketch: str = "sketch"):
    """The number of agents: exact where there is a list."""
    return F.when(F.col(agents).isNotNull(), F.size(agents).cast("long")).otherwise(F.hll_sketch_estimate(sketch))


def by_agent(events: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """day, key, agent (null: nobody), n, measures: partials that count agents exactly, however many there are."""
    own = events.where("at IS NOT NULL AND key IS NOT NULL").select(F.to_date("at").alias("day"), "key", F.col("agent").cast("string").alias("agent"), *measures)
    return own.groupBy("day", "key", "agent").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))


def write_batch(events: DataFrame, path: str, batch: int | str, measures: tuple[str, ...] = (), of: Callable = partials) -> None:
    """Stores a batch's partials, of either kind, under its name."""
    rows = of(events, measures).withColumn("batch", F.lit(str(batch)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_stream(events: DataFrame, path: str, checkpoint: str, measures: tuple[str, ...] = ()):
    """A writer of a stream's micro-batches; a batch that runs again replaces itself."""
    return events.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, path, batch, measures)).option("checkpointLocation", checkpoint)


def daily(spark: SparkSession, path: str, measures: tuple[str, ...] = ()) -> DataFrame:
    return merged(spark.read.parquet(path), measures)


def daily_exact(spark: SparkSession, path: str, measures: tuple[str, ...] = ()) -> DataFrame:
    """day, key, n, measures, agents: of stored batches by agent."""
    once = spark.read.parquet(path).groupBy("day", "key", "agent").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in measures))
    return once.groupBy("day", "key").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in measures), F.count("agent").alias("agents"))


def agents_within(days: DataFrame, span: int = ASKED_DAYS) -> DataFrame:
    """day, key, agents, exact: distinct agents of the span of days that ends with each day on which the key has any. days: merged partials."""
    asked = days.select(F.col("day").alias("upto"), "key").distinct()
    counts = days.select("key", "agents", "sketch", F.explode(F.sequence("day", F.date_add("day", span - 1))).alias("upto"))
    found = counts.join(asked, ["upto", "key"], "left_semi").groupBy("upto", "key").agg(
        F.hll_union_agg("sketch").alias("sketch"), F.when(F.every(F.col("agents").isNotNull()), F.array_distinct(F.flatten(F.collect_list("agents")))).alias("agents")
    )  # at most EXACT agents a day
    return found.select(F.col("upto").alias("day"), "key", agents_of().alias("agents"), F.col("agents").isNotNull().alias("exact"))


def agents_within_exact(days: DataFrame, span: int = ASKED_DAYS) -> DataFrame:
    """day, key, agents: as agents_within, exact for any number. days: partials by agent.

    An agent counts from each of its days until the span ends or its next day begins, so its stretches don't overlap, and the number of a
    day is how many began up to it less how many ended: sums by day, and nothing is repeated for the days of a span."""
    seen = days.where("agent IS NOT NULL").select("key", "agent", "day").distinct()
    follows = F.lead("day").over(Window.partitionBy("key", "agent").orderBy("day"))
    stretch = seen.select("key", "day", F.least(F.date_add("day", span), follows).alias("until"))
    steps = stretch.select("key", F.inline(F.array(F.struct("day", F.lit(1).alias("step")), F.struct(F.col("until").alias("day"), F.lit(-1).alias("step")))))
    asked = days.select("key", "day", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    sums = steps.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("key", "day").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    upto = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return sums.withColumn("agents", F.sum("step").over(upto)).where("asked").select("day", "key", "agents")
