"""Usage figures: totals over a time, boards by model, demand, daily analytics, effort sums, hold-out assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the contract.
DEMAND_AGENTS = 3
DEMAND_TOP, DEMAND_TOP_OPERATOR = 8, 50
ANALYTICS_DAYS = 365
TEST_MODELS = ("live-check", "synthetic")
CAPS = {"tokens": 10_000_000, "turns": 10_000, "seconds": 86_400}


def distinct_agents(events: DataFrame, since: Column, until: Column) -> DataFrame:
    """Distinct agents that sent an id after since, up to until."""
    return events.where((F.col("at") > since) & (F.col("at") <= until) & F.col("agent").isNotNull()).agg(F.countDistinct("agent").alias("agents"))


def distinct_agents_ever(events: DataFrame) -> DataFrame:
    """The unbounded figure, as a mergeable sketch."""
    return events.where(F.col("agent").isNotNull()).agg(F.hll_sketch_estimate(F.hll_sketch_agg("agent")).alias("agents"))


def model_board(counters: DataFrame) -> DataFrame:
    """Per model: laid, rediscovered, confirmed, failed, their score, its share of the best score and its rank.

    counters: model, kind, seed. Seeds and test models do not count."""
    real = counters.where(~F.coalesce("seed", F.lit(False)) & F.col("model").isNotNull() & ~F.col("model").isin(*TEST_MODELS))
    kinds = ("laid", "rediscovered", "confirmed", "failed")
    board = real.groupBy("model").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds)).withColumn("score", F.col("laid") + F.col("rediscovered") + F.col("confirmed"))
    best = board.agg(F.max("score").alias("best"))  # one row
    ranked = board.join(F.broadcast(best)).withColumn("bar", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0))
    # A row a model: a name list, not data that grows with events.
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("model")))).drop("best")


def hot_labels(searches: DataFrame, most: int) -> DataFrame:
    return searches.groupBy("label").agg(F.count("*").alias("searches")).orderBy(F.desc("searches"), F.asc("label")).limit(most)


def demand(searches: DataFrame, least_agents: int = DEMAND_AGENTS, most: int = DEMAND_TOP) -> DataFrame:
    """Unanswered keys that enough distinct agents asked for; callers without an id are searches, not agents.

    searches: fingerprint, agent, answered."""
    open_ones = searches.where(~F.col("answered")).groupBy("fingerprint").agg(F.count("*").alias("searches"), F.countDistinct("agent").alias("agents"))
    return open_ones.where(F.col("agents") >= least_agents).orderBy(F.desc("searches"), F.asc("fingerprint")).limit(most)


def analytics_daily(events: DataFrame, until: Column, days: int = ANALYTICS_DAYS) -> DataFrame:
    """Per UTC day: totals, and the same by model and by framework, by grouping sets in one pass."""
    rows = events.where((F.col("at") <= until) & (F.col("at") > until - F.make_dt_interval(F.lit(days)))).withColumn("day", F.to_date("at"))
    kinds = ("laid", "worked", "partially_worked", "failed", "searched")
    sets = [[F.col("day")], [F.col("day"), F.col("model")], [F.col("day"), F.col("framework")]]
    agg = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    grouped = rows.groupingSets(sets, "day", "model", "framework").agg(F.grouping_id().alias("g"), *agg, F.count("*").alias("events"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "model").otherwise("framework")
    return grouped.select(level.alias("level"), "day", "model", "framework", *kinds, "events")


def clamp(value: Column, most: float) -> Column:
    """A count as a whole number from 0 to most; what is no finite number is 0."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0), F.lit(0)).otherwise(F.floor(F.least(v, F.lit(float(most))))).cast("long")


def effort_sums(records: DataFrame) -> DataFrame:
    """Sums only, never who sent them: by key, role and model; by entry; by day. One pass by grouping sets."""
    cols = ("fingerprint", "role", "model", "entry", "day")
    by = {c: F.col(c) for c in cols}
    sets = [[by["fingerprint"], by["role"], by["model"]], [by["entry"]], [by["day"]]]
    grouped = records.groupingSets(sets, *cols).agg(F.grouping_id().alias("g"), F.sum("tokens").alias("tokens"), F.sum("turns").alias("turns"), F.sum("seconds").alias("seconds"), F.count("*").alias("records"))
    level = F.when(F.col("g") == 3, "fingerprint").when(F.col("g") == 29, "entry").otherwise("day")
    return grouped.select(level.alias("level"), *cols, "tokens", "turns", "seconds", "records")


def holdout(person: Column, key: Column, day: Column, percent: int) -> Column:
    """Whether a lookup is held out: the same all day for a person and key. A prefix of SHA-256 is the die."""
    if not 0 <= percent <= 20:
        raise ValueError("0 to 20 percent")
    die = F.conv(F.substring(F.sha2(F.concat_ws("|", person, key, F.date_format(day, "yyyy-MM-dd")), 256), 1, 8), 16, 10).cast("long")
    return F.pmod(die, F.lit(100)) < percent


def usage_sums(lines: DataFrame) -> DataFrame:
    """Per session: token sums over messages, the last line of a message counting, and the model most used (the earlier
    seen, of equals). lines: session, line_no, message, model, and token columns."""
    tokens = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    message = F.struct(*(clamp(F.col(t), float(2**62)).alias(t) for t in tokens), "model")
    last = lines.groupBy("session", "message").agg(F.max_by(message, "line_no").alias("m"), F.min("line_no").alias("first"))
    sums = last.groupBy("session").agg(*(F.sum(f"m.{t}").alias(t) for t in tokens), F.count("*").alias("turns"))
    sums = sums.select("session", *(F.least(F.col(t), F.lit(CAPS["tokens"])).alias(t) for t in tokens), F.least("turns", F.lit(CAPS["turns"])).alias("turns"))
    models = last.where("m.model <> ''").groupBy("session", F.col("m.model").alias("model")).agg(F.count("*").alias("n"), F.min("first").alias("first"))
    top = models.groupBy("session").agg(F.max_by("model", F.struct("n", -F.col("first"))).alias("model"))
    return sums.join(top, "session", "left")


def fail_then_fix(events: DataFrame, minutes: int = 45) -> DataFrame:
    """Each failure with the first success of the same session and key that follows within some minutes.

    Read backwards in (session, key) order, the next success is the last one seen: a frame that only grows, one pass, one
    shuffle, rows in, rows out."""
    backwards = Window.partitionBy("session", "key").orderBy(F.desc("at"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.col("ok"), F.struct("at", "event_id")), ignorenulls=True).over(backwards)
    rows = events.withColumn("fix", nxt).where(~F.col("ok") & (F.col("fix.at") <= F.col("at") + F.make_dt_interval(mins=F.lit(minutes))))
    return rows.select("session", "key", "event_id", "at", F.col("fix.event_id").alias("fix_id"), F.col("fix.at").alias("fix_at"))


def medians(runs: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Per condition: runs, solved ones, and the exact median of each value over the solved."""
    solved = lambda v: F.percentile(F.when(F.col("solved"), F.col(v)), F.lit(0.5)).alias(f"median_{v}")
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if("solved").alias("solved"), *map(solved, values))


def savings(records: DataFrame, least: int = 1) -> DataFrame:
    """Per key: mean effort of helped and of held-out lookups, and what help saves, where both have enough records.

    records: fingerprint, held_out, tokens."""
    held, helped = F.col("held_out"), ~F.col("held_out")
    found = records.groupBy("fingerprint").agg(
        F.count_if(helped).alias("helped"), F.count_if(held).alias("held"), F.avg(F.when(helped, F.col("tokens"))).alias("helped_tokens"), F.avg(F.when(held, F.col("tokens"))).alias("held_tokens")
    )
    both = (F.col("helped") >= least) & (F.col("held") >= least)
    return found.withColumns({"method": F.when(both, "holdout"), "saved": F.when(both, F.col("held_tokens") - F.col("helped_tokens"))})
