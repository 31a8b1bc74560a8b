"""Daily figures: any batches, replays included, add up to those of all events; distinct agents within the sketch's error; days expire."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from lorekeep.operators import rollups
from lorekeep.plans import activity
from pyspark.sql import functions as F

EVENTS = "at timestamp, key string, agent string, cost long"
START = dt.datetime(2024, 1, 1)


def some_events(n, seed=1, agents=30, days=20):
    rng = random.Random(seed)
    return [(START + dt.timedelta(days=rng.random() * days), f"k{rng.randrange(3)}", rng.choice([None, f"a{rng.randrange(agents)}"]), rng.choice([None, rng.randrange(100)])) for _ in range(n)] + [(None, "k0", "a", 1), (START, None, "a", 1)]


def brute(rows):
    found = defaultdict(lambda: [0, 0, set()])
    for at, key, agent, cost in rows:
        if at is not None and key is not None:
            own = found[at.date(), key]
            own[0], own[1] = own[0] + 1, own[1] + (cost or 0)
            own[2] |= {agent} - {None}
    return {k: (n, c, sorted(a)) for k, (n, c, a) in found.items()}


def listed(df):
    return {(r.day, r.key): (r.n, r.cost, r.agents) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_add_up(spark, tmp_path, seed):
    rng, rows, path = random.Random(seed), some_events(600, seed), str(tmp_path / "days")
    cuts = sorted(rng.sample(range(len(rows)), 4))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for i in [*range(5), 3, 0, 3]:  # some again
        rollups.write_batch(spark.createDataFrame(batches[i], EVENTS), path, i, ("cost",))
    assert listed(rollups.daily(spark, path, ("cost",))) == brute(rows) == listed(rollups.partials(spark.createDataFrame(rows, EVENTS), ("cost",)))
    assert rollups.partials(spark.createDataFrame([], EVENTS), ("cost",)).count() == 0


def test_a_stream_that_starts_again(spark, tmp_path):
    rows, path = some_events(300, 3), str(tmp_path / "days")
    for a in range(0, 300, 100):
        spark.createDataFrame(rows[a : a + 100], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        assert rollups.write_stream(stream, path, f"{tmp_path}/state", ("cost",)).trigger(availableNow=True).start().awaitTermination(120)
    assert listed(rollups.daily(spark, path, ("cost",))) == brute(rows[:300])


def test_many_agents(spark):
    """Beyond the list, numbers are within four standard errors; a list that is full is exact, one agent more is not."""
    rows = spark.range(60_000).select(F.lit(START).alias("at"), F.when(F.col("id") < 40_000, "many").otherwise("some").alias("key"), F.col("id").cast("string").alias("agent"))
    rows = rows.unionByName(spark.range(rollups.EXACT).select(F.lit(START).alias("at"), F.lit("full").alias("key"), F.col("id").cast("string").alias("agent")))
    rows = rows.unionByName(spark.range(rollups.EXACT + 1).select(F.lit(START).alias("at"), F.lit("over").alias("key"), F.col("id").cast("string").alias("agent")))
    found = {r.key: r for r in rollups.agents_within(rollups.merged(rollups.partials(rows).unionByName(rollups.partials(rows)))).collect()}
    error = 4 * 1.04 / (1 << rollups.LG_K) ** 0.5
    for key, true in (("many", 40_000), ("some", 20_000), ("over", rollups.EXACT + 1)):
        assert abs(found[key].agents - true) <= error * true and not found[key].exact
    assert found["full"].agents == rollups.EXACT and found["full"].exact


@pytest.mark.parametrize("span", [1, 7, 60])
def test_days_expire(spark, span):
    rows = some_events(400, 5, agents=40, days=150)
    found = {(r.day, r.key): r.agents for r in rollups.agents_within(rollups.partials(spark.createDataFrame(rows, EVENTS)), span).collect()}
    days = brute(rows)
    expected = {(day, key): len({a for (d, k), (_, _, agents) in days.items() if k == key and 0 <= (day - d).days < span for a in agents}) for day, key in days}
    assert found == expected


def crowded(spark, path) -> str:
    """A folder with events of more agents a day and key than lists or small sketches count exactly, some of them nobody's."""
    day = F.lit(START) + F.make_dt_interval((F.col("id") % 13).cast("int"))
    rows = spark.range(40_000).select(F.col("id").alias("event_id"), day.alias("ts"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919) % 9_001).alias("user_id"), F.element_at(F.array(F.lit("view"), F.lit("error")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"), (F.col("id") % 100 / 4).alias("value"))
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["agents_of_ten_days", "daily_by_batches"])
def test_crowds_are_counted_exactly(spark, tmp_path, name):
    at = crowded(spark, tmp_path)
    days = defaultdict(lambda: [0, 0, set(), set()])
    for e in spark.read.parquet(f"{at}/events.parquet").collect():
        own = days[e.ts.date(), e.event_type]
        own[0], own[1] = own[0] + 1, own[1] + int(e.value * 100)
        own[2] |= {e.user_id} - {None}
        own[3] |= {e.user_id} - {None} if e.user_id is not None and e.user_id % 5 < 3 else set()
    if name == "daily_by_batches":
        expected = {(d, k, n, cents, len(some)) for (d, k), (n, cents, _, some) in days.items()}
    else:
        expected = {(d, k, len(set().union(*(a for (e, of), (_, _, a, _) in days.items() if of == k and 0 <= (d - e).days < 10)))) for d, k in days}
    assert {tuple(r) for r in activity.QUERIES[name](spark, at).collect()} == expected


@pytest.mark.parametrize("span", [1, 7, 60])
def test_days_expire_exactly(spark, span):
    rows = some_events(400, 5, agents=40, days=150)
    found = {(r.day, r.key): r.agents for r in rollups.agents_within_exact(rollups.by_agent(spark.createDataFrame(rows, EVENTS)), span).collect()}
    days = brute(rows)
    assert found == {(day, key): len({a for (d, k), (_, _, agents) in days.items() if k == key and 0 <= (day - d).days < span for a in agents}) for day, key in days}
