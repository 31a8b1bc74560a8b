"""Sessions into entries: every dead end, in order; feeds by each sort."""

from lorekeep.operators import publish
from pyspark.sql import functions as F

STEPS = "session string, pos int, kind string, approach string, text string"


def test_dead_ends_in_order(spark):
    rows = [("a", 3, "failure", "second", "x2"), ("a", 1, "failure", "first", "x1"), ("a", 2, "fix", "no", "y"), ("a", 5, "failure", "last", "x3"), ("b", 1, "failure", "only", "z"), ("c", 1, "other", None, None), ("d", 1, "failure", None, None), ("d", 2, "failure", "e" * 600, "w")]
    rows += [("long", i, "failure", f"try {i}", "e") for i in range(40)]
    tried = [("a", 9, 7, "failed", None), ("a", 8, 6, "partially_worked", ""), ("a", 7, 5, "worked", "good"), ("b", 2, 4, "failed", "n" * 600), ("e", 1, 3, "not_applicable", None)]
    found = publish.dead_ends(spark.createDataFrame(rows, STEPS), spark.createDataFrame(tried, "session string, pos int, entry_id long, outcome string, notes string"))
    listed = {}
    for r in sorted(found.collect(), key=lambda r: (r.session, r.n)):
        listed.setdefault(r.session, []).append((r.n, r.approach, r.why_it_failed))
    assert listed["a"] == [(1, "first", "x1"), (2, "second", "x2"), (3, "Followed entry 6", "it only partly worked"), (4, "Followed entry 7", "it did not work in this environment")]
    assert listed["b"] == [(1, "Followed entry 4", "n" * 500)] and listed["d"] == [(1, "", "")] and set(listed) == {"a", "b", "d", "long"}
    assert [n for n, *_ in listed["long"]] == list(range(1, 40))
    entries = publish.with_dead_ends(publish.assembled(spark.createDataFrame(rows, STEPS)), found)
    own = {r.session: r.failed_approaches for r in entries.collect()}
    assert [x.approach for x in own["long"]] == [f"try {i}" for i in range(20)] and own["c"] == [] and [x.approach for x in own["a"]][:2] == ["first", "second"]
    assert publish.dead_ends(spark.createDataFrame([], STEPS)).count() == 0


def test_feed_pages_follow_each_other(spark):
    rows = spark.range(130).select(F.col("id").alias("entry_id"), (F.col("id") % 7 / 7).alias("strength"), F.col("id").alias("last_success_at"), (-F.col("id")).alias("created_at"), F.lit(None).cast("int").alias("worked"), (F.col("id") % 3).alias("partially_worked"), F.lit(1).alias("failed"), F.when(F.col("id") % 2 == 0, "golang").alias("runtime"), F.lit("x").alias("category"))
    for sort, column in publish.SORTS.items():
        seen, after = [], None
        while True:
            page = publish.feed(rows, sort, runtime="go", category="x", after=after)
            ids = [r.entry_id for r in page.collect()]
            if not ids:
                break
            seen += ids
            after = page.where(F.col("entry_id") == ids[-1])
        value = {"strength": lambda i: i % 7 / 7, "last_success_at": lambda i: i, "created_at": lambda i: -i, "followed": lambda i: i % 3 + 1}[column]
        assert seen == sorted(range(0, 130, 2), key=lambda i: (-value(i), i))
