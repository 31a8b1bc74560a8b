"""Effort records against reports, as an interval join: an aided record counts if its sender reported in the two days before it
that the entry worked, and did not write the entry.

Over streams both sides carry watermarks, so a record waits until no report that could still vouch for it can come, and is
then answered, one way or the other; a report is forgotten when no record can ask for it any more. The state is bounded by
two days of reports and the watermark's delay of records. Over a batch it is the same join.

Rows without person, entry or time take no part as reports; such records have no report. Identifiers of records must differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITHIN = "2 days"
LATE = "1 hour"


def vouched(records: DataFrame, reports: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """id, person, trail_id, at, reported. records: id, person, trail_id, at; reports: person, trail_id, outcome, author, at."""
    told = reports.where((F.col("outcome") == "worked") & ~F.col("author").eqNullSafe(F.col("person")) & F.col("at").isNotNull())
    told = told.select(F.col("person").alias("by"), F.col("trail_id").alias("of"), F.col("at").alias("told_at"))
    asked = records.where("at IS NOT NULL").select("id", "person", "trail_id", "at")
    streams = records.isStreaming
    if streams:
        told, asked = told.withWatermark("told_at", late), asked.withWatermark("at", late)
    before = F.expr(f"told_at <= at AND told_at > at - INTERVAL {within}")
    joined = asked.join(told, (F.col("person") == F.col("by")) & (F.col("trail_id") == F.col("of")) & before, "left_outer")
    # Several reports may vouch for one record.
    answered = joined.select("id", "person", "trail_id", "at", F.col("told_at").isNotNull().alias("reported"))
    return answered.dropDuplicatesWithinWatermark(["id"]) if streams else answered.dropDuplicates(["id"])
