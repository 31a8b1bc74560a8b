"""Transcripts of sessions as line-delimited JSON: scans that skip damaged lines, usage in a time window, calls paired with results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "input_tokens double, output_tokens double, cache_read_input_tokens double, cache_creation_input_tokens double"
LINE = f"type string, timestamp string, uuid string, message struct<id:string, model:string, usage:struct<{USAGE.replace(' double', ':double')}>>"
STEP = "step_index bigint, type string, content string, tool_calls array<struct<name:string, args:map<string,string>>>"


#: Bits of a line's number that count lines within a split of a file; a split has no more lines than bytes.
_SPLIT_BITS = 27


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session (the file), line_no, line. Long files are read in splits; line_no orders a file's lines (by split, then place in it)
    and is no count."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SPLIT_BITS) - 1))
    at = F.shiftleft(F.col("_metadata.file_block_start"), _SPLIT_BITS) + place
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("session"), at.alias("line_no"), F.col("value").alias("line")).where(F.trim("line") != "")


def usage_lines(lines: DataFrame, since: Column, until: Column) -> DataFrame:
    """session, line_no, message, model and tokens of the answers in a time window; a substring test comes before the parse."""
    parsed = lines.where(F.contains("line", F.lit('"usage"'))).withColumn("j", F.from_json("line", LINE)).where("j.type = 'assistant' AND j.message.usage IS NOT NULL")
    at = F.try_to_timestamp(F.col("j.timestamp"))
    rows = parsed.withColumn("at", at).where((F.col("at") >= since) & (F.col("at") <= until))
    u = "j.message.usage."
    return rows.select(
        "session", "line_no", F.coalesce("j.message.id", "j.uuid", F.col("at").cast("string")).alias("message"), F.coalesce("j.message.model", F.lit("")).alias("model"),
        F.col(u + "input_tokens").alias("input_tokens"), F.col(u + "output_tokens").alias("output_tokens"),
        F.col(u + "cache_read_input_tokens").alias("cache_read_tokens"), F.col(u + "cache_creation_input_tokens").alias("cache_write_tokens"),
    )


def steps(lines: DataFrame) -> DataFrame:
    """session, step_index, type, content, tool_calls; damaged lines and what is no object are left out."""
    parsed = lines.where(F.try_parse_json("line").isNotNull() & F.startswith(F.trim("line"), F.lit("{"))).withColumn("j", F.from_json("line", STEP))
    return parsed.select("session", F.coalesce("j.step_index", F.col("line_no").cast("long")).alias("step_index"), "j.type", "j.content", "j.tool_calls")


def paired_calls(rows: DataFrame) -> DataFrame:
    """The n-th call of a model step with the n-th result that directly follows: session, step_index, n, name, args, result.

    Only steps before the first whose calls are not all answered count; it is read again when its results are there."""
    order = Window.partitionBy("session").orderBy("step_index")
    model = (F.col("type") == "PLANNER_RESPONSE") & F.col("tool_calls").isNotNull()
    runs = rows.withColumn("run", F.sum(F.when(F.coalesce(F.col("type"), F.lit("")) != "GENERIC", 1).otherwise(0)).over(order)).withColumn("model", F.coalesce(model, F.lit(False)))
    results = runs.where("type = 'GENERIC'").withColumn("n", F.row_number().over(Window.partitionBy("session", "run").orderBy("step_index")) - 1)
    calls = runs.where("model").select("session", "run", "step_index", F.posexplode("tool_calls").alias("n", "call"))
    joined = calls.join(results.select("session", "run", "n", F.col("content").alias("result"), F.lit(True).alias("there")), ["session", "run", "n"], "left")
    first_open = F.min(F.when(F.col("there").isNull(), F.col("step_index"))).over(Window.partitionBy("session"))
    done = joined.withColumn("open", first_open).where("open IS NULL OR step_index < open")
    return done.select("session", "step_index", "n", F.col("call.name").alias("name"), F.col("call.args").alias("args"), "result")
