"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes (by their head, then by a digest), Spark's external sort puts equal texts next to each other, and
each row is compared in full with its neighbour. The splitters are of (text, id), so a group of copies of any size is
spread over several partitions (Spark balances rows). A long run's identifiers are handed on in pieces. Runs that touch a partition's edge are joined with those beyond it by
digest and length: two runs a partition at most, a table whose size is bounded by the number of partitions.

Null texts count as empty. With ``keep="largest"`` or ``"smallest"`` the row with that identifier stays; rows that
repeat text and identifier get the same answer, and only one of them is kept (the first of them in sort order, which
holds because equal rows are alike). Rows whose identifier is null sort last and are never kept while another row
of the group has one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, lean, read_table, shuffle_partitions

_RUNS = "doc_id long, run_keep long, run_size long, run_first boolean, edge boolean, n_bytes long, text_sha256 string, long_run long"
ROWS_AT_ONCE = 50_000
#: Identifiers of one run that are held; those of a longer run are handed on before its size is known.
HELD = 10_000
#: Characters of a text that go into the sample for the splitters.
SPLITTER_CHARS = 64


@lean
def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows in (text, id) order, the first of a run being the one that stays: each row with its run's size. Of a long run, only
    the last row has size and edge, for all that name the run."""
    from pyspark import TaskContext

    done: list[tuple] = []
    number = TaskContext.get().partitionId() << 32
    text, ids, total, given, first_run, told = None, [], 0, 0, True, ("", 0)
    keep: int | None = None

    def hand_on(last: bool, ends: bool) -> None:
        """The held ids of the current run; ends: the run is over; last: and so are the partition's rows."""
        nonlocal told, given
        if not told[1]:
            raw = text.encode("utf-8", "surrogatepass")
            told = hashlib.sha256(raw).hexdigest(), len(raw) + 1
        sha, n = told[0], told[1] - 1
        if total <= HELD:
            done.extend((i, keep, total, k == 0, first_run or last, n, sha, None) for k, i in enumerate(ids))
        else:
            done.extend((i, keep, None, given + k == 0, None, n, sha, number) for k, i in enumerate(ids))
            if ends:
                done[-1] = (*done[-1][:2], total, done[-1][3], first_run or last, n, sha, number)
        given += len(ids)
        ids.clear()

    names = [x.split()[0] for x in _RUNS.split(", ")]
    kinds = {"doc_id": "Int64", "run_keep": "Int64", "run_size": "Int64", "edge": "boolean", "long_run": "Int64"}
    frame = lambda: pd.DataFrame(done, columns=names).astype(kinds)
    for batch in batches:
        for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
            i = None if pd.isna(i) else int(i)
            if t != text:
                if text is not None:
                    hand_on(False, True)
                    first_run = False
                text, total, given, keep, told, number = t, 0, 0, i, ("", 0), number + 1
            ids.append(i)
            total += 1
            if len(ids) > HELD:  # one is kept back, to end the run with
                back = ids.pop()
                hand_on(False, False)
                ids.append(back)
        if len(done) >= ROWS_AT_ONCE:
            yield frame()
            done.clear()
    if text is not None:
        hand_on(True, True)
    if done:
        yield frame()


def _with_totals(runs: DataFrame) -> DataFrame:
    """Sizes and edges of long runs for all of their rows."""
    long_runs = runs.where("long_run IS NOT NULL")
    if not long_runs.limit(1).count():
        return runs
    totals = kept(long_runs.where("run_size IS NOT NULL").select("long_run", F.col("run_size").alias("total"), F.col("edge").alias("at_edge")), "long-runs")
    return runs.join(totals, "long_run", "left").withColumns({"run_size": F.coalesce("run_size", "total"), "edge": F.coalesce("edge", "at_edge")}).drop("total", "at_edge")


def exact_dedup(docs: DataFrame, keep: str = "smallest", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    order = {"largest": F.col("doc_id").desc_nulls_last(), "smallest": F.col("doc_id").asc_nulls_last()}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # What is sampled for the splitters is bounded: the text's head, then a digest, so equal texts stay neighbours.
    place = [F.substring("text", 1, SPLITTER_CHARS), F.xxhash64("text")]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *place, order).sortWithinPartitions(*place, F.col("text"), order)
    runs = _with_totals(kept(placed.mapInPandas(_runs, _RUNS), "runs"))
    best = (F.max if keep == "largest" else F.min)("run_keep")
    # At most two runs a partition have run_first and edge set.
    edges = runs.where("run_first and edge").groupBy("text_sha256", "n_bytes").agg(best.alias("keep_all"), F.sum("run_size").alias("size_all"), F.count("*").alias("n_runs"))
    edges = edges.where("n_runs > 1").drop("n_runs")
    whole = runs.join(F.broadcast(edges), ["text_sha256", "n_bytes"], "left")
    keep_id = F.when(F.col("edge"), F.coalesce("keep_all", "run_keep")).otherwise(F.col("run_keep"))
    return whole.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.coalesce("size_all", "run_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("run_first") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
