"""What the operators of this subpackage share: the shared folder, written tables that cut lineage, and tables read."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of this machine's, if all of Spark
    runs in one process, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = _OWN.setdefault("dir", "") or _OWN.update(dir="file://" + tempfile.mkdtemp(prefix="lorekeep-")) or _OWN["dir"]
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lorekeep/{what}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing.

    The shuffles that made the table are read no more. Spark deletes their files once the driver has collected what
    refers to them, so a collection is asked for: disks then hold the shuffles of one step, not of all.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table written by kept() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lorekeep/" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lean(run: Callable) -> Callable:
    """For what runs in mapInPandas and mapInArrow: gives memory back to the system when a task ends, since Python workers
    live on and serve later tasks of other stages."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def file_system(uri: str):
    """A file system and a path for a folder of the shared store, inside tasks too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds row, a number of its own for each row: the identifier where all are there and differ, else one that is written."""
    if rows.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL").limit(1).count():
        return kept(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    return rows.withColumn("row", F.col(id_col).cast("long"))


def connected_components(links: DataFrame) -> DataFrame:
    """Node -> smallest node reachable, for undirected links (a long, b long); nodes without links are not returned.

    Rounds, each written to the shared folder, until nothing changes: the smallest label among a node's neighbours is handed
    to the node and to the node that its label names, then each label jumps to the label of its label. So whole trees
    of labels are hooked to smaller ones, not one node a round. Labels only fall, so rounds end by themselves; in
    simulations, chains of n nodes in any of five orders took at most log2(n) + 2. Minima are pre-aggregated before they are
    shuffled, so a hub's links never meet in one task; joins at a hub are of the kind that adaptive execution splits.
    Self-links and repeated links change nothing.
    """
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = kept(both, "links")
    labels = kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own, named = F.struct("node", "old", "label"), F.struct(F.col("old").alias("node"), F.lit(None).cast("long").alias("old"), "label")
        step = step.select(F.inline(F.array(own, named))).groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = kept(step.join(up, "label").select("node", F.least("label", "above").alias("label"), (F.least("label", "above") < F.col("old")).alias("changed")), "labels")
        changed = new.where("changed").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not changed:
            dropped(both)
            return labels
