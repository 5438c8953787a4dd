"""Lineage cuts and connected components that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> None:
    """Sees to it that checkpoints have a folder: the one that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all tasks run in this process (tests on one machine) a temporary
    folder stands in; on a cluster its files would be lost with an executor, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing reads any more.

    Spark removes them when the driver's heap is collected, which a driver with little to do puts off for
    long while large files lie on the executors' disks.
    """
    gc.collect()
    time.sleep(0.3)  # references are given back in the background
    spark.sparkContext._jvm.System.gc()


def short_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Texts go to Python some megabytes at a time; a batch lies in the JVM, in the worker and between them at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str) -> DataFrame:
    """rows joined with table, which has one row a key and how many rows hold it.

    A key that more than one in 4 x partitions of all rows hold goes to every task instead of meeting
    its rows in one; there are fewer such keys than that.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    common = F.col(weight) * (4 * partitions(rows.sparkSession)) > total
    hot = F.broadcast(table.filter(common).drop(weight))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(table.filter(~common).drop(weight), on))


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the smallest vertex of each one's component."""
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def _contract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each bounded chunk of a task become stars around their smallest vertex."""
    held_a: list[np.ndarray] = []
    held_b: list[np.ndarray] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        v, root = roots(np.concatenate(held_a), np.concatenate(held_b))
        far = v != root
        return pa.RecordBatch.from_arrays([pa.array(v[far]), pa.array(root[far])], ["a", "b"])

    for frame in frames:
        held_a.append(frame.column(0).to_numpy(zero_copy_only=False))
        held_b.append(frame.column(1).to_numpy(zero_copy_only=False))
        rows += frame.num_rows
        if rows >= 2_000_000:
            yield flush()
            held_a, held_b, rows = [], [], 0
    if rows:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """Vertices of edges (a, b: bigint, not null) as (id, component_id), the smallest vertex reachable.

    Large-star and small-star rounds; each first contracts what one task holds.
    A hub's rows are pre-aggregated to its smallest neighbour before the shuffle, and
    the join that hands it out can be split where it is skewed. Vertices without
    an edge to another vertex are not returned.
    """

    def contracted(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_contract, "a bigint, b bigint")

    spark = edges.sparkSession
    stars = contracted(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a <> b").coalesce(max(1, partitions(spark))))
    # Dealt by both ends, so that a hub's edges don't meet in one task. Each row: a vertex and a smaller one.
    stars = cut(contracted(stars.repartition(partitions(spark), "a", "b")))
    while True:
        least = stars.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        # A vertex under several smaller ones links those with each other; a chain is cut short by one step.
        up = least.select(F.col("a").alias("b"), F.col("m").alias("top"))
        links = stars.join(least.filter("n > 1").select("a", "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        short = least.select("a", F.col("m").alias("b")).join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("moved"))
        step = cut(short.withColumn("link", F.lit(False)).unionByName(links.withColumn("moved", F.lit(True)).withColumn("link", F.lit(True))))
        if not step.filter("moved").limit(1).count():
            return step.select("a", "b").unionByName(step.select(F.col("b").alias("a"), "b")).distinct().select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        stars = contracted(step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").repartition(partitions(spark), "a", "b"))
