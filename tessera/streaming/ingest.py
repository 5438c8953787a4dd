"""Streams of files and events into ledger tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.store import Conflict, Merge, Store

TRIES = 5


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_time(df: DataFrame, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """A watermark on a time without zone, which is taken as UTC by the session."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return df.dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, key: str, gap: str, column: str = "ts") -> DataFrame:
    window = F.session_window(column, gap)
    return df.groupBy(key, window).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_stream(df: DataFrame, table: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Each micro-batch merged into a small parquet table without a key, versions of which stand side by side; keyed tables grow by `upsert_store`.

    A version is written whole before it is named current by its number, so a lost job leaves the last
    one whole, and a batch that runs again writes the same version again.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        old = version(spark, table, number - 1)
        new = merge(old, batch) if old is not None else merge(batch.limit(0), batch)
        new.write.mode("overwrite").parquet(f"{table}/version={number:012d}")

    start = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (start.trigger(availableNow=True) if once else start).start()


def upsert_store(df: DataFrame, store: Store, name: str, merge: Merge, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch merged into a bucketed table: what is read and written follows the batch, not the table.

    The number of the last batch of this stream (by its checkpoint folder) stands in the commit, so a batch
    that runs again after its commit changes nothing. A commit of another writer that touches the same buckets
    makes the batch start again.
    """
    stream = f"stream:{checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        for last in range(TRIES - 1, -1, -1):
            if store.notes().get(stream, -1) >= number:
                return
            try:
                store.commit({name: (batch, merge)}, notes={stream: number})
                return
            except Conflict:
                if not last:
                    raise

    start = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (start.trigger(availableNow=True) if once else start).start()


def version(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    """A version of a table, null before the first."""
    return None if number < 0 else spark.read.parquet(f"{table}/version={number:012d}")
