"""Streaming forms of the run loop: pages in, links and records out, liveness and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesieve.operators.ledger import clamp_level


def page_stream(spark, folder: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Newly landed page files."""
    return spark.readStream.schema(schema).parquet(folder)


def keyed_state(spark: SparkSession) -> None:
    """Keep stream state in RocksDB: on the executors' disks, changes written to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def first_only(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of every key, each key once.

    The keys seen are stream state, looked up key by key: a batch reads its own
    rows and nothing that is stored.  Without ``event_time`` a key is held for
    good, so rows may come as late as they like; with it a key is forgotten, and
    its late rows are dropped, ``delay`` after its time.
    """
    keyed_state(stream.sparkSession)
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def store(stream: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; the sink's log of batches makes a replayed batch write nothing twice."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def run_timeouts(stream: DataFrame, event_time: str, gap: str, delay: str) -> DataFrame:
    """Bursts of page activity (run_id, started, quiet_since, pages), each as soon as its run has been quiet for ``gap``.

    The stream's own clock decides: a run times out when activity of any run,
    less ``delay``, passes the end of the gap, while the stream goes on.  Rows
    that come later than ``delay`` are dropped.
    """
    keyed_state(stream.sparkSession)
    burst = stream.withWatermark(event_time, delay).groupBy("run_id", F.session_window(event_time, gap).alias("burst"))
    return burst.agg(F.count("*").alias("pages")).select("run_id", F.col("burst.start").alias("started"), F.col("burst.end").alias("quiet_since"), "pages")


def event_log(stream: DataFrame, level: str | None = None) -> DataFrame:
    """Append-only events with clamped levels, optionally one level only."""
    out = stream.withColumn("level", clamp_level(F.col("level")))
    return out if level is None else out.filter(F.col("level") == level)


def activity(path: str, event_time: str, every_seconds: int):
    """foreachBatch body that stores a micro-batch as counts per run and time slot.

    Rows of one run combine inside each task first, so a busy run sends one row
    a slot and task.  A replayed batch overwrites its own folder; late rows add
    to their slot whenever they come.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        at = F.col(event_time)
        slot = F.floor(F.unix_seconds(at) / every_seconds)
        slots = batch.groupBy("run_id", slot.alias("slot")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("pages"))
        slots.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def run_liveness(slots: DataFrame, gap_seconds: int) -> DataFrame:
    """Bursts of page activity per run from stored slots no longer than the gap; a closed burst is a run that went quiet.

    Only slots are ordered per run, at most one for each slot length of time.
    """
    merged = slots.groupBy("run_id", "slot").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("pages").alias("pages"))
    order = Window.partitionBy("run_id").orderBy("slot")
    gap = F.make_interval(secs=F.lit(gap_seconds))
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(order) + gap, F.lit(True))
    burst = F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return merged.withColumn("burst", burst).groupBy("run_id", "burst").agg(
        F.min("first").alias("started"), (F.max("last") + gap).alias("quiet_since"), F.sum("pages").alias("pages")
    ).drop("burst")


def sweep(query, every: str | None = "60 seconds"):
    """Set the sweep trigger of a writer: periodic, or everything available once."""
    return query.trigger(processingTime=every) if every else query.trigger(availableNow=True)
