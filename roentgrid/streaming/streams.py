"""Append-only logs as Structured Streaming inputs.

Each query writes to a table of its own folder, with its checkpoint next to it, so
that a restarted query goes on where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import text
from ..operators import plugins

# Settings of an append-mode query, each unless the session has its own. Remembered keys are kept in packed files, which
# are open only while their task runs, not in memory; versions that no restart needs go, and so does a batch's shuffle.
SMALL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def grounding_scores(df: DataFrame, truth: str = "gt_text", prediction: str = "pred_text", fmt: str = "cxcywh") -> DataFrame:
    """Add bbox_iou (null without boxes in the truth) and both texts as compared."""
    # The boxes of the truth are parsed once.
    iou = bx.let(bx.parse_boxes(truth), lambda found: F.when(F.size(found) > 0, bx.union_iou(found, bx.parse_boxes(prediction), fmt)))
    return df.withColumns(
        {"bbox_iou": iou, "clean_gt": text.clean_eval_text(truth), "clean_pred": text.clean_eval_text(prediction)}
    )


def stream_log(
    spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_batch: int | None = None,
    bytes_per_batch: int | None = None, delete: bool = False,
) -> DataFrame:
    """Log files as a stream, new files being picked up as they appear.

    With ``delete``, for a log that nothing else reads, files go once their batch is committed.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    if delete:
        reader = reader.option("cleanSource", "delete")
    return reader.load(folder)


def first_seen(log: DataFrame, keys: list[str], ingest_time: str | None = None, delay: str | None = "1 day") -> DataFrame:
    """Rows of a log stream, each key once.

    Keys are remembered for ``delay`` of the ingest time, by default the time a batch is
    read; None remembers all keys for ever.
    """
    if delay is None:
        return log.dropDuplicates(keys)
    time = ingest_time or "__ingested"
    stamped = log if ingest_time else log.withColumn(time, F.current_timestamp())
    return stamped.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys).drop("__ingested")


def stream_scores(log: DataFrame, keys: list[str], ingest_time: str | None = None, delay: str | None = "1 day") -> DataFrame:
    """Score predictions as they arrive, each key once within ``delay``."""
    return grounding_scores(first_seen(log, keys, ingest_time, delay))


def model_scores_to(
    log: DataFrame, keys: list[str], column: str, model: Callable[[DataFrame], DataFrame], folder: str,
    ingest_time: str | None = None, delay: str | None = "1 day",
):
    """Query that adds a model's outputs for a text column, batch by batch; processes what is there, then stops.

    Outputs are kept in a table next to the results, which every batch reads first: a text
    is scored once, whichever batch, key or restart it comes with. A batch that is run
    again replaces its own part. ``read_batches`` gives the rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        scored = plugins.memoized(batch, column, model, os.path.join(folder, "models"))
        scored.write.mode("overwrite").parquet(os.path.join(folder, "data", f"batch={number}"))

    return (
        first_seen(log, keys, ingest_time, delay).writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", os.path.join(folder, "_progress"))
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that batch-numbered writes have left."""
    return spark.read.parquet(os.path.join(folder, "data")).drop("batch")


def stream_audit(log: DataFrame, window: int) -> DataFrame:
    """Running samples per step window, dataset and category (update mode)."""
    start = (F.floor(F.col("global_step") / window) * window).cast("bigint")
    return log.groupBy(start.alias("window_start"), "dataset_name", "category").agg(F.count("*").alias("n"))


def stream_weights(log: DataFrame) -> DataFrame:
    """Latest weight per dataset and category (update mode)."""
    latest = F.max(F.struct("global_step", "weight")).alias("l")
    grouped = log.groupBy("dataset", "category").agg(latest)
    return grouped.select("dataset", "category", "l.global_step", "l.weight")


@contextmanager
def _unless_set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for a query that is started meanwhile, which keeps them; the session's own come first."""
    added = {k: v for k, v in settings.items() if spark.conf.get(k, None) is None}
    try:
        for k, v in added.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k in added:
            spark.conf.unset(k)


def append_to(stream: DataFrame, folder: str):
    """Append-mode query into a Parquet folder; processes what is there, then stops."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("compression", "zstd")
        .option("checkpointLocation", os.path.join(folder, "_progress"))
        .trigger(availableNow=True)
    )
    with _unless_set(stream.sparkSession, SMALL):
        return writer.start(os.path.join(folder, "data"))


def update_to(stream: DataFrame, folder: str):
    """Update-mode query: every batch adds the changed groups under its batch number.

    A batch that is run again replaces its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(folder, "data", f"batch={number}"))

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", os.path.join(folder, "_progress"))
        .trigger(availableNow=True)
        .start()
    )


def read_updates(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Current state of an update-mode query: per key the row of its last batch."""
    rows = spark.read.parquet(os.path.join(folder, "data"))
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
