"""Change streams: ingest in order, keep state, set bad input aside."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from terrachron.operators.changes import ELEMENT, newest_changes
from terrachron.operators.skew import dealt

CORRUPT = "_corrupt_record"


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run ``step`` on every batch that is available now; a later run resumes after it."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class ChangeLog:
    """Current elements from a table of changes, partitioned by batch.

    A batch adds its own newest changes and reads nothing, so it costs what it holds; a batch that is run
    again replaces its own partition. Readers take the newest row of each element over all
    batches. Deletions stay in the table, so late changes cannot bring an element back.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ("version",), ties: Sequence[str] = ()):
        self.spark, self.path, self.order, self.ties = spark, path, list(order), list(ties)

    def add(self, changes: DataFrame, batch: int) -> None:
        changes = dealt(changes, ELEMENT, changes.count())
        rows = newest_changes(changes, self.order, self.ties).withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def elements(self, up_to: int | None = None) -> DataFrame:
        """The elements that exist after all batches, or after those up to a number."""
        log = self.spark.read.parquet(self.path)
        log = log if up_to is None else log.filter(F.col("batch") <= up_to)
        log = dealt(log, ELEMENT, log.count())
        newest = newest_changes(log, self.order, [*self.ties, "batch"])
        return newest.filter(F.col("action") != "delete").drop("action", "batch")


def ingest_changes(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    log: ChangeLog,
    checkpoint: str,
    first_sequence: int | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Add all change files that have arrived since the last run.

    ``first_sequence`` overrides where to begin; the checkpoint remembers what
    was read.
    """
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    if first_sequence is not None:
        stream = stream.filter(F.col("sequence") >= first_sequence)
    run_available(stream, log.add, checkpoint)


def split_bad_records(
    spark: SparkSession, source: str, schema: str, good: str, bad: str, checkpoint: str
) -> None:
    """Stream JSON lines; unreadable lines go to ``bad`` and the stream goes on."""
    stream = (
        spark.readStream.schema(f"{schema}, {CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(source)
    )

    def step(rows: DataFrame, batch: int) -> None:
        tagged = rows.withColumn("batch", F.lit(batch)).persist()
        broken = F.col(CORRUPT).isNotNull()
        for part, path in ((tagged.filter(~broken).drop(CORRUPT), good), (tagged.filter(broken).select(CORRUPT, "batch"), bad)):
            writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch").parquet(path)
        tagged.unpersist()

    run_available(stream, step, checkpoint)


def first_uploads(stream: DataFrame, keys: Sequence[str], time: str, horizon: str) -> DataFrame:
    """Drop content seen before within the horizon; state is bounded by it."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(list(keys))


def append_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> None:
    """Write ``step(batch)`` per batch; a batch that is run again replaces its own rows."""

    def write(rows: DataFrame, batch: int) -> None:
        made = step(rows).withColumn("batch", F.lit(batch))
        writer = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch").parquet(target)

    run_available(stream, write, checkpoint)
