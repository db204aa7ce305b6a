"""Streams share the batch transformations; sinks are keyed, so a redelivered batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.storage import new_folder as folder

__all__ = ["drain", "folder", "run_batches"]


#: Batches without data, in which timers ring.  A stream with timers by the clock always has one more of them to run, so it would not end.
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_batches(stream: DataFrame, at: str, sink: Callable[[DataFrame, int], None], mode: str = "append", timers: bool = False) -> None:
    """Runs a stream over all that is there now; each micro-batch is computed once and kept while ``sink`` reads it.

    In a stream with ``timers`` those ring that are due while there is data; a stream that keeps running rings the others too.
    """

    def once(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sink(batch, batch_id)
        finally:
            batch.unpersist()

    conf = stream.sparkSession.conf
    before = conf.get(_IDLE)
    conf.set(_IDLE, "false" if timers else before)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(once).start()
    finally:
        conf.set(_IDLE, before)
    query.awaitTermination()


def drain(stream: DataFrame, at: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote; a batch's rows carry ``batch_id``.

    A batch is written to a folder of its own and overwrites it, so running it twice is the same as once.
    """
    out = f"{at}/out"
    run_batches(stream, at, lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"), mode, timers)
    return stream.sparkSession.read.parquet(out).withColumn("batch_id", F.col("batch_id").cast("long"))
