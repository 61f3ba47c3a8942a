"""One source, many consumers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Consumer = Callable[[DataFrame, int], None]


def fan_out(stream: DataFrame, consumers: Mapping[str, Consumer], checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Hands every micro-batch, read once, to each consumer in turn: consumer(batch, batch_id).

    Nothing is dropped: a slow consumer delays the next batch. A batch whose
    consumer failed is handed out again to all of them, under the same
    number, after a restart from the checkpoint; sinks should write by that
    number, as write_batch() does.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for consume in consumers.values():
                consume(batch, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def write_batch(path: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Consumer:
    """A consumer that writes each batch's (transformed) rows as Parquet below its number; a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
