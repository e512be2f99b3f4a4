"""Update-mode results as a table: every micro-batch writes its changed rows under its own id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "update",
) -> StreamingQuery:
    """Process everything available now, calling ``write(batch, batch_id)`` per micro-batch; the ended query."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Write a batch to its own folder; a repeated batch replaces its earlier attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The last written values per key."""
    last = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return table.groupBy(*keys).agg(last).select(*keys, "_v.*")
