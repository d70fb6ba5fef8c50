"""Labelling comments as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame

from modlytics.operators.moderation import moderate, normalise


def moderate_stream(landed: DataFrame, tasks: int | None = None) -> DataFrame:
    """The batch transform on a streaming DataFrame: row by row, so no state and no watermark.

    ``tasks`` deals the rows of a micro-batch out before the rules run; give it where few files land
    at a time, since each of them would otherwise be one task.
    """
    rows = landed.repartition(tasks) if tasks else landed
    return moderate(normalise(rows))


def drain(labelled: DataFrame, path: str, progress: str) -> None:
    """Write what has landed so far to parquet and stop.

    ``progress`` is a folder in shared storage: the next call goes on from there, and each landed
    file is written once.
    """
    query = (
        labelled.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
