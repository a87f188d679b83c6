"""Progress events of independent units of work: one failing unit never stops the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "unit_id string, kind string, detail string"


def run_units(units: DataFrame, work: Callable[[str, str], str], unit: str, payload: str) -> DataFrame:
    """Apply ``work(unit_id, payload)`` to every row; yields started and completed or failed events.

    Works on batch and streaming tables alike, since no unit needs another one.
    """

    def attempt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, text in zip(frame[unit].astype(str), frame[payload]):
                rows.append((name, "unit_started", None))
                try:
                    rows.append((name, "unit_completed", work(name, text)))
                except Exception as error:  # the unit's own failure is its result
                    rows.append((name, "unit_failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["unit_id", "kind", "detail"])

    return units.select(unit, payload).mapInPandas(attempt, EVENT_SCHEMA)


def run_status(events: DataFrame) -> DataFrame:
    """completed, partial or fatal, with the number of units of each kind."""
    counted = events.agg(
        F.count_if(F.col("kind") == "unit_completed").alias("n_completed"),
        F.count_if(F.col("kind") == "unit_failed").alias("n_failed"),
    )
    return counted.withColumn(
        "status",
        F.when(F.col("n_failed") == 0, "completed").when(F.col("n_completed") > 0, "partial").otherwise("fatal"),
    )


def stream_event_lines(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the events of a streaming table as JSON lines until the input is used up."""
    lines = events.select(F.to_json(F.struct("unit_id", "kind", "detail")).alias("value"))
    return (
        lines.writeStream.format("text")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
