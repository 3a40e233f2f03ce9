"""New partitions of the event log, cubes that follow.

Structured Streaming keeps track of which files have been seen; each batch names
the days that it touches, and the batch builder makes those days again in one build (a late
partition also concerns the day before and the day after).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pathloom.plans.builder import Builder
from pathloom.plans.cubes import CUBES
from pathloom.plans.vocabulary import StateDict


def touched(days: Sequence[str]) -> list[str]:
    """Build days that an event in one of these partitions may belong to."""
    out = {date.fromisoformat(d) + timedelta(days=k) for d in days for k in (-1, 0, 1)}
    return [d.isoformat() for d in sorted(out)]


def follow(spark: SparkSession, path: str, schema: str, builder: Builder, vocabulary: StateDict, checkpoint: str, names: Sequence[str] = CUBES, day_column: str = "date_id") -> StreamingQuery:
    """Builds the days of all files that are new since the last call, then stops."""

    def rebuild(batch: DataFrame, _: int) -> None:
        days = [r[0] for r in batch.select(day_column).where(f"{day_column} is not null").distinct().collect()]
        report = builder.build_days(touched(days), vocabulary, names, refresh=True)
        if report.failed:
            raise RuntimeError(report.failed)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
