"""Job events: append, replay, latest status, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TERMINAL_STATES
from ..plans.stages import wide_row_number


def stamp_events(events: DataFrame) -> DataFrame:
    """Give events without a time stamp the current time."""
    return events.withColumn("ts", F.coalesce(F.col("ts"), F.current_timestamp().cast("timestamp_ntz")))


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event log, a Parquet table; order is kept in ``seq``."""
    stamp_events(events).write.mode("append").parquet(path)


def replay(events: DataFrame, *, seq: str = "seq") -> DataFrame:
    """History of every job up to and including its first summary.

    The end of a job is one aggregated number, so no task ever holds all events
    of a job; ``seq`` is unique in a job.  Positions are written when this is called.
    """
    ends = events.filter(F.col("type") == "summary").groupBy("job_id").agg(F.min(seq).alias("__end"))
    kept = events.join(ends, "job_id", "left").filter(
        F.col("__end").isNull() | (F.col(seq) <= F.col("__end"))
    )
    return wide_row_number(kept.drop("__end"), ["job_id"], [seq], "replay_no")


def latest_status(events: DataFrame, *, status: str = "status", seq: str = "seq") -> DataFrame:
    """Last status of every job and whether it is terminal."""
    last = events.groupBy("job_id").agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("last_seq"))
    return last.withColumn("done", is_terminal(F.col("status")))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATES)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("job_id", "type", "level").agg(F.count(F.lit(1)).alias("n"))
