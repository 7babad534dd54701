"""Fetch attempts as a stream: a url is settled by its first success or refusal, or after a pause."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BLOCK_STATUS, BLOCKED_URL_PATTERNS
from ..operators.fetches import FETCH_ORDER, settled_attempts
from ..plans.stages import first_per_key
from .state import KeyedTable, StreamTarget

_FAILURE = "struct<rank: int, attempt: long, engine: string, status: int, reason: string>"
#: One session per url: whether it is settled, when it was tried last, and its last failure; no bodies.
_SESSIONS = KeyedTable(
    "sessions",
    f"url string, settled boolean, last_at timestamp, failure {_FAILURE}",
    ("url",),
    {"settled": "bool_or(settled)", "last_at": "max(last_at)", "failure": "max(failure)"},
)
_COLUMNS = ["url", "state", "engine", "attempt", "status", "text", "reason"]


class AttemptTable:
    """What settled every url, as ``fetch_outcomes`` gives it for a whole log.

    A success or a refusal is there with its batch, and later attempts of the url change
    nothing.  A url that only failed is open until the log has gone on for ``pause``
    beyond its last attempt; then its last failure counts.  A batch reads the sessions of
    its own urls; a batch that is delivered again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, *, pause: str = "30 minutes", at: str = "at", buckets: int = 64):
        self.spark, self.path, self.pause, self.at = spark, path, pause, at
        self.tables = [replace(_SESSIONS, buckets=buckets)]
        self.target = StreamTarget(spark, path, self.tables)

    def write_batch(
        self,
        attempts: DataFrame,
        batch_id: int,
        *,
        order: Sequence[str] = FETCH_ORDER,
        block_status: Sequence[int] = BLOCK_STATUS,
        blocked: Sequence[str] = BLOCKED_URL_PATTERNS,
    ) -> None:
        """Add one micro-batch of a fetch log with an event time."""
        target = StreamTarget(attempts.sparkSession, self.path, self.tables)
        batch = target.begin(batch_id)
        if batch is None:
            return
        judged = settled_attempts(attempts, order=order, block_status=block_status, blocked=blocked)
        rows = judged.select(
            "url", F.col(self.at).cast("timestamp").alias("at"), F.col("__rank").cast("int").alias("rank"), "engine",
            F.col("attempt").cast("long").alias("attempt"), F.col("status").cast("int").alias("status"), "outcome", "text", "reason",
        )
        seen = batch.add("batch", rows)
        known = batch.earlier("sessions", seen.select("url")).filter("settled").select("url")
        open_ = seen.join(known, "url", "left_anti")
        firsts = first_per_key(open_.filter("outcome <> 'error'"), ["url"], ["rank", "attempt"])
        state = F.when(F.col("outcome") == "ok", "scraped").otherwise("skipped").alias("state")
        batch.add("settled", firsts.select("url", state, *_COLUMNS[2:]))
        failure = F.when(F.col("outcome") == "error", F.struct("rank", "attempt", "engine", "status", "reason"))
        sessions = open_.groupBy("url").agg(
            F.bool_or(F.col("outcome") != "error").alias("settled"), F.max("at").alias("last_at"), F.max(failure).alias("failure")
        )
        batch.add("sessions", sessions)
        for folder in batch.tables.pop("batch"):
            target.log.remove(folder["path"])
        batch.commit()

    def read(self) -> DataFrame:
        """One row for every url that is settled, or whose attempts have paused for long enough."""
        schema = "url string, state string, engine string, attempt long, status int, text string, reason string"
        settled = self.target.read("settled", schema)
        sessions = self.target.read("sessions")
        latest = sessions.agg(F.max("last_at").cast("string")).first()[0]
        paused = sessions.filter("NOT settled").filter(F.expr(f"last_at + INTERVAL {self.pause}") <= F.lit(latest).cast("timestamp"))
        failed = paused.select(
            "url", F.lit("skipped").alias("state"), "failure.engine", "failure.attempt", "failure.status",
            F.lit(None).cast("string").alias("text"), "failure.reason",
        )
        return settled.unionByName(failed)
