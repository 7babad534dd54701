"""Page and event streams: the batch operators applied to micro-batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.entities import entity_key
from ..operators.extract import extract_candidates
from ..operators.page_text import page_text
from ..operators.quality import validity_ratio
from ..operators.validate import accepted, validate_records
from ..plans.stages import first_per_key, wide_row_number
from ..spec import RecordSpec
from .state import KeyedTable, StreamTarget


def read_page_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_candidates(pages: DataFrame, spec: RecordSpec, *, keys: Sequence[str] = ("job_id", "page_rank")) -> DataFrame:
    """Typed candidates of a page stream; stateless, so each page's rows leave at once.

    A page without candidates keeps one row, whose ``cand_idx`` is null, and pages that
    yield nothing have the reason in ``reject``, so one pass gives records and counters.
    """
    return validate_records(extract_candidates(page_text(pages), spec, keys=keys, with_pages=True), spec)


def stream_distinct(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key over the whole stream, state kept for every key.

    The keys never expire, as a later page may repeat any record; the session is set to
    the RocksDB state store, so the state lives on disk and in checkpoints rather than
    on the heap.
    """
    use_disk_state(rows.sparkSession)
    return rows.dropDuplicates(list(keys))


def use_disk_state(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def running_status(events: DataFrame, *, status: str = "status", seq: str = "seq") -> DataFrame:
    """Latest status per job over an event stream (update or complete mode)."""
    use_disk_state(events.sparkSession)
    return events.groupBy("job_id").agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("last_seq"))


_COUNTS = ("pages", "candidates", "valid", "invalid", "written")
_KEYS = KeyedTable("keys", "job_id string, entity string", ("job_id", "entity"), {})
_COUNTERS = KeyedTable(
    "counters", "job_id string, " + ", ".join(f"{c} long" for c in _COUNTS), ("job_id",), {c: f"sum({c})" for c in _COUNTS}
)


class RecordTable:
    """Target of a page stream: first record of every entity, each once, and the job's counters.

    Tables: ``records``, ``skipped`` (pages that gave nothing, with the reason), ``keys``
    (every entity seen, as a digest) and ``counters`` (what each batch adds).  All of a
    batch appears at once, and a batch that is delivered again changes nothing.  A batch
    reads the key buckets that it touches, not all earlier keys.  ``buckets`` is chosen
    once, so that a bucket's keys are some files of a usual size.
    """

    def __init__(
        self, spark: SparkSession, path: str, spec: RecordSpec, *, order: Sequence[str] = ("page_rank", "cand_idx"), buckets: int = 64
    ):
        self.spark, self.path, self.spec, self.order = spark, path, spec, list(order)
        self.tables = [replace(t, buckets=buckets) for t in (_KEYS, _COUNTERS)]
        self.target = StreamTarget(spark, path, self.tables)

    def write_batch(self, rows: DataFrame, batch_id: int, targets: DataFrame | None = None) -> None:
        """Add one micro-batch of ``stream_candidates``: new entities, up to each job's target, and counters.

        Counters cover all rows, also those beyond a job's target.
        """
        target = StreamTarget(rows.sparkSession, self.path, self.tables)
        batch = target.begin(batch_id)
        if batch is None:
            return
        has_pages = "reject" in rows.columns
        entity = F.when(F.size("errors") == 0, F.sha2(F.expr(entity_key(self.spec)), 256))
        # Pages are read once: what follows works on the typed rows.
        seen = batch.add("batch", rows.withColumn("__entity", entity))
        found = seen.filter("cand_idx IS NOT NULL")
        firsts = first_per_key(accepted(found.filter("__entity IS NOT NULL")), ["job_id", "__entity"], self.order)
        firsts = firsts.withColumnRenamed("__entity", "entity")
        fresh = firsts.join(batch.earlier("keys", firsts), ["job_id", "entity"], "left_anti")
        fresh = batch.add("fresh", fresh)
        batch.add("keys", fresh.select("job_id", "entity"))
        kept = fresh
        if targets is not None:
            had = batch.earlier("counters", fresh).select("job_id", F.col("written").alias("__had"))
            ranked = wide_row_number(fresh, ["job_id"], [*self.order, "entity"], "__no")
            room = F.col("max_records") - F.coalesce("__had", F.lit(0))
            kept = (
                ranked.join(targets.select("job_id", "max_records"), "job_id", "left")
                .join(had, "job_id", "left")
                .filter(room.isNull() | (F.col("__no") <= room))
                .drop("__no", "max_records", "__had")
            )
        records = batch.add("records", kept.drop("entity", "reject"))
        by_job = [
            found.groupBy("job_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.size("errors") > 0).alias("invalid")),
            fresh.groupBy("job_id").agg(F.count(F.lit(1)).alias("valid")),
            records.groupBy("job_id").agg(F.count(F.lit(1)).alias("written")),
        ]
        if has_pages:
            first = F.coalesce(F.col("cand_idx"), F.lit(0)) == 0
            by_job.append(seen.filter(first & F.col("reject").isNull()).groupBy("job_id").agg(F.count(F.lit(1)).alias("pages")))
            skipped = seen.filter("reject IS NOT NULL").select("job_id", "page_rank", F.col("source_url").alias("url"), F.col("reject").alias("reason"))
            batch.add("skipped", skipped)
        parts = [p.select("job_id", *[(F.col(c) if c in p.columns else F.lit(0).cast("long")).alias(c) for c in _COUNTS]) for p in by_job]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        batch.add("counters", _COUNTERS.merged(every))
        for name in ("batch", "fresh"):  # only of use inside the batch
            for folder in batch.tables.pop(name):
                target.log.remove(folder["path"])
        batch.commit()

    def read(self) -> DataFrame:
        """All records so far; before the first batch there is no table."""
        return self.target.read("records")

    def skipped(self) -> DataFrame:
        return self.target.read("skipped", "job_id string, page_rank long, url string, reason string")

    def counters(self) -> DataFrame:
        """pages, candidates, valid, invalid, duplicates and validity ratio of every job so far."""
        sums = self.target.read("counters")
        return sums.select(
            "job_id", "pages", "candidates", "valid", "invalid",
            (F.col("candidates") - F.col("valid") - F.col("invalid")).alias("duplicates"),
            validity_ratio(F.col("valid"), F.col("invalid")).alias("validity_ratio"),
            "written",
        )


def write_records(
    candidates: DataFrame,
    table: RecordTable,
    *,
    checkpoint: str,
    targets: DataFrame | None = None,
) -> DataStreamWriter:
    """Stream typed candidates into a ``RecordTable``."""
    return (
        candidates.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: table.write_batch(rows, batch_id, targets))
    )


_LEDGER = KeyedTable(
    "ledger", "job_id string, last_no long, closed boolean", ("job_id",), {"last_no": "max(last_no)", "closed": "bool_or(closed)"}
)


class ReplayTable:
    """Live replay: events numbered per job as they arrive, until the job's first summary.

    The ledger has each job's last number and whether it is closed.  Events of a batch
    follow their ``seq`` and go on from the ledger; what arrives after a job's summary is
    history of no replay.  A batch that is delivered again keeps its numbers.
    """

    def __init__(self, spark: SparkSession, path: str, *, seq: str = "seq", buckets: int = 64):
        self.path, self.seq = path, seq
        self.tables = [replace(_LEDGER, buckets=buckets)]
        self.target = StreamTarget(spark, path, self.tables)

    def write_batch(self, events: DataFrame, batch_id: int) -> None:
        target = StreamTarget(events.sparkSession, self.path, self.tables)
        batch = target.begin(batch_id)
        if batch is None:
            return
        arrived = batch.add("batch", events)
        known = batch.earlier("ledger", arrived)
        ends = arrived.filter(F.col("type") == "summary").groupBy("job_id").agg(F.min(self.seq).alias("__end"))
        open_ = (
            arrived.join(known, "job_id", "left")
            .filter("NOT coalesce(closed, false)")
            .join(ends, "job_id", "left")
            .filter(F.col("__end").isNull() | (F.col(self.seq) <= F.col("__end")))
            .withColumn("__before", F.coalesce("last_no", F.lit(0).cast("long")))
            .drop("last_no", "closed", "__end")
        )
        numbered = wide_row_number(open_, ["job_id"], [self.seq], "__no")
        numbered = numbered.withColumn("replay_no", F.col("__before") + F.col("__no")).drop("__before", "__no")
        replayed = batch.add("replay", numbered)
        batch.add(
            "ledger",
            replayed.groupBy("job_id").agg(F.max("replay_no").alias("last_no"), F.bool_or(F.col("type") == "summary").alias("closed")),
        )
        for folder in batch.tables.pop("batch"):
            target.log.remove(folder["path"])
        batch.commit()

    def read(self) -> DataFrame:
        return self.target.read("replay")


def skipped_pages(pages: DataFrame) -> DataFrame:
    """Pages of a stream that yield nothing, with the reason; never an exception."""
    return page_text(pages).filter(F.col("reject").isNotNull()).select(
        *[c for c in pages.columns if c != "html"], F.col("reject").alias("reason")
    )
