"""Job event and streaming queries."""

from __future__ import annotations

import math
import os
import time
import uuid

from pyspark.sql import functions as F

from ..operators.backfill import completed_candidates
from ..operators.entities import dedupe_records
from ..operators.events import append_events, event_counts, is_terminal, latest_status, replay
from ..operators.extract import extract_candidates, split_pages
from ..operators.page_text import page_text
from ..operators.quality import run_stats
from ..operators.validate import accepted, validate_records
from ..plans.stages import materialise, run_folder
from ..spec import RecordSpec
from ..streaming.attempts import AttemptTable
from ..streaming.ingest import (
    RecordTable,
    ReplayTable,
    running_status,
    skipped_pages,
    stream_candidates,
    stream_distinct,
    write_records,
)
from ..streaming.leads import first_addresses, stream_completed, stream_contacts, stream_leads
from .frontier import ATTEMPTS_SQL, attempts_of
from .pages import REJECTS_SQL, spoiled_pages, supplier_cells, supplier_pages
from .records import LEADS, listing_pages, site_pages
from .registry import query

_STATUS = {"signup": "queued", "view": "discovering", "click": "extracting", "purchase": "completed", "error": "failed"}


def _events(load):
    """The event table as job events: user is the job, event type its status."""
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv]), F.col("event_type"))
    return load("events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(F.col("value") > 18, "summary").when(F.col("event_type") == "error", "error").otherwise("stage").alias("type"),
        F.when(F.col("event_type") == "error", "warn").otherwise("info").alias("level"),
        status.alias("status"),
    )


_EVENTS_SQL = """
    WITH e AS (SELECT 'job-' || user_id AS job_id, event_id AS seq, CASE WHEN value > 18 THEN 'summary' WHEN event_type = 'error' THEN 'error' ELSE 'stage' END AS type,
      CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level,
      CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'discovering' WHEN 'click' THEN 'extracting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)
"""


@query(
    _EVENTS_SQL
    + """, ends AS (SELECT job_id, min(seq) AS last FROM e WHERE type = 'summary' GROUP BY 1)
    SELECT job_id, seq, type, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS replay_no
    FROM e LEFT JOIN ends USING (job_id) WHERE last IS NULL OR seq <= last"""
)
def event_replay(spark, load):
    """History of every job up to its first summary."""
    return replay(_events(load)).select("job_id", "seq", "type", "replay_no")


@query(
    _EVENTS_SQL
    + "SELECT job_id, arg_max(status, seq) AS status, max(seq) AS last_seq, arg_max(status, seq) IN ('completed', 'failed') AS done FROM e GROUP BY 1"
)
def job_status(spark, load):
    return latest_status(_events(load))


@query(_EVENTS_SQL + "SELECT job_id, type, level, count(*) AS n FROM e GROUP BY ALL")
def event_type_counts(spark, load):
    return event_counts(_events(load))


#: Micro-batches in which a whole table passes as a stream.
BATCHES = 20
#: Buckets of the keyed tables, which live as long as a query here.
BUCKETS = 8


def _place(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream_of(spark, table, name: str, *order: str, batches: int = BATCHES):
    """A table cut by ``order`` into files, at least one for each partition of a shuffle, and read as a stream in that order.

    A file stream takes files by their time stamps, which tasks that write side by side
    leave in any order; they are set one after the other.
    """
    path = _place(spark, name)
    table.repartitionByRange(max(batches, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-"))
    begin = int(time.time() * 1000) - 1000 * len(parts)
    for i, part in enumerate(parts):
        files.setTimes(hadoop.Path(part), begin + 1000 * i, -1)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", math.ceil(len(parts) / batches))
    return reader.parquet(path)


def _drain(writer, base: str) -> None:
    """Drive a stream to the end of its files."""
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def _run(spark, stream, mode: str, name: str):
    """Drive a stream over its files to the end; its result as a table."""
    base = _place(spark, name)
    out = f"{base}/out"

    def keep(rows, batch_id):
        # The whole result of a complete-mode batch, or the rows of an append one.
        target = out if mode == "complete" else f"{out}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)

    _drain(stream.writeStream.outputMode(mode).foreachBatch(keep), base)
    return spark.read.parquet(out)


@query(_EVENTS_SQL + "SELECT DISTINCT job_id, status FROM e")
def stream_dedupe(spark, load):
    """One row per key over a whole stream, state carried across batches on disk."""
    events = _stream_of(spark, _events(load), "event-stream", "seq", batches=4)
    rows = stream_distinct(events.select("job_id", "status"), ["job_id", "status"])
    return _run(spark, rows, "append", "stream-dedupe").select("job_id", "status")


@query(
    _EVENTS_SQL
    + "SELECT job_id, arg_max(status, seq) AS status, max(seq) AS last_seq, arg_max(status, seq) IN ('completed', 'failed') AS done FROM e GROUP BY 1"
)
def stream_status(spark, load):
    """Latest status per job, kept up to date by a stream."""
    events = _stream_of(spark, _events(load), "event-stream", "seq", batches=4)
    last = _run(spark, running_status(events), "complete", "stream-status")
    return last.withColumn("done", is_terminal(F.col("status")))


@query(
    _EVENTS_SQL
    + """, ends AS (SELECT job_id, min(seq) AS last FROM e WHERE type = 'summary' GROUP BY 1)
    SELECT job_id, seq, type, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS replay_no
    FROM e LEFT JOIN ends USING (job_id) WHERE last IS NULL OR seq <= last"""
)
def stream_replay(spark, load):
    """The history of every job, numbered while its events arrive; one batch is delivered twice."""
    base = _place(spark, "stream-replay")
    table = ReplayTable(spark, f"{base}/table", buckets=BUCKETS)

    def write(rows, batch_id):
        table.write_batch(rows, batch_id)
        if batch_id == 1:
            table.write_batch(rows, batch_id)

    events = _stream_of(spark, _events(load), "event-stream", "seq", batches=8)
    _drain(events.writeStream.foreachBatch(write), base)
    return table.read().select("job_id", "seq", "type", "replay_no")


@query(
    _EVENTS_SQL.replace("SELECT 'job-'", "SELECT ts, 'job-'")
    + "SELECT job_id, seq, coalesce(ts, now()::TIMESTAMP) IS NOT NULL AS stamped, type, level, status FROM e"
)
def event_log(spark, load):
    """Events appended to a log in two parts; those without a time stamp get one."""
    path, events = _place(spark, "event-log"), _events(load).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in (0, 1):
        ts = F.when(F.col("seq") % 3 != 0, F.col("ts")).alias("ts")
        append_events(events.filter(F.col("seq") % 2 == part).withColumn("ts", ts), path)
    return spark.read.parquet(path).withColumn("stamped", F.col("ts").isNotNull()).drop("ts")


_SPEC = RecordSpec.of([("Company Name", "string", True), ("email", "email", True), ("website", "url"), ("balance", "number")])


def _page_stream(spark, load, cells=None, batches: int = BATCHES):
    """Directory pages of the suppliers, every page seen twice, in order of their rank."""
    pages = supplier_pages(load, cells).select("job_id", "page_rank", "url", "html")
    again = pages.withColumn("page_rank", F.col("page_rank") + 1_000_000)
    return _stream_of(spark, pages.unionByName(again), "page-stream", "page_rank", "job_id", batches=batches)


def _recorded(spark, load, name: str, targets=None, cells=None, batches: int = BATCHES) -> RecordTable:
    base = _place(spark, name)
    table = RecordTable(spark, f"{base}/table", _SPEC, buckets=BUCKETS)
    candidates = stream_candidates(_page_stream(spark, load, cells, batches), _SPEC)
    write_records(candidates, table, checkpoint=f"{base}/state", targets=targets).trigger(availableNow=True).start().awaitTermination()
    return table


_RECORD_SQL = """'nation-' || n_nationkey AS job_id, 'Supplier ' || s_suppkey AS company_name, 'sales@s' || s_suppkey || '.test' AS email,
    'https://s' || s_suppkey || '.test/' AS website, CAST(s_acctbal AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


@query(f"SELECT {_RECORD_SQL}")
def stream_records(spark, load):
    """Pages to records in 20 batches: every entity is written once."""
    return _recorded(spark, load, "stream-records").read().select("job_id", *_SPEC.headers)


@query(
    f"""SELECT {_RECORD_SQL} QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey)
      <= CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1000000000 END"""
)
def stream_targets(spark, load):
    """Pages to records; a job with a target stops there."""
    jobs = load("nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("job_id"),
        F.when(F.col("n_nationkey") % 2 == 0, 3).cast("int").alias("max_records"),
    )
    return _recorded(spark, load, "stream-targets", targets=jobs, batches=4).read().select("job_id", *_SPEC.headers)


def _gappy_cells():
    """Every tenth supplier has no e-mail."""
    return {**supplier_cells(), "Email": F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(supplier_cells()["Email"])}


_COUNTERS_SQL = """SELECT 'nation-' || n_nationkey AS job_id, 2 * count(DISTINCT s_suppkey // 100) AS pages, 2 * count(*) AS candidates,
      count(*) FILTER (s_suppkey % 10 <> 0) AS valid, 2 * count(*) FILTER (s_suppkey % 10 = 0) AS invalid,
      count(*) FILTER (s_suppkey % 10 <> 0) AS duplicates,
      coalesce(round(count(*) FILTER (s_suppkey % 10 <> 0) / (count(*) + count(*) FILTER (s_suppkey % 10 = 0)), 4), 0) AS validity_ratio
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey"""


@query(_COUNTERS_SQL)
def stream_counters(spark, load):
    """All counters of a job while its pages arrive: incomplete rows are invalid, pages seen again give duplicates."""
    return _recorded(spark, load, "stream-counters", cells=_gappy_cells(), batches=6).counters().drop("written")


@query(_COUNTERS_SQL)
def page_counters(spark, load):
    """The same counters from all pages at once: invalid rows, duplicates and pages that were read."""
    pages = supplier_pages(load, _gappy_cells()).select("job_id", "page_rank", "url", "html")
    again = pages.withColumn("page_rank", F.col("page_rank") + 1_000_000)
    seen = materialise(extract_candidates(page_text(pages.unionByName(again)), _SPEC, with_pages=True), "counted")
    found, log = split_pages(seen)
    return run_stats(validate_records(found, _SPEC), _SPEC, log)


@query(REJECTS_SQL)
def stream_skips(spark, load):
    """Raw pages as a stream: those that yield nothing, with the reason; the stream goes on."""
    pages = load("pages")
    place = pages.inputFiles()[0]
    folder, name = os.path.split(place)
    whole = os.path.basename(folder) == "pages.parquet"
    reader = spark.readStream.schema(pages.schema).option("pathGlobFilter", "*.parquet" if whole else name)
    return _run(spark, skipped_pages(spoiled_pages(reader.parquet(folder))), "append", "stream-skips").select("page_id", "reason")


@query(ATTEMPTS_SQL + "SELECT url, state, engine, attempt, text, reason FROM o")
def stream_fetch_results(spark, load):
    """The attempt that settled every url, while the fetch log arrives; urls that only failed close after a pause."""
    log = attempts_of(load)
    order = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    number = F.floor(F.col("attempt") / 10**9)
    # Blocks of 2000 orders: the first attempts of a whole block, then its second ones.
    block = F.floor(order / 2000)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + block * 20_000 + number * 2_500 + order % 2000)
    timed = log.withColumn("at", at)
    # Something that comes much later ends the last pause.
    last = log.limit(1).withColumn("at", F.timestamp_seconds(F.lit(4_000_000_000))).withColumn("url", F.lit("https://later.test/"))
    base = _place(spark, "stream-attempts")
    table = AttemptTable(spark, f"{base}/table", pause="1 hour", buckets=BUCKETS)
    stream = _stream_of(spark, timed.unionByName(last), "attempt-stream", "at", batches=6)
    _drain(stream.writeStream.foreachBatch(table.write_batch), base)
    out = table.read().filter("url <> 'https://later.test/'")
    return out.select("url", "state", "engine", "attempt", "text", "reason")


@query(
    """SELECT 'nation-' || n_nationkey AS job_id, 'Supplier ' || s_suppkey AS company_name, 'sales@s' || s_suppkey || '.test' AS email,
      'https://s' || s_suppkey || '.test' AS website FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 < 2"""
)
def stream_backfill(spark, load):
    """Listings without e-mails, completed when the pages of their sites arrive: a join of two streams."""
    listing = listing_pages(load).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_rank") % 3600))
    sites = site_pages(load).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("url"), F.lit(7200))))
    leads = stream_leads(_stream_of(spark, listing, "listing-stream", "at", batches=3), LEADS)
    contacts = stream_contacts(_stream_of(spark, sites, "site-stream", "at", batches=3))
    found = _run(spark, stream_completed(leads, contacts), "append", "stream-backfill")
    completed = validate_records(completed_candidates(first_addresses(found).withColumn("lead_no", F.lit(1)), LEADS), LEADS)
    return dedupe_records(accepted(completed), LEADS).select("job_id", *LEADS.headers)
