"""The second wave as a stream: open leads meet the pages of their sites when these arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.backfill import lead_pages, near_misses, page_contacts
from ..operators.extract import extract_candidates
from ..operators.page_text import page_text
from ..plans.stages import first_per_key
from ..spec import RecordSpec
from .ingest import use_disk_state


def stream_leads(pages: DataFrame, spec: RecordSpec, *, at: str = "at", late: str = "1 hour") -> DataFrame:
    """One row per (job, website) of a stream of listing pages: what lacks only an e-mail, and its event time."""
    use_disk_state(pages.sparkSession)
    found = extract_candidates(page_text(pages), spec, keys=("job_id", "page_rank", at))
    near = near_misses(found, spec, keep=(at,)).withWatermark(at, late)
    return near.dropDuplicatesWithinWatermark(["job_id", "website"])


def stream_contacts(pages: DataFrame, *, at: str = "at", late: str = "1 hour") -> DataFrame:
    """canonical, email and event time of a stream of site pages that name an address."""
    return page_contacts(page_text(pages), keep=(at,)).withWatermark(at, late)


def stream_completed(leads: DataFrame, contacts: DataFrame, *, wait: str = "24 hours") -> DataFrame:
    """Leads with the addresses of their pages: a row for each page of a lead that arrived within ``wait``.

    An outer join of two streams.  A lead waits in state until the watermark of both
    streams has passed its time by ``wait``; pages that did not come by then give a row
    without an e-mail, and state is dropped.
    """
    seen = leads.withColumnRenamed("at", "lead_at")
    pages = lead_pages(seen.withColumn("lead_no", F.lit(0)), keep=("lead_at",)).drop("page", "lead_no")
    other = contacts.select(F.col("canonical").alias("page_canonical"), "email", F.col("at").alias("page_at"))
    near = F.expr(
        f"canonical = page_canonical AND page_at >= lead_at - INTERVAL {wait} AND page_at <= lead_at + INTERVAL {wait}"
    )
    return pages.join(other, near, "left_outer").drop("page_canonical")


def first_addresses(completed: DataFrame) -> DataFrame:
    """The address of each lead from the first of its pages that has one."""
    found = completed.filter("email IS NOT NULL")
    one = found.groupBy("job_id", "website", "company", "page_no").agg(F.min("email").alias("email"))
    return first_per_key(one, ["job_id", "website"], ["page_no", "company"])
