"""Counters, validity ratio and job summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import VALIDITY_BAR
from ..spec import RecordSpec
from .entities import entity_key

NO_RECORDS = "the pages that were read gave no record with all required fields"


def validity_ratio(valid: Column, invalid: Column) -> Column:
    """valid / (valid + invalid) to four places; 0 when there is neither."""
    return F.coalesce(F.round(F.try_divide(valid.cast("double"), (valid + invalid).cast("double")), 4), F.lit(0.0))


def run_stats(validated: DataFrame, spec: RecordSpec, pages: DataFrame | None = None) -> DataFrame:
    """Per job: pages, candidates, valid, invalid, duplicates and validity ratio.

    One pass over the candidates.  They are counted per entity first, so rows
    are reduced inside the map tasks and a job of any size is spread over its
    keys; the second aggregation adds up one number per task and job.
    """
    entity = F.when(F.size("errors") == 0, F.sha2(F.expr(entity_key(spec)), 256))
    per_entity = (
        validated.select("job_id", entity.alias("__entity")).groupBy("job_id", "__entity").agg(F.count(F.lit(1)).alias("n"))
    )
    stats = per_entity.groupBy("job_id").agg(
        F.sum("n").alias("candidates"),
        F.count("__entity").alias("valid"),
        F.sum(F.when(F.col("__entity").isNull(), F.col("n")).otherwise(0)).alias("invalid"),
    )
    if pages is not None:
        read = pages.filter(F.col("reject").isNull()).groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"))
        stats = read.join(stats, "job_id", "full")

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long")

    return stats.select(
        "job_id",
        *([number("pages").alias("pages")] if pages is not None else []),
        number("candidates").alias("candidates"),
        number("valid").alias("valid"),
        number("invalid").alias("invalid"),
        (number("candidates") - number("valid") - number("invalid")).alias("duplicates"),
        validity_ratio(number("valid"), number("invalid")).alias("validity_ratio"),
    )


def quality_note(stats: DataFrame) -> DataFrame:
    """Add ``note`` where the validity ratio misses the bar."""
    percent = F.format_string("validity ratio %.0f%% below 90%% target", F.col("validity_ratio") * 100)
    return stats.withColumn(
        "note", F.when((F.col("candidates") > 0) & (F.col("validity_ratio") < VALIDITY_BAR), percent)
    )


def listed_outputs(outputs: DataFrame) -> DataFrame:
    """The outputs of every job as a list, in the order of their columns; a job has a few."""
    one = F.struct(*[c for c in outputs.columns if c != "job_id"])
    return outputs.groupBy("job_id").agg(F.array_sort(F.collect_list(one)).alias("outputs"))


def job_summary(
    jobs: DataFrame,
    stats: DataFrame,
    exported: DataFrame,
    *,
    frontier: DataFrame | None = None,
    skipped: DataFrame | None = None,
    queries: DataFrame | None = None,
    pages: DataFrame | None = None,
    outputs: DataFrame | None = None,
) -> DataFrame:
    """One row per job: status, counts, notes, error.

    A job with an empty intent, without a source page or without a record has
    failed.  Planned queries and outputs are listed, as a job has few; pages read and
    skips are counted, and their rows stay in their own tables, as a job may have any
    number of them.  Jobs with a ``started_at`` get a duration.
    """
    started = [c for c in ("started_at",) if c in jobs.columns]
    out = jobs.select("job_id", "intent", *started).join(quality_note(stats), "job_id", "left")
    out = out.join(
        exported.groupBy("job_id").agg(F.count(F.lit(1)).alias("records_exported")), "job_id", "left"
    )
    if frontier is not None:
        out = out.join(frontier.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages_queued")), "job_id", "left")
    if skipped is not None:
        out = out.join(skipped.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages_skipped")), "job_id", "left")
    if queries is not None:
        listed = queries.groupBy("job_id").agg(
            F.array_sort(F.collect_list(F.struct("query_no", "query"))).alias("__q")
        )
        out = out.join(listed.select("job_id", F.transform("__q", lambda x: x["query"]).alias("queries")), "job_id", "left")
    if pages is not None:
        read = pages.filter(F.col("reject").isNull()).groupBy("job_id").agg(F.count(F.lit(1)).alias("pages_scraped"))
        out = out.join(read, "job_id", "left")
    if outputs is not None:
        out = out.join(listed_outputs(outputs), "job_id", "left")
    counts = [
        c for c in ("records_exported", "pages_queued", "pages_skipped", "pages_scraped", "candidates", "valid", "invalid", "duplicates")
        if c in out.columns
    ]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts})
    no_source = (F.col("pages_queued") == 0) if frontier is not None else F.lit(False)
    error = (
        F.when(F.trim("intent") == "", "intent is empty")
        .when(no_source, "no source pages")
        .when(F.col("records_exported") == 0, NO_RECORDS)
    )
    if started:
        elapsed = F.current_timestamp().cast("double") - F.col("started_at").cast("timestamp").cast("double")
        out = out.withColumn("duration_seconds", F.round(elapsed, 2))
    return out.withColumns(
        {
            "error": error,
            "validity_ratio": F.coalesce("validity_ratio", F.lit(0.0)),
        }
    ).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
