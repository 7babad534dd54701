"""Search results to a ranked frontier of unique urls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BLOCKED_URL_PATTERNS,
    DIRECTORY_HINT,
    NEWS_HINT,
    STOP_WORDS,
)
from ..functions.text import match_all, one_of, q, strip
from ..functions.urls import is_binary_url, is_blocked_url, is_http, is_site_search, path_of
from ..plans.stages import first_per_key, top_per_key

#: Parts into which the results of one job are dealt when they meet its intent.
JOB_PARTS = 32

_ORDER = ["__hits_key", "__hint_key", "__news_key", "rank"]


def intent_tokens(intent: str) -> str:
    """Distinct content words of an intent."""
    words = match_all(f"lower(coalesce({intent}, ''))", "[a-z0-9]{3,}")
    return f"array_distinct(filter({words}, w -> NOT {one_of('w', STOP_WORDS)}))"


def relevance_hits(tokens: str, text: str) -> str:
    """How many tokens, or their five-letter stems, the lower-case text contains."""
    return (
        f"size(filter({tokens}, t -> contains({text}, t) "
        f"OR (length(t) >= 5 AND contains({text}, left(t, 5)))))"
    )


def score_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Relevance of every result to its job's intent.

    Adds ``tokens``, ``hits``, ``is_seed``, ``thin`` (fewer than three tokens:
    too little to judge by), ``on_topic`` and the sort keys.

    Intents are one narrow row for each job.  Few of them go to the results; many are
    copied to ``JOB_PARTS`` parts of their job, which are told apart by url, so that no
    task gets a large job whole.
    """
    intents = jobs.select("job_id", F.expr(intent_tokens("intent")).alias("tokens"))
    intents = intents.select("*", F.explode(F.sequence(F.lit(0), F.lit(JOB_PARTS - 1))).alias("__part"))
    part = F.pmod(F.xxhash64("url"), F.lit(JOB_PARTS)).cast("int")
    text = f"concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''), {path_of('url')})"
    read = results.withColumn("__part", part).join(intents, ["job_id", "__part"]).drop("__part").select(
        "*",
        F.lower(F.expr(text)).alias("__text"),
        (F.col("engine") == "seed").alias("is_seed"),
        (F.size("tokens") < 3).alias("thin"),
    )
    scored = read.select("*", F.expr(relevance_hits("tokens", "__text")).alias("hits"))
    return scored.selectExpr(
        "*",
        f"thin OR is_seed OR (NOT {is_site_search('url')} AND hits >= 2) AS on_topic",
        "CASE WHEN thin THEN 0 WHEN is_seed THEN -10000 ELSE -hits END AS __hits_key",
        f"CASE WHEN NOT thin AND NOT is_seed AND __text RLIKE {q(DIRECTORY_HINT)} THEN -1 ELSE 0 END AS __hint_key",
        f"CASE WHEN NOT thin AND NOT is_seed AND url RLIKE {q(NEWS_HINT)} THEN 1 ELSE 0 END AS __news_key",
    ).drop("__text")


def _is_fetchable(blocked: Sequence[str]) -> str:
    return f"{is_http('url')} AND NOT {is_blocked_url('url', blocked)} AND NOT {is_binary_url('url')}"


def fetchable(results: DataFrame, blocked: Sequence[str] = BLOCKED_URL_PATTERNS) -> DataFrame:
    """Results whose url is http(s), not on the block list and not a binary file."""
    return results.withColumn("url", F.expr(strip("url"))).filter(_is_fetchable(blocked))


def build_frontier(
    results: DataFrame,
    jobs: DataFrame,
    *,
    blocked: Sequence[str] = BLOCKED_URL_PATTERNS,
    max_pages: int | None = None,
) -> DataFrame:
    """Unique urls of every job in fetch order: ``page_rank`` 1, 2, …

    Filters run first; then the first result of every (job, url) and the first
    ``max_pages`` of every job are kept, if the caller sets a number; small numbers are
    cut inside the map tasks before their shuffle.
    """
    scored = score_results(fetchable(results, blocked), jobs).filter("on_topic").drop("tokens", "snippet")
    unique = first_per_key(scored, ["job_id", "url"], _ORDER)
    ranked = top_per_key(unique, ["job_id"], [*_ORDER, "url"], max_pages, "page_rank")
    return ranked.select("job_id", "url", "page_rank", "hits", "is_seed", "title", "engine", "query")


def frontier_funnel(
    results: DataFrame, jobs: DataFrame, *, blocked: Sequence[str] = BLOCKED_URL_PATTERNS
) -> DataFrame:
    """Per job: raw results, on-topic results and unique urls queued."""
    scored = score_results(results.withColumn("url", F.expr(strip("url"))), jobs)
    queued = F.expr(f"on_topic AND {_is_fetchable(blocked)}")
    # One row per (job, url) after the partial aggregation, then one per job.
    per_url = scored.groupBy("job_id", "url").agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if("on_topic").alias("on_topic"),
        F.max(queued.cast("int")).alias("queued"),
    )
    return per_url.groupBy("job_id").agg(
        F.sum("raw").alias("raw_results"),
        F.sum("on_topic").alias("on_topic_results"),
        F.sum("queued").alias("unique_queued"),
    )


def query_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("job_id", "query").agg(F.count(F.lit(1)).alias("n_results"))
