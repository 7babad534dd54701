"""The whole job: search results and pages to deduplicated records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators.backfill import backfill_candidates, collect_leads, lead_pages, open_leads, page_contacts
from ..operators.entities import dedupe_records, limit_records
from ..operators.extract import attach_pages, extract_candidates, prefer_given, split_pages
from ..operators.fetches import skip_report
from ..operators.frontier import build_frontier
from ..operators.page_text import page_text
from ..operators.quality import job_summary, listed_outputs, run_stats
from ..operators.validate import accepted, validate_records
from ..spec import RecordSpec
from .stages import first_per_key, materialise


@dataclass
class Harvest:
    """Result tables of a run.  Intermediate tables are written while the run is set up; these are lazy."""

    frontier: DataFrame
    records: DataFrame
    validated: DataFrame
    leads: DataFrame
    skipped: DataFrame
    stats: DataFrame
    summary: DataFrame

    def report(self, outputs: DataFrame) -> DataFrame:
        """The summary with each job's outputs (job_id, format, path, rows, error)."""
        return self.summary.join(listed_outputs(outputs), "job_id", "left")


def corpus_by_url(pages: DataFrame, wanted: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One page per canonical url among the ``wanted`` ones.

    Which capture of a url is taken is decided on urls alone, and the choice is written.
    Its size is known then: a small choice goes to the scan, a large one is joined by url.
    ``wanted`` has the column ``canonical``.  A url is captured once in ``pages``.
    """
    needed = wanted.select("canonical").distinct()
    urls = pages.select(F.expr(canonical_url(f"`{url}`")).alias("canonical"), F.col(url).alias("__captured")).distinct()
    chosen = materialise(first_per_key(urls.join(needed, "canonical", "left_semi"), ["canonical"], ["__captured"]), "captures")
    found = pages.select(F.col(url).alias("__captured"), F.col(html).alias("html"))
    return found.join(chosen, "__captured").select("canonical", "html")


def run_harvest(
    spec: RecordSpec,
    jobs: DataFrame,
    results: DataFrame,
    pages: DataFrame,
    *,
    given: DataFrame | None = None,
    answered: DataFrame | None = None,
    queries: DataFrame | None = None,
    max_pages: int | None = None,
    backfill: bool = True,
) -> Harvest:
    """Run all jobs that share one record schema.

    ``jobs``: job_id, intent, max_records.  ``results``: job_id, rank, title, url,
    snippet, engine, query.  ``pages``: url, html.  ``given`` candidates replace
    the heuristic ones of the ``answered`` pages, both by (job_id, canonical
    url); see ``prefer_given``.  ``queries`` (job_id, query_no, query) are listed in the
    summary.
    """
    frontier = build_frontier(results, jobs, max_pages=max_pages).withColumn("canonical", F.expr(canonical_url("url")))
    frontier = materialise(frontier, "frontier")
    corpus = corpus_by_url(pages, frontier)
    # Candidates depend on the page and the schema alone: a page wanted by many
    # jobs is rendered and read once, and only its candidates are joined to them.
    text = page_text(corpus, url="canonical")
    if given is not None:
        text = materialise(text, "text")  # read twice: by the heuristics and for the given candidates
    read = extract_candidates(text, spec, keys=(), url="canonical", with_pages=True)
    seen = frontier.select("job_id", "page_rank", "canonical").join(read, "canonical").withColumnRenamed("canonical", "url")
    seen = materialise(seen, "candidates")
    candidates, page_log = split_pages(seen)
    if given is not None:
        ranks = page_log.filter(F.col("reject").isNull()).select("job_id", "url", "page_rank")
        given = attach_pages(given.drop("page_rank").join(ranks, ["job_id", "url"]), text, spec, text_url="canonical")
        answered = given.select("job_id", "url") if answered is None else answered
        candidates = prefer_given(candidates, given, answered, ["job_id", "url"])
    # Read by the first wave, the records and the counters.
    validated = materialise(validate_records(candidates, spec).withColumn("wave", F.lit(1)), "validated")
    order = ["wave", "page_rank", "cand_idx"]

    missing = (
        frontier.select("job_id", F.col("canonical").alias("url"))
        .join(page_log, ["job_id", "url"], "left_anti")
        .withColumn("reason", F.lit("page not in corpus"))
    )
    skipped = skip_report(missing, page_log)

    first_wave = dedupe_records(accepted(validated), spec, order=order)
    everything = validated
    leads = collect_leads(candidates, spec)
    if backfill and spec.first("email") and spec.name_field and spec.first("url"):
        counts = first_wave.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_records"))
        leads = materialise(
            open_leads(
                leads,
                page_log.filter(F.col("reject").isNull()).select("job_id", "url"),
                record_counts=counts,
                targets=jobs,
            ),
            "leads",
        )
        visits = corpus_by_url(pages, lead_pages(leads))
        contacts = page_contacts(page_text(visits, url="canonical"), url="canonical")
        completed = materialise(backfill_candidates(leads, contacts, spec), "backfill")
        second = validate_records(completed, spec).withColumn("wave", F.lit(2))
        everything = validated.unionByName(second)
    records = dedupe_records(accepted(everything), spec, order=order)
    stats = run_stats(everything, spec, page_log)
    limited = limit_records(records, jobs, order=order)
    summary = job_summary(jobs, stats, limited, frontier=frontier, skipped=skipped, queries=queries, pages=page_log)
    return Harvest(frontier, limited, everything, leads, skipped, stats, summary)
