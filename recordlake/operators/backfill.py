"""Second wave: find the missing e-mail of a lead on the company's own site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.contacts import preferred_email
from ..functions.text import blank_to_null, strip, strip_end
from ..functions.urls import canonical_url, contact_urls, host_of
from ..plans.stages import first_per_key, top_per_key
from ..spec import RecordSpec


def collect_leads(
    candidates: DataFrame, spec: RecordSpec, *, order: Sequence[str] = ("page_rank", "cand_idx"), url: str = "url"
) -> DataFrame:
    """Candidates that lack only an e-mail: one row per (job, website).

    The website is not the page itself; the first company name seen for a website
    wins.  Without an e-mail, a name and a url field there are no leads.
    """
    return first_per_key(near_misses(candidates, spec, order=order, url=url), ["job_id", "website"], order)


def near_misses(
    candidates: DataFrame,
    spec: RecordSpec,
    *,
    order: Sequence[str] = ("page_rank", "cand_idx"),
    url: str = "url",
    keep: Sequence[str] = (),
) -> DataFrame:
    """All candidates that lack only an e-mail: job, order, ``keep``, website and company.  A narrow step."""
    email, name, site = spec.first("email"), spec.name_field, spec.first("url")
    if not (email and name and site):
        none = candidates.filter(F.lit(False))
        return none.select("job_id", *order, *keep, F.lit("").alias("website"), F.lit("").alias("company"))
    have = set(candidates.columns)

    def value(f):
        return F.expr(
            coerce(
                f,
                f"raw.`{f.name}`",
                kind=f"kind.`{f.name}`" if "kind" in have else None,
                items=f"items.`{f.name}`" if "items" in have else None,
            )
        )

    read = candidates.select(
        "job_id",
        *order,
        *keep,
        url,
        value(email).alias("__email"),
        F.expr(blank_to_null(strip(f"raw.`{name.name}`"))).alias("company"),
        value(site).alias("website"),
    )
    return read.filter(
        F.expr(
            "__email IS NULL AND company IS NOT NULL AND website IS NOT NULL "
            f"AND {strip_end('website', '/')} <> {strip_end(f'`{url}`', '/')}"
        )
    ).select("job_id", *order, *keep, "website", "company")


def open_leads(
    leads: DataFrame,
    visited: DataFrame,
    *,
    record_counts: DataFrame | None = None,
    targets: DataFrame | None = None,
    order: Sequence[str] = ("page_rank", "cand_idx"),
    cap: int | None = None,
) -> DataFrame:
    """Leads worth a visit: job below its target, site not visited yet.

    ``visited`` is ``(job_id, url)`` of the pages already read, ``record_counts``
    ``(job_id, n_records)``, ``targets`` ``(job_id, max_records)``.  All leads are kept
    unless the caller sets ``cap``; ``lead_no`` is their order in the job.
    """
    wanted = leads
    if record_counts is not None and targets is not None:
        had = targets.select("job_id", "max_records").join(record_counts.select("job_id", "n_records"), "job_id")
        full = had.filter(F.col("n_records") >= F.col("max_records")).select("job_id")
        wanted = wanted.join(full, "job_id", "left_anti")
    seen = visited.select("job_id", F.expr(canonical_url("url")).alias("__page")).distinct()
    pages = F.expr(f"transform({contact_urls('website')}, x -> {canonical_url('x')})")
    hit = (
        wanted.select("job_id", "website", F.explode_outer(pages).alias("__page"))
        .join(seen, ["job_id", "__page"], "left_semi")
        .select("job_id", "website")
        .distinct()
    )
    fresh = wanted.join(hit, ["job_id", "website"], "left_anti")
    return top_per_key(fresh, ["job_id"], [*order, "website"], cap, "lead_no")


def lead_pages(leads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The pages to look at, site before contact page: ``page`` and its order."""
    return leads.select(
        "job_id",
        *keep,
        "website",
        "company",
        "lead_no",
        F.posexplode_outer(F.expr(contact_urls("website"))).alias("page_no", "page"),
    ).withColumn("canonical", F.expr(canonical_url("page")))


def page_contacts(text: DataFrame, *, url: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """Preferred e-mail of every usable page: ``canonical`` and ``email``.

    Computed next to the page text; only the address is shuffled.
    """
    usable = text.filter(F.col("reject").isNull())
    found = usable.select(
        *keep,
        F.expr(canonical_url(f"`{url}`")).alias("canonical"),
        F.expr(preferred_email("markdown", host_of(f"`{url}`"))).alias("email"),
    )
    return found.filter(F.col("email").isNotNull())


def backfill_candidates(leads: DataFrame, contacts: DataFrame, spec: RecordSpec) -> DataFrame:
    """Candidates completed with the address found on the lead's own pages."""
    one = contacts.groupBy("canonical").agg(F.min("email").alias("email"))
    found = first_per_key(
        lead_pages(leads).join(one, "canonical"), ["job_id", "website"], ["page_no"]
    )
    return completed_candidates(found, spec)


def completed_candidates(found: DataFrame, spec: RecordSpec) -> DataFrame:
    """Candidates from leads with their ``email``: job_id, lead_no, website, company, email."""
    email, name, site = spec.first("email"), spec.name_field, spec.first("url")
    values = {name.name: "company", email.name: "email", site.name: "website"} if email and name and site else {}
    return found.select(
        "job_id",
        F.col("lead_no").alias("page_rank"),
        F.lit(0).alias("cand_idx"),
        F.col("website").alias("url"),
        F.lit("backfill").alias("source"),
        F.struct(
            *[
                (F.col(values[f.name]) if f.name in values else F.lit(None).cast("string")).alias(f.name)
                for f in spec.fields
            ]
        ).alias("raw"),
    )
