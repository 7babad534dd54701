"""One row per entity: keys and first-wins dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, q, strip
from ..functions.urls import email_domain, host_of, strip_www
from ..plans.stages import first_per_key, top_per_key, wide_row_number
from ..spec import FieldSpec, RecordSpec

_ITEM_SEPARATOR = "\x1f"  # between the items of an array inside a key


def _key_part(f: FieldSpec) -> str:
    """Text of a value inside the full-row key; zero, false and [] count as blank."""
    if f.type == "array":
        text = f"array_join(`{f.name}`, {q(_ITEM_SEPARATOR)})"
    elif f.type in ("number", "integer"):
        text = f"CASE WHEN `{f.name}` <> 0 THEN cast(`{f.name}` AS STRING) END"
    elif f.type == "boolean":
        text = f"CASE WHEN `{f.name}` THEN 'true' END"
    else:
        text = f"`{f.name}`"
    return f"coalesce(lower({strip(text)}), '')"


def organisation_key(spec: RecordSpec) -> str:
    """``org|domain|host`` when the e-mail and the website share a domain."""
    email, site = spec.first("email"), spec.first("url")
    if email is None or site is None:
        return "cast(NULL AS STRING)"
    pair = (
        f"named_struct('domain', {email_domain(f'lower({strip(email.name)})')}, "
        f"'host', {strip_www(host_of(strip(site.name)))})"
    )
    return bind(
        pair,
        lambda p: f"CASE WHEN contains({email.name}, '@') AND contains({p}.host, '.') AND ({p}.domain = {p}.host "
        f"OR endswith({p}.domain, concat('.', {p}.host)) OR endswith({p}.host, concat('.', {p}.domain))) "
        f"THEN concat_ws('|', 'org', {p}.domain, {p}.host) END",
    )


def entity_key(spec: RecordSpec) -> str:
    parts = [_key_part(f) for f in spec.fields]
    whole = bind(
        f"array({', '.join(parts)})",
        lambda a: f"CASE WHEN exists({a}, x -> x <> '') THEN array_join({a}, '|') ELSE 'empty' END",
    )
    return f"coalesce({organisation_key(spec)}, {whole})"


def dedupe_records(
    records: DataFrame,
    spec: RecordSpec,
    *,
    job: Sequence[str] = ("job_id",),
    order: Sequence[str] = ("page_rank", "cand_idx"),
) -> DataFrame:
    """First record of every entity in every job.

    One exchange on (job, key), after each map task has already reduced its
    rows to one per key; page text is long gone from the rows.
    """
    keyed = records.withColumn("__key", F.expr(entity_key(spec)))
    return first_per_key(keyed, [*job, "__key"], order).drop("__key")


def limit_records(
    records: DataFrame,
    targets: DataFrame | None = None,
    *,
    job: str = "job_id",
    order: Sequence[str] = ("page_rank", "cand_idx"),
    default: int | None = None,
) -> DataFrame:
    """First ``max_records`` records of every job, in order, numbered in ``record_no``.

    ``targets`` is ``(job_id, max_records)``; a job without a target gets ``default``
    records, and all of them without one.
    """
    if targets is None:
        return top_per_key(records, [job], order, default, "record_no")
    numbered = wide_row_number(records, [job], order, "record_no")
    wanted = targets.select(job, F.coalesce("max_records", F.lit(default).cast("int")).alias("__target"))
    kept = numbered.join(wanted, job).filter(F.col("__target").isNull() | (F.col("record_no") <= F.col("__target")))
    return kept.drop("__target")
