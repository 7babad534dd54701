"""Candidate rows to typed rows with errors.  Narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CROSS_FILL_FIELDS
from ..functions.coerce import coerce
from ..functions.names import is_org_name
from ..functions.text import bind, q, strip
from ..functions.urls import email_domain, host_name, host_of, is_free_mail, is_platform_host
from ..plans.stages import fence
from ..spec import RecordSpec

_STRINGS = ("string", "email", "url", "date")


def derived_name(spec: RecordSpec) -> str:
    """Name taken from the record's own e-mail domain, website or page host."""
    email, site = spec.first("email"), spec.first("url")

    def from_host(address: str) -> str:
        return bind(host_of(address), lambda h: f"CASE WHEN NOT {is_platform_host(h)} THEN {host_name(h)} END")

    options = []
    if email is not None:
        domain = email_domain(f"lower({strip(f'`{email.name}`')})")
        options.append(bind(domain, lambda d: f"CASE WHEN NOT {is_free_mail(d)} THEN {host_name(d)} END"))
    if site is not None:
        options.append(from_host(f"`{site.name}`"))
    options.append(from_host("source_url"))
    return f"coalesce({', '.join(options)})"


def validate_records(
    candidates: DataFrame, spec: RecordSpec, *, url: str = "url", accept_filled: bool = False
) -> DataFrame:
    """Typed columns in schema order plus ``errors``, one row per candidate.

    The page's url becomes ``source_url`` and the candidate's kind
    ``candidate_source``, since a schema may have fields of its own named url and
    source.

    A missing url field may be filled with the page's url where the page allows
    it (``may_fill``).  A required field that had to be filled still counts as
    missing unless ``accept_filled`` is set.
    """
    candidates = candidates.withColumnsRenamed({url: "source_url", "source": "candidate_source"})
    have = set(candidates.columns)
    keep = [c for c in candidates.columns if c not in ("raw", "page_link", "may_fill", "kind", "items")]
    taken = sorted((set(keep) | {"errors"}) & set(spec.headers))
    if taken:
        raise ValueError(f"reserved field names: {', '.join(taken)}")
    may_fill = F.col("may_fill") if "may_fill" in have else F.lit(True)
    typed = candidates.select(
        *keep,
        may_fill.alias("__may_fill"),
        *[
            F.expr(
                coerce(
                    f,
                    f"raw.`{f.name}`",
                    page_link=f"page_link.`{f.name}`" if f.type == "url" and "page_link" in have else None,
                    kind=f"kind.`{f.name}`" if "kind" in have else None,
                    items=f"items.`{f.name}`" if "items" in have else None,
                )
            ).alias(f.name)
            for f in spec.fields
        ],
    )

    def filled(f) -> str:
        if f.type == "url" and f.compact in CROSS_FILL_FIELDS:
            return f"coalesce(`{f.name}`, CASE WHEN __may_fill THEN source_url END)"
        return f"`{f.name}`"

    missing = [
        f"CASE WHEN {filled(f) if accept_filled else f'`{f.name}`'} IS NULL THEN {q(f.name + ': missing')} END"
        for f in spec.fields
        if f.required
    ]
    errors = f"array_compact(array({', '.join(missing)}))" if missing else "array()"
    checked = typed.select(
        *keep,
        *[F.expr(filled(f)).alias(f.name) for f in spec.fields],
        F.expr(f"cast({errors} AS ARRAY<STRING>)").alias("errors"),
    )
    named = _settle_name(checked, spec)
    final = named.select(
        *keep,
        *[F.col(f.name).alias(f.name, metadata=dict(f.struct_field.metadata)) for f in spec.fields],
        "errors",
    )
    return fence(final)


def _settle_name(rows: DataFrame, spec: RecordSpec) -> DataFrame:
    field = spec.name_field
    if field is None or field.type not in _STRINGS:
        return rows
    replacement = F.expr(
        f"CASE WHEN NOT {is_org_name(f'`{field.name}`')} THEN {derived_name(spec)} END"
    )
    others = [c for c in rows.columns if c not in (field.name, "errors")]
    with_new = rows.select(*others, field.name, "errors", replacement.alias("__new"))
    return with_new.select(
        *others,
        F.coalesce("__new", field.name).alias(field.name),
        F.when(F.col("__new").isNotNull(), F.array_remove("errors", f"{field.name}: missing"))
        .otherwise(F.col("errors"))
        .alias("errors"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("errors") > 0)
