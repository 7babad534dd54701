"""Intents to search queries and record targets.  Narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTENT_COUNT, MAX_RECORDS_HARD, STOP_WORDS
from ..functions.text import bind, blank_to_null, collapse, extract, match_all, one_of, strip_end

_QUOTED = '"([^"]+)"|“([^”]+)”'


def planned_queries(intent: str, wants_email: str, wants_url: str) -> str:
    """Distinct queries of an intent, first spelling kept; the whole intent is used."""

    def with_base(base: str) -> str:
        words = f"filter({match_all(base, '[A-Za-z0-9][A-Za-z0-9+.#-]+')}, w -> NOT {one_of('lower(w)', STOP_WORDS)})"
        leading = f"array_join({words}, ' ')"
        return bind(f"coalesce({blank_to_null(leading)}, {base})", lambda core: listed(base, core))

    def listed(base: str, core: str) -> str:
        quoted = f"coalesce({extract(intent, _QUOTED, 1)}, {extract(intent, _QUOTED, 2)})"
        queries = (
            f"array(concat({quoted}, ' list'), {base}, concat({core}, ' directory'), "
            f"CASE WHEN {wants_email} THEN concat({core}, ' contact email') END, "
            f"CASE WHEN {wants_url} THEN concat({core}, ' official website') END)"
        )
        return bind(f"filter({queries}, x -> x <> '')", distinct)

    def distinct(queries: str) -> str:
        return bind(
            f"transform({queries}, x -> lower(x))",
            lambda low: f"filter({queries}, (x, i) -> array_position({low}, lower(x)) = i + 1)",
        )

    return bind(strip_end(collapse(intent), ".!?"), with_base)


def plan_queries(jobs: DataFrame) -> DataFrame:
    """One row per planned query: ``query_no`` from 1.

    ``jobs`` has ``job_id``, ``intent`` and ``fields`` (array of structs with a
    ``type``).
    """
    def wants(kind: str) -> str:
        return f"exists(fields, f -> f.type = '{kind}')"

    planned = jobs.select(
        "job_id", F.expr(planned_queries("intent", wants("email"), wants("url"))).alias("__queries")
    )
    rows = planned.select("job_id", F.posexplode_outer("__queries").alias("__pos", "query"))
    return rows.filter(F.col("query").isNotNull()).select("job_id", (F.col("__pos") + 1).alias("query_no"), "query")


def target_from_intent(intent: str) -> str:
    """Record count named in an intent, null when none or out of range."""
    stated = f"cast(coalesce({extract(intent, INTENT_COUNT, 1)}, {extract(intent, INTENT_COUNT, 2)}) AS INT)"
    return bind(stated, lambda n: f"CASE WHEN {n} BETWEEN 1 AND {MAX_RECORDS_HARD} THEN {n} END")


def with_targets(jobs: DataFrame) -> DataFrame:
    """Fill ``max_records`` from the intent where the job does not set it."""
    return jobs.withColumn("max_records", F.expr(f"coalesce(max_records, {target_from_intent('intent')})"))
