"""Search payloads and seed lists to search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, cut, let, match_all, parse_json, q, strip
from ..functions.urls import canonical_url, is_http
from ..plans.stages import top_per_key

_URLS = r"""https?://[^\s"'<>]+"""
_PAYLOAD_STRIDE = 1_000_000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file: ``payload_path`` and its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("payload_path"), F.col("value").alias("payload")
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed urls, one per line; blank lines are dropped."""
    lines = spark.read.text(path).select(F.expr(strip("value")).alias("url"))
    return lines.filter(F.col("url") != "")


def seed_results(jobs: DataFrame) -> DataFrame:
    """Seed urls of every job as search results ahead of all others."""
    cleaned = F.expr(f"filter(transform(seed_urls, u -> {strip('u')}), u -> u <> '')")
    listed = jobs.select("job_id", cleaned.alias("__seeds"))
    rows = listed.select("job_id", F.size("__seeds").alias("__n"), F.posexplode_outer("__seeds").alias("__pos", "url"))
    return rows.filter(F.col("url").isNotNull()).select(
        "job_id",
        (F.col("__pos") - F.col("__n")).cast("long").alias("rank"),
        F.lit("seed").alias("title"),
        "url",
        F.lit("").alias("snippet"),
        F.lit("seed").alias("engine"),
        F.lit("seed").alias("query"),
    )


def _truthy(variant: str) -> str:
    """A JSON value that is neither null nor empty, zero or false."""
    return (
        f"CASE WHEN {variant} IS NOT NULL AND NOT is_variant_null({variant}) "
        f"AND to_json({variant}) NOT IN ('[]', '{{}}', {q(chr(34) * 2)}, '0', 'false', '0.0') THEN {variant} END"
    )


def _member(variant: str, path: str) -> str:
    return f"try_variant_get({variant}, {q('$.' + path)}, 'variant')"


def payload_items(payload: str) -> Column:
    """``array<variant>`` of the entries of a payload column.

    Whole JSON (a list, or an envelope around one), else one object per line,
    else every url in the text.
    """
    inside = "coalesce(" + ", ".join(
        let(_member("v", k), "m", _truthy("m")) for k in ("results", "data", "organic", "pages")
    ) + ")"
    envelope = let(
        inside,
        "x",
        "coalesce(try_variant_get(x, '$', 'array<variant>'), try_variant_get(x, '$.results', 'array<variant>'))",
    )
    parsed = (
        "CASE WHEN try_variant_get(v, '$', 'array<variant>') IS NOT NULL "
        "THEN try_variant_get(v, '$', 'array<variant>') "
        f"ELSE coalesce({envelope}, cast(array() AS ARRAY<VARIANT>)) END"
    )
    by_line = (
        f"filter(transform(filter(transform({cut('t', LINE_BREAK)}, l -> {strip('l')}), "
        f"l -> startswith(l, '{{')), l -> {parse_json('l')}), o -> o IS NOT NULL)"
    )
    by_url = f"transform({match_all('t', _URLS)}, u -> parse_json(to_json(named_struct('url', u))))"
    loose = let(by_line, "rows", f"CASE WHEN size(rows) > 0 THEN rows ELSE {by_url} END")
    return F.expr(
        let(
            strip(payload),
            "t",
            let(parse_json("t"), "v", f"CASE WHEN v IS NOT NULL THEN {parsed} ELSE {loose} END"),
        )
    )


def load_search_results(
    payloads: DataFrame, *, payload: str = "payload", keys: Sequence[str] = ("job_id", "query", "engine"), seq: str | None = None
) -> DataFrame:
    """Search results of every payload: canonical url, title, snippet and rank.

    ``seq`` orders the payloads of a job; ranks continue from one to the next.
    """
    order = [seq] if seq else []
    items = payloads.select(*keys, *order, payload_items(f"`{payload}`").alias("__items"))
    rows = items.select(*keys, *order, F.posexplode_outer("__items").alias("__pos", "__v"))

    def text_of(*names: str) -> Column:
        return F.expr(
            "coalesce("
            + ", ".join(f"nullif(try_variant_get(__v, '$.{n}', 'string'), '')" for n in names)
            + ")"
        )

    start = F.col(seq).cast("long") * _PAYLOAD_STRIDE if seq else F.lit(0)
    read = rows.select(
        *keys,
        (start + F.col("__pos")).cast("long").alias("rank"),
        text_of("title", "name").alias("__title"),
        text_of("url", "link", "href").alias("__url"),
        F.coalesce(text_of("snippet", "description"), F.lit("")).alias("snippet"),
    )
    return read.filter(is_http("__url")).select(
        *keys,
        "rank",
        F.coalesce("__title", "__url").alias("title"),
        F.expr(canonical_url("__url")).alias("url"),
        "snippet",
    )


def limit_results(results: DataFrame, limit: int, *, server_limit: int | None = None) -> DataFrame:
    """First ``limit`` results of every query; those of the server engine may have a limit of their own."""
    ranked = top_per_key(results, ["job_id", "query"], ["rank"], limit, "__rn")
    if server_limit is not None:
        ranked = ranked.filter((F.col("engine") != "server") | (F.col("__rn") <= server_limit))
    return ranked.drop("__rn")
