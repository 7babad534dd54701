"""Logged model replies to queries and candidate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, match, match_all, parse_json, q, strip
from ..spec import RecordSpec

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"
_BLOCK = 4096  # parts concatenated per task before a session is put together


def reply_parts(log: DataFrame, *, session: str = "session", seq: str = "seq", line: str = "line") -> DataFrame:
    """Parts of every reply: last text of each part, first-seen position.

    Lines that are no JSON objects are skipped; a text without a part id is a
    part of its own.
    """
    parsed = log.select(
        session,
        seq,
        F.expr(strip(f"`{line}`")).alias("__line"),
    ).select(
        session, seq, F.expr(f"CASE WHEN startswith(__line, '{{') THEN {parse_json('__line')} END").alias("__v")
    )
    kind = F.try_variant_get("__v", "$.type", "string")
    is_text = F.expr("schema_of_variant(try_variant_get(__v, '$.part.text', 'variant')) = 'STRING'")
    read = parsed.select(
        session,
        seq,
        F.when(
            (kind == "text") & is_text,
            F.coalesce(
                F.nullif(F.try_variant_get("__v", "$.part.id", "string"), F.lit("")),
                F.concat(F.lit("\x1f"), F.col(seq).cast("string")),
            ),
        ).alias("part"),
        F.try_variant_get("__v", "$.part.text", "string").alias("text"),
        F.when(
            kind == "error",
            F.coalesce(
                F.nullif(F.try_variant_get("__v", "$.error.message", "string"), F.lit("")),
                F.to_json(F.try_variant_get("__v", "$.error", "variant")),
                F.lit("{}"),
            ),
        ).alias("error"),
    )
    useful = read.filter(F.col("part").isNotNull() | F.col("error").isNotNull())
    return useful.groupBy(session, "part").agg(
        F.max_by("text", seq).alias("text"),
        F.min(seq).alias("first_seq"),
        F.min_by("error", seq).alias("error"),
    )


def merge_replies(log: DataFrame, *, session: str = "session", seq: str = "seq", line: str = "line") -> DataFrame:
    """One row per session: the reply text, or the first error when there is none.

    Parts are reduced before they move and concatenated in blocks first, so a
    long session is put together by many tasks; only its finished text, which is
    the result itself, ends in one row.
    """
    parts = reply_parts(log, session=session, seq=seq, line=line)
    ordered = parts.withColumn("__block", F.floor(F.col("first_seq") / _BLOCK))

    def joined(order: str, text: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
        return F.array_join(F.transform(pieces, lambda p: p[text]), "")

    blocks = ordered.groupBy(session, "__block").agg(
        joined("first_seq", "text").alias("__text"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("first_seq"))).alias("__error"),
    )
    whole = blocks.groupBy(session).agg(
        joined("__block", "__text").alias("text"),
        F.min_by("__error", F.when(F.col("__error").isNotNull(), F.col("__block"))).alias("error"),
    )
    trimmed = whole.withColumn("text", F.expr(strip("text")))
    return trimmed.select(
        session,
        F.nullif("text", F.lit("")).alias("text"),
        F.when(F.col("text") == "", F.col("error")).alias("error"),
    )


def _between(text: str, opener: str, closer: str) -> str:
    """JSON value from the first opener to the last closer."""
    start, end = f"locate({q(opener)}, {text})", f"(length({text}) - locate({q(closer)}, reverse({text})) + 1)"
    return (
        f"CASE WHEN {start} > 0 AND contains({text}, {q(closer)}) AND {end} > {start} "
        f"THEN {parse_json(f'substr({text}, {start}, {end} - {start} + 1)')} END"
    )


def json_in_prose(text: str) -> str:
    """First JSON value of a reply: bare, fenced, or wrapped in prose; else null."""
    fenced = f"CASE WHEN t RLIKE {q(_FENCE)} THEN {strip(match('t', _FENCE))} ELSE t END"
    value = f"coalesce({parse_json('b')}, {_between('b', '{', '}')}, {_between('b', '[', ']')})"
    return let(strip(text), "t", let(fenced, "b", value))


def json_payloads(text: str) -> str:
    """``array<variant>``: the JSON objects of every fenced block, else of the text."""
    def container(t: str) -> str:
        start = "least(nullif(locate('[', x), 0), nullif(locate('{', x), 0))"
        bound = (
            "CASE WHEN contains(x, '[') THEN length(x) - locate(']', reverse(x)) + 1 "
            "ELSE length(x) - locate('}', reverse(x)) + 1 END"
        )
        cut = parse_json(f"substr(x, {start}, greatest({bound} - {start} + 1, 0))")
        objects = (
            "CASE WHEN try_variant_get(v, '$', 'array<variant>') IS NOT NULL "
            "THEN filter(try_variant_get(v, '$', 'array<variant>'), o -> schema_of_variant(o) LIKE 'OBJECT%') "
            "WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN array(v) ELSE cast(array() AS ARRAY<VARIANT>) END"
        )
        return let(strip(t), "x", let(f"coalesce({parse_json('x')}, {cut})", "v", objects))

    blocks = f"flatten(transform({match_all(text, _FENCE, 1)}, blk -> {container('blk')}))"
    return let(blocks, "found", f"CASE WHEN size(found) > 0 THEN found ELSE {container(text)} END")


def reply_queries(
    replies: DataFrame, *, keys: Sequence[str] = ("job_id",), text: str = "text", limit: int | None = None
) -> DataFrame:
    """Queries of a planner reply in order, the first ``limit`` of them if it is set."""
    parsed = replies.select(*keys, F.expr(json_in_prose(f"`{text}`")).alias("__v"))
    listed = parsed.select(
        *keys,
        F.filter(F.try_variant_get("__v", "$.queries", "array<string>"), lambda x: x.isNotNull() & (x != "")).alias("__queries"),
    )
    rows = listed.select(*keys, F.posexplode_outer("__queries").alias("__pos", "query"))
    numbered = rows.filter(F.col("query").isNotNull()).select(*keys, (F.col("__pos") + 1).alias("query_no"), "query")
    return numbered if limit is None else numbered.filter(F.col("query_no") <= limit)


def parse_replies(replies: DataFrame, *, text: str = "text") -> DataFrame:
    """Extractor replies with ``records`` (``array<variant>``), null when unusable.

    An object without records is an answer with no rows; a list or a reply that
    holds no JSON is no answer, which leaves the page to the heuristics.
    """
    value = replies.withColumn("__v", F.expr(json_in_prose(f"`{text}`")))
    records = F.expr(
        "CASE WHEN schema_of_variant(__v) LIKE 'OBJECT%' THEN "
        "CASE WHEN try_variant_get(__v, '$.records', 'variant') IS NULL THEN cast(array() AS ARRAY<VARIANT>) "
        "ELSE filter(try_variant_get(__v, '$.records', 'array<variant>'), r -> schema_of_variant(r) LIKE 'OBJECT%') END END"
    )
    return value.withColumn("records", records).drop("__v", text)


def reply_candidates(parsed: DataFrame, spec: RecordSpec, *, keys: Sequence[str]) -> DataFrame:
    """Candidate rows of the answered pages.

    JSON numbers, booleans and lists keep their kind (``kind``, ``items``), since
    they are coerced differently from text.
    """
    rows = parsed.select(*keys, F.posexplode_outer("records").alias("cand_idx", "__v")).filter(
        F.col("__v").isNotNull()
    )
    entries = rows.select(
        *keys, "cand_idx", F.expr("map_entries(try_variant_get(__v, '$', 'map<string,variant>'))").alias("__entries")
    )
    picked = entries.select(
        *keys,
        "cand_idx",
        *[
            F.expr(
                f"coalesce(get(filter(__entries, e -> e.key = {q(f.name)} AND NOT is_variant_null(e.value)), 0).value, "
                "get(filter(__entries, e -> regexp_replace(lower(e.key), '[^a-z0-9]', '') = "
                f"{q(f.compact)}), 0).value)"
            ).alias(f"__v_{f.name}")
            for f in spec.fields
        ],
    )

    def kind(c: str) -> str:
        return (
            f"CASE WHEN {c} IS NULL OR is_variant_null({c}) THEN NULL "
            f"WHEN schema_of_variant({c}) = 'BOOLEAN' THEN 'bool' WHEN schema_of_variant({c}) = 'BIGINT' THEN 'int' "
            f"WHEN schema_of_variant({c}) RLIKE '^(DECIMAL|DOUBLE|FLOAT)' THEN 'float' "
            f"WHEN schema_of_variant({c}) LIKE 'ARRAY%' THEN 'list' ELSE 'text' END"
        )

    def text(c: str) -> str:
        # A boolean reads True or False, a container its JSON text.
        return (
            f"CASE WHEN schema_of_variant({c}) = 'BOOLEAN' THEN initcap(try_variant_get({c}, '$', 'string')) "
            f"WHEN schema_of_variant({c}) RLIKE '^(ARRAY|OBJECT)' THEN to_json({c}) "
            f"ELSE try_variant_get({c}, '$', 'string') END"
        )

    names = [f.name for f in spec.fields]
    return picked.select(
        *keys,
        "cand_idx",
        F.lit("reply").alias("source"),
        F.struct(*[F.expr(text(f"__v_{n}")).alias(n) for n in names]).alias("raw"),
        F.struct(*[F.expr(kind(f"__v_{n}")).alias(n) for n in names]).alias("kind"),
        F.struct(*[F.expr(f"try_variant_get(__v_{n}, '$', 'array<string>')").alias(n) for n in names]).alias("items"),
    )
