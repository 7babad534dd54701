"""Logs of fetch attempts to fetched pages and skips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BLOCK_STATUS, BLOCKED_URL_PATTERNS, STATUS_IN_TEXT
from ..functions.text import bind, blank_to_null, extract, parse_json, strip
from ..functions.urls import is_blocked_url
from ..plans.stages import first_per_key

FETCH_ORDER = ("cli", "server", "http")
SEARCH_ORDER = ("server", "cli", "searxng")


def status_from_text(text: str) -> str:
    """HTTP status mentioned in a log line, 0 when none is."""
    return f"coalesce(cast({extract(text, STATUS_IN_TEXT, 1)} AS INT), 0)"


def engine_rank(engine: Column, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in order]), engine)


def service_reply(body: str) -> str:
    """``struct<markdown, error>`` of a scrape service's JSON answer."""

    def read(v: str) -> str:
        def text(path: str) -> str:
            return blank_to_null(f"try_variant_get({v}, '{path}', 'string')")

        return (
            f"named_struct('markdown', CASE WHEN try_variant_get({v}, '$.data', 'map<string,variant>') IS NOT NULL "
            f"THEN coalesce({text('$.data.markdown')}, {text('$.data.content')}) ELSE {text('$.markdown')} END, "
            f"'error', CASE WHEN try_variant_get({v}, '$.success', 'boolean') = false "
            f"THEN coalesce({text('$.error')}, 'scrape failed') END)"
        )

    return bind(parse_json(body), read)


def judge_attempts(attempts: DataFrame, *, block_status: Sequence[int] = BLOCK_STATUS) -> DataFrame:
    """Outcome of every attempt: ``ok``, ``blocked`` or ``error`` with a reason.

    ``attempts`` has url, engine, attempt, status, exit_code, content_type, body
    and log.
    """
    cli = F.col("engine") == "cli"
    server = F.col("engine") == "server"
    told = attempts.withColumns(
        {
            "__status": F.when(
                cli, F.when(F.coalesce("exit_code", F.lit(0)) != 0, F.expr(status_from_text("log"))).otherwise(200)
            ).otherwise(F.coalesce("status", F.lit(200))),
            "__reply": F.when(server, F.expr(service_reply("body"))),
        }
    )
    failed = cli & (F.coalesce("exit_code", F.lit(0)) != 0)
    blocked = F.col("__status").isin(*block_status)
    detail = F.expr(strip("coalesce(log, '')"))
    text = F.when(server, F.col("__reply.markdown")).otherwise(F.col("body"))
    outcome = (
        F.when(blocked, "blocked")
        .when(failed | (~cli & (F.col("__status") >= 400)), "error")
        .when(F.trim(F.coalesce(text, F.lit(""))) == "", "error")
        .otherwise("ok")
    )
    reason = (
        F.when(
            blocked,
            F.concat(
                F.lit("blocked ("),
                F.when(cli & (detail != ""), detail).otherwise(
                    F.concat(F.lit("HTTP "), F.col("__status").cast("string"))
                ),
                F.lit(")"),
            ),
        )
        .when(failed, F.concat(F.lit("fetcher exited "), F.col("exit_code").cast("string"), F.lit(": "), detail))
        .when(
            server & (F.col("__status") >= 400),
            F.concat(F.lit("server scrape HTTP "), F.col("__status").cast("string"), F.lit(" for "), F.col("url")),
        )
        .when(
            F.col("__status") >= 400,
            F.concat(F.lit("HTTP "), F.col("__status").cast("string"), F.lit(" for "), F.col("url")),
        )
        .when(server, F.coalesce(F.col("__reply.error"), F.concat(F.lit("no markdown in response for "), F.col("url"))))
        .otherwise(F.concat(F.lit("no extractable content: "), F.col("url")))
    )
    judged = told.withColumns({"outcome": outcome, "__text": text})
    return judged.select(
        *[c for c in attempts.columns if c not in ("body", "log", "exit_code")],
        "outcome",
        F.when(F.col("outcome") == "ok", F.col("__text")).alias("text"),
        F.when(F.col("outcome") != "ok", reason).alias("reason"),
    )


def settled_attempts(
    attempts: DataFrame, *, order: Sequence[str], block_status: Sequence[int], blocked: Sequence[str]
) -> DataFrame:
    """Judged attempts with ``__rank``, the place of their engine in ``order``; blocked urls are refused.  A narrow step."""
    judged = judge_attempts(attempts, block_status=block_status)
    by_pattern = F.expr(is_blocked_url("url", blocked))
    return judged.withColumns(
        {
            "__rank": engine_rank(F.col("engine"), order),
            "outcome": F.when(by_pattern, "blocked").otherwise(F.col("outcome")),
            "reason": F.when(by_pattern, "blocked (domain pattern blocked)").otherwise(F.col("reason")),
            "text": F.when(~by_pattern, F.col("text")),
        }
    ).filter("__rank > 0")


def fetch_outcomes(
    attempts: DataFrame,
    *,
    keys: Sequence[str] = ("url",),
    order: Sequence[str] = FETCH_ORDER,
    block_status: Sequence[int] = BLOCK_STATUS,
    blocked: Sequence[str] = BLOCKED_URL_PATTERNS,
) -> DataFrame:
    """One row per url: the attempt that settled it.

    Attempts run engine by engine.  The first success wins and a refusal ends the
    url at once; otherwise the last error is reported.  Failed attempts carry no
    body, so only usable bodies are shuffled, one per url and map task.
    """
    settled = settled_attempts(attempts, order=order, block_status=block_status, blocked=blocked)
    final = F.col("outcome") != "error"
    # The first settled attempt counts, or the last failed one.
    direction = F.when(final, 1).otherwise(-1)
    chosen = first_per_key(
        settled,
        keys,
        [(~final).cast("int"), F.col("__rank") * direction, F.col("attempt") * direction],
    )
    return chosen.select(
        *keys,
        F.when(F.col("outcome") == "ok", "scraped").otherwise("skipped").alias("state"),
        "engine",
        "attempt",
        "status",
        *(["content_type"] if "content_type" in attempts.columns else []),
        "text",
        "reason",
    )


def first_answering_engine(answers: DataFrame, order: Sequence[str] = SEARCH_ORDER) -> DataFrame:
    """Results of the first engine that has any, per (job, query)."""
    ranked = answers.withColumn("__rank", engine_rank(F.col("engine"), order)).filter("__rank > 0")
    best = ranked.groupBy("job_id", "query").agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, ["job_id", "query", "__rank"]).drop("__rank")


def skip_report(*parts: DataFrame, keys: Sequence[str] = ("job_id", "url")) -> DataFrame:
    """One row per skipped url: reasons from fetching and from page text."""
    report = None
    for part in parts:
        reason = "reject" if "reject" in part.columns else "reason"
        rows = part.filter(F.col(reason).isNotNull()).select(*keys, F.col(reason).alias("reason"))
        report = rows if report is None else report.unionByName(rows)
    return report
