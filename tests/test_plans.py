"""Shape of the physical plans and results against SQL on the smallest tables."""

import duckdb
import pytest

from recordlake.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# These run streams or write files while they are built.
EAGER = {
    "stream_dedupe", "stream_status", "stream_records", "stream_counters", "csv_roundtrip", "json_roundtrip",
    "record_target", "event_replay", "webhook_payloads", "wide_ranks",
    "markdown_roundtrip", "evolving_table", "harvest_records", "harvest_summary", "lead_backfill",
    "stream_replay", "stream_targets", "stream_skips", "stream_fetch_results", "stream_backfill", "event_log",
    "table_snapshots", "export_routes", "frontier_many_jobs", "page_counters", "visited_leads", "seeded_frontier", "harvest_waves", "harvest_report",
}
CHECKED = (
    "page_body_text", "page_names", "frontier_ranked", "search_payloads", "fetch_results", "directory_extract",
    "coerce_types", "validate_split", "entity_dedupe", "quality_report", "validity_report", "harvest_records",
    "webhook_payloads", "event_replay", "reply_merge", "reply_records",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["page_media", "page_banners", "page_lists", "page_nested_tables"])
def test_keys_are_dealt_before_they_become_pages(spark, name):
    """A table of one row group would be rendered by one task."""
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Scan parquet") or "ReusedExchange" in plan
    assert "REPARTITION_BY_NUM" in plan


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{bad} in {name}"


def test_page_steps_do_not_shuffle(spark):
    from recordlake.operators.extract import extract_candidates
    from recordlake.operators.page_text import page_text
    from recordlake.operators.validate import accepted, validate_records

    from .samples import LEAD_SPEC

    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("'j' AS job_id", "page_id AS page_rank", "url", "html")
    valid = accepted(validate_records(extract_candidates(page_text(pages), LEAD_SPEC), LEAD_SPEC))
    plan = plan_of(valid)
    assert "Exchange" not in plan and "Sort" not in plan
    # Rendering appears once: filters stay above the fences.
    assert plan.count("(?is)<!--") == 1


def test_dedupe_exchanges_once_and_limits_first(spark):
    from recordlake.operators.entities import dedupe_records, limit_records

    from .samples import LEAD_SPEC

    rows = spark.range(10_000).selectExpr(
        "cast(id % 2 AS STRING) AS job_id", "id AS page_rank", "0 AS cand_idx", "'n' AS company_name", "'a@b.io' AS email", "'https://b.io' AS website"
    )
    plan = plan_of(dedupe_records(rows, LEAD_SPEC))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    assert plan_of(limit_records(rows, default=20)).count("WindowGroupLimit") == 2


def test_a_large_job_is_spread_over_tasks(spark):
    """One of 400 jobs holds a third of all results; no task that scores them has more than four times the usual."""
    from pyspark.sql import functions as F

    from recordlake.operators.frontier import score_results

    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).selectExpr(
            "concat('job-', IF(id % 3 = 0, 0, id % 400)) AS job_id", "id AS rank", "'reliable partners' AS title",
            "concat('https://h.test/', id) AS url", "'queue' AS snippet", "'cli' AS engine", "'q' AS query",
        )
        jobs = rows.select("job_id").distinct().withColumn("intent", F.lit("reliable partners of the queue"))
        sizes = [r["count"] for r in score_results(rows, jobs).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and max(sizes) <= 4 * sorted(sizes)[len(sizes) // 2]


def test_narrow_scan_for_narrow_queries(spark):
    plan = plan_of(QUERIES["canonical_urls"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)

    def plain(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want
