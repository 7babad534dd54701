"""Whole jobs, replies, sinks, events and streams."""

import json

import pytest
from pyspark.sql import functions as F

from recordlake import RecordSpec
from recordlake.operators.entities import dedupe_records
from recordlake.operators.events import append_events, event_counts, latest_status, replay
from recordlake.operators.page_text import page_text
from recordlake.operators.validate import accepted, validate_records
from recordlake.plans.harvest import run_harvest
from recordlake.plans.stages import wide_row_number
from recordlake.sinks.export import export, read_table, table_name, webhook_batches, write_table
from recordlake.sources.replies import json_in_prose, merge_replies, parse_replies, reply_candidates, reply_queries
from recordlake.streaming.ingest import RecordTable, read_page_stream, skipped_pages, stream_candidates, write_records

from .samples import DIRECTORY, LEAD_SPEC, PROFILE, SPEC, page_frame

RESULT = "job_id string, rank long, title string, url string, snippet string, engine string, query string"
JOB = "job_id string, intent string, max_records int"


def seeds(spark, urls, job="j"):
    return spark.createDataFrame([(job, i, "seed", u, "", "seed", "seed") for i, u in enumerate(urls)], RESULT)


def corpus(spark, pages):
    return spark.createDataFrame(pages, "url string, html string")


def test_job_with_seeds_and_a_missing_page(spark):
    pages = corpus(spark, [("https://register.test/lakes", DIRECTORY), ("https://lakes.test/kelda", PROFILE), ("https://no.test/", "<title>Just a moment...</title><p>a@b.io</p>")])
    jobs = spark.createDataFrame([("j", "Find ferry operators with office emails on the lakes", 10)], JOB)
    done = run_harvest(SPEC, jobs, seeds(spark, ["https://register.test/lakes", "https://lakes.test/kelda/", "https://gone.test/", "https://no.test/"]), pages, backfill=False)
    rows = done.records.orderBy("record_no").collect()
    assert [r["company_name"] for r in rows] == ["Lumen Crossing", "Grebe Line", "Skerry Rowers", "Kelda Pontoons"]
    assert {r["url"]: r["reason"] for r in done.skipped.collect()} == {
        "https://gone.test/": "page not in corpus",
        "https://no.test/": "error page (Just a moment...)",
    }
    stats = done.stats.first()
    assert (stats["pages"], stats["candidates"], stats["valid"], stats["invalid"], stats["duplicates"]) == (2, 6, 4, 1, 1)
    assert stats["validity_ratio"] == 0.8
    summary = done.summary.first()
    assert summary["status"] == "completed" and summary["pages_skipped"] == 2
    assert summary["pages_scraped"] == 2


def test_job_with_replies(spark):
    """A reply replaces the heuristics of its page; an empty one gives no rows."""
    page = "<title>Quay</title><p><a href='https://quay.io/home'>Quay Works</a> writes to x@quay.io</p>"
    pages = corpus(spark, [("https://a.test/", page), ("https://b.test/", page), ("https://c.test/", "<title>Pier Ltd</title><p>hi@pier.io</p>")])
    jobs = spark.createDataFrame([("j", "Find gauge makers with founder emails in Norway", 10)], JOB)
    texts = [("j", "https://a.test/", '{"records": [{"company_name": "Quay Works", "email": "ask@quay.io", "website": "Quay Works"}]}'), ("j", "https://b.test/", '{"records": []}'), ("j", "https://c.test/", "sorry")]
    parsed = parse_replies(spark.createDataFrame(texts, "job_id string, url string, text string")).filter("records IS NOT NULL")
    given = reply_candidates(parsed, LEAD_SPEC, keys=["job_id", "url"])
    done = run_harvest(LEAD_SPEC, jobs, seeds(spark, ["https://a.test/", "https://b.test/", "https://c.test/"]), pages, given=given, answered=parsed)
    rows = done.records.orderBy("record_no").collect()
    assert [(r["company_name"], r["email"], r["website"], r["candidate_source"]) for r in rows] == [
        ("Quay Works", "ask@quay.io", "https://quay.io/home", "reply"),
        ("Pier Ltd", "hi@pier.io", "https://c.test/", "bare"),
    ]


LISTING = """<title>Members</title><table><tr><th>Company Name</th><th>website</th></tr>
<tr><td>Quay Works</td><td>https://quay.test</td></tr><tr><td>Buoy CRM</td><td>https://buoy.test/</td></tr>
<tr><td>Silent Co</td><td>https://silent.test</td></tr></table>"""
SITES = [
    ("https://list.test/", LISTING),
    ("https://quay.test/", "<title>Quay</title><p>mail hello@quay.test or x@gmail.com</p>"),
    ("https://buoy.test/", "<title>Buoy</title><p>no address</p>"),
    ("https://buoy.test/contact", "<title>Buoy</title><p>write to noreply@host.io, team@buoy.test</p>"),
    ("https://silent.test/", "<title>Silent</title><p>nothing</p>"),
]


@pytest.mark.parametrize("backfill, want", [(True, {"Quay Works": "hello@quay.test", "Buoy CRM": "team@buoy.test"}), (False, {})])
def test_second_wave(spark, backfill, want):
    jobs = spark.createDataFrame([("j", "Find crm makers with founder emails", 10)], JOB)
    done = run_harvest(LEAD_SPEC, jobs, seeds(spark, ["https://list.test/"]), corpus(spark, SITES), backfill=backfill)
    assert {r["company_name"]: r["email"] for r in done.records.collect()} == want
    summary = done.summary.first()
    assert summary["status"] == ("completed" if want else "failed")


def test_second_wave_stops_at_target_and_skips_visited(spark):
    jobs = spark.createDataFrame([("j", "Find crm makers with founder emails", 1)], JOB)
    pages = corpus(spark, SITES + [("https://one.test/", "<title>One Ltd</title><p>a@one.test</p>")])
    done = run_harvest(LEAD_SPEC, jobs, seeds(spark, ["https://list.test/", "https://one.test/"]), pages)
    assert [r["email"] for r in done.records.collect()] == ["a@one.test"] and done.leads.count() == 0
    wide = spark.createDataFrame([("j", "Find crm makers with founder emails", 9)], JOB)
    done = run_harvest(LEAD_SPEC, wide, seeds(spark, ["https://list.test/", "https://quay.test"]), pages)
    assert sorted(r["website"] for r in done.leads.collect()) == ["https://buoy.test/", "https://silent.test"]


def test_jobs_share_pages_but_not_records(spark):
    jobs = spark.createDataFrame([("a", "find lake ferry operators", 2), ("b", "find lake ferry operators", None)], JOB)
    results = seeds(spark, ["https://register.test/lakes"], "a").union(seeds(spark, ["https://register.test/lakes#x"], "b"))
    done = run_harvest(SPEC, jobs, results, corpus(spark, [("https://register.test/lakes", DIRECTORY)]), backfill=False)
    counts = {r["job_id"]: r["count"] for r in done.records.groupBy("job_id").count().collect()}
    assert counts == {"a": 2, "b": 3}


def log(spark, sessions):
    rows = [(s, i, line if isinstance(line, str) else json.dumps(line)) for s, lines in sessions.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "session string, seq long, line string")


def part(pid, text):
    return {"type": "text", "part": {"id": pid, "text": text} if pid else {"text": text}}


def test_reply_log(spark):
    error = {"type": "error", "error": {"message": "quota"}}
    sessions = {
        "two": [{"type": "step-start"}, part("p1", '{"queries":'), part("p2", ' ["a"]}'), "junk", '{"type": "text"} tail'],
        "update": [part("p1", "old"), part("p2", "!"), part("p1", "new")],
        "failed": [error, {"type": "error", "error": {"message": "later"}}],
        "mixed": [error, part("p", "ok")],
        "blank": [part("p", "  "), error],
        "noid": [part(None, "a"), part(None, "b")],
        "bad": [{"type": "text", "part": {"id": "p", "text": 5}}, part("q", "x")],
    }
    got = {r["session"]: (r["text"], r["error"]) for r in merge_replies(log(spark, sessions)).collect()}
    assert got == {
        "two": ('{"queries": ["a"]}', None),
        "update": ("new!", None),
        "failed": (None, "quota"),
        "mixed": ("ok", None),
        "blank": (None, "quota"),
        "noid": ("ab", None),
        "bad": ("x", None),
    }


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"queries": ["a"]}', '{"queries":["a"]}'),
        ('```json\n{"records": [{"x": 1}]}\n```', '{"records":[{"x":1}]}'),
        ('Sure! Here:\n{"q":["q1"]}\nEnjoy.', '{"q":["q1"]}'),
        ("[1, 2, 3]", "[1,2,3]"),
        ("list [1, 2] end", "[1,2]"),
        ("no json here", None),
        ("{broken", None),
    ],
)
def test_json_in_prose(value, text, want):
    assert value(f"to_json({json_in_prose('t')})", t=text) == want


def test_reply_queries_and_records(spark):
    replies = spark.createDataFrame([("j", json.dumps({"queries": [f"q{i}" for i in range(14)] + [""]}))], "job_id string, text string")
    assert reply_queries(replies).count() == 14 and reply_queries(replies, limit=10).count() == 10
    spec = RecordSpec.of([("company_name", "string", True), ("size", "integer"), ("ok", "boolean"), ("tags", "array")])
    texts = {
        "u1": json.dumps({"records": [{"Company Name": "Quay", "size": 7.9, "ok": True, "tags": ["a", " "]}, 3]}),
        "u2": json.dumps({"records": []}),
        "u3": "[1]",
        "u4": "no json",
        "u5": json.dumps({"other": 1}),
        "u6": json.dumps({"records": [{"company_name": "Pier", "size": "2.5", "ok": "no", "tags": "x;y"}]}),
    }
    parsed = parse_replies(spark.createDataFrame([("j", u, t) for u, t in texts.items()], "job_id string, url string, text string"))
    assert sorted(r["url"] for r in parsed.filter("records IS NOT NULL").collect()) == ["u1", "u2", "u5", "u6"]
    rows = validate_records(reply_candidates(parsed, spec, keys=["job_id", "url"]), spec).orderBy("source_url").collect()
    assert [tuple(r[h] for h in spec.headers) for r in rows] == [("Quay", 7, True, ["a"]), ("Pier", 2, False, ["x", "y"])]


RECORDS = RecordSpec.of([("company_name",), ("email", "email"), ("tags", "array")])


def record_frame(spark):
    return spark.createDataFrame(
        [("j", 1, "Quay | Works", "a@q.io", ["x", "y"]), ("j", 2, "Pier", None, None)],
        "job_id string, record_no long, company_name string, email string, tags array<string>",
    )


def test_file_exports(spark, tmp_path):
    records = record_frame(spark)
    out = export(records, RECORDS, "csv", str(tmp_path / "csv"), order=["record_no"])
    assert out == [{"format": "csv", "path": str(tmp_path / "csv"), "rows": 2}]
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines.count("company_name,email,tags") >= 1 and 'Quay | Works,a@q.io,"x, y"' in lines and "Pier,," in lines
    export(records, RECORDS, "markdown", str(tmp_path / "md"), order=["record_no"])
    files = sorted((tmp_path / "md").glob("part-*"))
    assert "".join(f.read_text() for f in files) == (
        "| company_name | email | tags |\n| --- | --- | --- |\n| Quay \\| Works | a@q.io | x, y |\n| Pier |  |  |\n"
    )
    export(records, RECORDS, "json", str(tmp_path / "json"), job_id="j", order=["record_no"])
    manifest = spark.read.json(str(tmp_path / "json" / "manifest")).first()
    assert manifest["count"] == 2 and manifest["fields"] == RECORDS.headers and manifest["job_id"] == "j"
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json" / "records")).collect()]
    assert {"company_name": "Pier", "email": None, "tags": None} in rows
    with pytest.raises(ValueError):
        export(records, RECORDS, "ftp", str(tmp_path))


def test_table_export_and_failed_sink(spark, tmp_path):
    assert table_name(" My Table! ") == "my_table" and table_name("--") == "records"
    records = record_frame(spark)
    write_table(records, ["company_name"], str(tmp_path), "t")
    write_table(records.withColumn("job_id", F.lit("k")), ["company_name", "email"], str(tmp_path), "t")
    got = {(r["job_id"], r["company_name"], r["email"]) for r in read_table(spark, str(tmp_path), "t").collect()}
    assert got == {("j", "Quay | Works", None), ("j", "Pier", None), ("k", "Quay | Works", "a@q.io"), ("k", "Pier", "")}
    (tmp_path / "file").write_text("x")
    out = export(records, RECORDS, "csv", str(tmp_path / "file" / "below"))
    assert out[0]["rows"] == 0 and out[0]["error"]


def test_remote_sinks_keep_a_mirror(spark, tmp_path):
    out = export(record_frame(spark), RECORDS, "webhook", str(tmp_path), job_id="j", order=["record_no"])
    assert [o["format"] for o in out] == ["json", "webhook"]
    out = export(record_frame(spark), RECORDS, "google_sheets", str(tmp_path / "s"), job_id="j", order=["record_no"])
    rows = spark.read.json(str(tmp_path / "s" / "google_sheets")).orderBy("row_no").collect()
    assert rows[0]["values"] == RECORDS.headers and rows[2]["values"] == ["Pier", "", ""]


def test_webhook_batches(spark):
    records = spark.range(5).select(F.lit("j").alias("job_id"), F.col("id").alias("n"))
    rows = webhook_batches(records, ["n"], position="n", batch_size=2).orderBy("batch").collect()
    assert [(r["batch"], r["batches"], r["count"]) for r in rows] == [(1, 3, 2), (2, 3, 2), (3, 3, 1)]
    assert json.loads(rows[1]["payload"])["records"] == [{"n": 2}, {"n": 3}]


def test_wide_row_number_on_a_hot_key(spark):
    """One key with most rows, ties included, against the plain numbering."""
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"), ((F.col("id") * 7919) % 977).alias("pos"), "id"
    )
    got = {(r["k"], r["id"]): r["rn"] for r in wide_row_number(rows, ["k"], ["pos", "id"], "rn").collect()}
    want = {}
    data = [(r["k"], r["pos"], r["id"]) for r in rows.collect()]
    for key in ("hot", "cold"):
        for i, (_, _, n) in enumerate(sorted(d for d in data if d[0] == key)):
            want[(key, n)] = i + 1
    assert got == want
    # All positions equal but for the last one, and the key's number of rows beside.
    same = spark.range(3000).select(F.lit("k").alias("k"), F.lit(1).alias("pos"), "id")
    numbered = wide_row_number(same, ["k"], ["pos", "id"], "rn", total="n")
    assert numbered.filter("rn <> id + 1 OR n <> 3000").count() == 0
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2


def test_intermediate_tables_need_a_shared_folder():
    """A stand-in session, as no cluster is at hand."""
    from types import SimpleNamespace

    from recordlake.plans.stages import checkpoint_root

    def session(master, **settings):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.replace(".", "_"), default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert checkpoint_root(session("local[2]", spark_sql_warehouse_dir="file:/here")) == "file:/here"
    shared = session("yarn", spark_checkpoint_dir="hdfs://a/b", spark_sql_warehouse_dir="file:/here")
    assert checkpoint_root(shared) == "hdfs://a/b"
    with pytest.raises(ValueError):
        checkpoint_root(session("yarn", spark_sql_warehouse_dir="file:/here"))


def test_named_checkpoint_folder_is_shared():
    """A deployment may share a mount: its checkpoint folder is taken as named, whatever the master."""
    from types import SimpleNamespace

    from recordlake.plans.stages import checkpoint_root

    def session(master, **settings):
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key.replace(".", "_"), default))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    for master in ("spark://here:7077", "yarn", "k8s://here", "local-cluster[3,4,1024]"):
        for folder in ("file:///mnt/shared", "file:/mnt/shared", "/mnt/shared"):
            assert checkpoint_root(session(master, spark_checkpoint_dir=folder, spark_sql_warehouse_dir="file:/here")) == folder
    assert checkpoint_root(session("spark://here:7077", spark_sql_warehouse_dir="file:/mnt/tables")) == "file:/mnt/tables"
    with pytest.raises(ValueError):
        checkpoint_root(session("spark://here:7077", spark_sql_warehouse_dir="file:/home/me/spark-warehouse"))


def test_events(spark, tmp_path):
    rows = [("a", 1, "stage", "planning"), ("a", 2, "record", "extracting"), ("a", 3, "summary", "completed"), ("a", 4, "stage", "completed"), ("b", 5, "stage", "queued")]
    events = spark.createDataFrame([(j, s, None, t, "info", st) for j, s, t, st in rows], "job_id string, seq long, ts timestamp_ntz, type string, level string, status string")
    path = str(tmp_path / "log")
    append_events(events, path)
    back = spark.read.parquet(path)
    assert back.filter("ts IS NULL").count() == 0
    assert [(r["job_id"], r["seq"], r["replay_no"]) for r in replay(back).orderBy("seq").collect()] == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 5, 1)]
    assert {r["job_id"]: (r["status"], r["done"]) for r in latest_status(back).collect()} == {"a": ("completed", True), "b": ("queued", False)}
    assert event_counts(back).filter("job_id = 'a' AND type = 'stage'").first()["n"] == 2


def _stream(spark, table, checkpoint, source, schema, targets=None):
    candidates = stream_candidates(read_page_stream(spark, source, schema, files_per_batch=1), SPEC)
    write_records(candidates, table, checkpoint=checkpoint, targets=targets).trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    pages = page_frame(spark, [("j", 1, "https://register.test/1", DIRECTORY), ("j", 2, "https://lakes.test/", PROFILE), ("j", 3, "https://bad.test/", "<title>404 Not Found</title>x")])
    source = str(tmp_path / "pages")
    pages.coalesce(1).write.parquet(source)
    table = RecordTable(spark, str(tmp_path / "table"), SPEC)
    _stream(spark, table, str(tmp_path / "state"), source, pages.schema)
    again = page_frame(spark, [("j", 9, "https://register.test/copy", DIRECTORY)])
    again.coalesce(1).write.mode("append").parquet(source)
    _stream(spark, table, str(tmp_path / "state"), source, pages.schema)
    from recordlake.operators.extract import extract_candidates

    batch = dedupe_records(accepted(validate_records(extract_candidates(page_text(pages.union(again)), SPEC), SPEC)), SPEC)

    def plain(df):
        return sorted((r["company_name"], r["email"], r["page_rank"]) for r in df.collect())

    assert plain(table.read()) == plain(batch)
    # A batch that runs twice replaces itself.
    rows = validate_records(extract_candidates(page_text(pages), SPEC), SPEC)
    table.write_batch(rows, 0)
    assert plain(table.read()) == plain(batch)
    assert [r["reason"] for r in skipped_pages(pages).collect()] == ["error page (404 Not Found)"]


def test_stream_stops_at_the_target(spark, tmp_path):
    pages = page_frame(spark, [("j", 1, "https://register.test/1", DIRECTORY), ("j", 2, "https://lakes.test/", PROFILE)])
    source = str(tmp_path / "pages")
    pages.repartition(2, "page_rank").write.parquet(source)
    table = RecordTable(spark, str(tmp_path / "table"), SPEC)
    targets = spark.createDataFrame([("j", 2)], "job_id string, max_records int")
    _stream(spark, table, str(tmp_path / "state"), source, pages.schema, targets)
    assert table.read().count() == 2
