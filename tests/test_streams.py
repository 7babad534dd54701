"""Stream targets, replay, attempts and leads; versions of tables; block lists."""

import datetime

import pytest
from pyspark.sql import functions as F

from recordlake.operators.backfill import collect_leads
from recordlake.operators.blocklist import url_matches, without_blocked
from recordlake.operators.events import replay
from recordlake.operators.extract import extract_candidates, split_pages
from recordlake.operators.fetches import fetch_outcomes
from recordlake.operators.page_text import page_text
from recordlake.operators.quality import run_stats
from recordlake.operators.validate import validate_records
from recordlake.plans.snapshots import SnapshotLog
from recordlake.sinks.export import read_table, table_versions, write_table
from recordlake.spec import RecordSpec
from recordlake.streaming import state as state_module
from recordlake.streaming.attempts import AttemptTable
from recordlake.streaming.ingest import RecordTable, ReplayTable, stream_candidates
from recordlake.streaming.leads import first_addresses, stream_completed, stream_contacts, stream_leads
from recordlake.streaming.state import KeyedTable, StreamTarget

SPEC = RecordSpec.of([("Company Name", "string", True), ("email", "email", True), ("website", "url")])


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Versions


def test_versions_are_taken_once(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "t"))
    assert log.latest() is None and log.versions() == []
    assert log.commit(0, {"a": 1}) and log.commit(3, {"a": 2})
    assert not log.commit(3, {"a": 9})
    assert log.latest() == {"a": 2, "version": 3} and log.latest(before=3) == {"a": 1, "version": 0} and log.has(0)


def test_append_that_fails_midway_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("j", "a"), ("k", "b")], "job_id string, name string")
    root = str(tmp_path)
    write_table(rows, ["name"], root, "t", append_id="one")
    with pytest.raises(Exception, match="broken"):
        bad = rows.withColumn("name", F.expr("IF(name = 'a', name, raise_error('broken'))"))
        write_table(bad, ["name"], root, "t", append_id="two")
    assert read_table(spark, root, "t").count() == 2
    for _ in range(2):
        write_table(rows.withColumn("size", F.lit(1)), ["name", "size"], root, "t", append_id="two")
    assert rows_of(read_table(spark, root, "t").na.fill("-"), "job_id", "name", "size") == [("j", "a", "-"), ("j", "a", "1"), ("k", "b", "-"), ("k", "b", "1")]
    assert read_table(spark, root, "t", version=0).columns == ["job_id", "name", "source_at"]
    assert [r["n_folders"] for r in table_versions(spark, root, "t").orderBy("version").collect()] == [1, 2]


def test_appends_at_the_same_time(spark, tmp_path, monkeypatch):
    """Another append takes the number first; both are in the table."""
    rows = spark.createDataFrame([("j", "a")], "job_id string, name string")
    commit, once = SnapshotLog.commit, []

    def late(self, version, state):
        if not once:
            once.append(1)
            write_table(rows, ["name"], str(tmp_path), "t")
        return commit(self, version, state)

    monkeypatch.setattr(SnapshotLog, "commit", late)
    write_table(rows, ["name"], str(tmp_path), "t")
    assert read_table(spark, str(tmp_path), "t").count() == 2


# Keyed tables

SUMS = KeyedTable("sums", "k string, n long", ("k",), {"n": "sum(n)"}, buckets=8)


def add(target, batch_id, rows):
    batch = target.begin(batch_id)
    if batch is None:
        return None
    known = {r["k"]: r["n"] for r in batch.earlier("sums", rows).collect()}
    batch.add("sums", rows)
    return batch, known


def test_sums_over_many_batches_with_merged_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_module, "FAN_IN", 3)
    target, want = StreamTarget(spark, str(tmp_path / "t"), [SUMS]), {}
    for b in range(12):
        part = {f"k{(b * 7 + i) % 30}": i + 1 for i in range(12)}
        batch, known = add(target, b, spark.createDataFrame(list(part.items()), "k string, n long"))
        assert known == {k: want[k] for k in part if k in want}
        batch.commit()
        for k, n in part.items():
            want[k] = want.get(k, 0) + n
        assert add(target, b, spark.createDataFrame([("k0", 99)], "k string, n long")) is None
    assert {r["k"]: r["n"] for r in target.read("sums").collect()} == want
    folders = target.log.latest()["tables"]["sums"]
    assert len(folders) <= 6 and max(f["tier"] for f in folders) == 2
    before = target.log.folders("sums")
    assert len(before) > len(folders) and target.remove_unused() and len(target.log.folders("sums")) == len(folders)
    assert {r["k"]: r["n"] for r in target.read("sums").collect()} == want


def test_late_batch_reads_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    """Files that a batch of one key opens do not grow with the batches before it."""
    target, opened = StreamTarget(spark, str(tmp_path / "t"), [SUMS]), []
    read = state_module.Batch.earlier

    def counted(self, name, rows):
        known = read(self, name, rows)
        opened.append(len(known.inputFiles()))
        return known

    monkeypatch.setattr(state_module.Batch, "earlier", counted)
    for b in range(20):
        rows = spark.createDataFrame([(f"k{b}-{i}", 1) for i in range(40)], "k string, n long")
        batch, known = add(target, b, rows)
        assert known == {}
        batch.commit()
    opened.clear()
    batch, known = add(target, 20, spark.createDataFrame([("k3-5", 1)], "k string, n long"))
    assert known == {"k3-5": 1}
    # One bucket: at most FAN_IN - 1 files of each of the two size classes, and the batch's own key.
    assert opened[0] <= 2 * state_module.FAN_IN


def test_a_batch_that_fails_before_its_version_is_not_there(spark, tmp_path):
    target = StreamTarget(spark, str(tmp_path / "t"), [SUMS])
    batch, _ = add(target, 0, spark.createDataFrame([("a", 1)], "k string, n long"))
    assert target.read("sums").count() == 0
    batch, known = add(target, 0, spark.createDataFrame([("a", 5)], "k string, n long"))
    assert known == {}
    batch.commit()
    assert rows_of(target.read("sums"), "k", "n") == [("a", 5)]
    assert len(target.remove_unused()) == 1


# Records and counters

HEAD = "<tr><th>Company Name</th><th>Email</th><th>Website</th></tr>"


def listing(names):
    cells = "".join(f"<tr><td>{n}</td><td>{e}</td><td>https://{n.lower()}.test/</td></tr>" for n, e in names)
    return f"<html><title>Directory</title><body><h1>Members</h1><table>{HEAD}{cells}</table></body></html>"


def test_counters_equal_the_batch_after_every_batch(spark, tmp_path):
    spec, schema = SPEC, "job_id string, page_rank long, url string, html string"
    batches = [
        [("j", 1, "https://l.test/1", listing([("Quay", "a@quay.test"), ("Pier", "")])), ("k", 1, "https://l.test/1", listing([("Quay", "a@quay.test")]))],
        [("j", 2, "https://l.test/2", listing([("Quay", "a@quay.test"), ("Dock", "d@dock.test")])), ("j", 3, "https://bad.test/", "<title>404 Not Found</title>x")],
        [("k", 2, "https://l.test/2", listing([("Quay", "a@quay.test"), ("Dock", "d@dock.test"), ("Moor", "no")])), ("j", 4, "https://empty.test/", "<nav>x</nav>")],
    ]
    table, seen = RecordTable(spark, str(tmp_path / "t"), spec), []
    for b, pages in enumerate(batches):
        seen += pages
        rows = stream_candidates(spark.createDataFrame(pages, schema), spec)
        table.write_batch(rows, b)
        table.write_batch(rows, b)  # delivered again
        every = extract_candidates(page_text(spark.createDataFrame(seen, schema)), spec, with_pages=True)
        found, log = split_pages(every)
        want = run_stats(validate_records(found, spec), spec, log)
        names = "job_id pages candidates valid invalid duplicates validity_ratio".split()
        assert rows_of(table.counters(), *names) == rows_of(want, *names)
    assert rows_of(table.read(), "job_id", "company_name") == [("j", "Dock"), ("j", "Quay"), ("k", "Dock"), ("k", "Quay")]
    assert rows_of(table.skipped(), "url", "reason") == [
        ("https://bad.test/", "error page (404 Not Found)"), ("https://empty.test/", "no extractable content: https://empty.test/"),
    ]


def test_replay_goes_on_and_closes(spark, tmp_path):
    schema = "job_id string, seq long, type string"
    parts = [[("a", 1, "stage"), ("b", 2, "stage")], [("a", 3, "record"), ("a", 4, "summary"), ("a", 5, "stage")], [("a", 6, "stage"), ("b", 7, "record"), ("c", 8, "summary")]]
    table = ReplayTable(spark, str(tmp_path / "t"))
    for b, part in enumerate(parts):
        table.write_batch(spark.createDataFrame(part, schema), b)
        table.write_batch(spark.createDataFrame(part, schema), b)
    whole = replay(spark.createDataFrame([r for p in parts for r in p], schema))
    assert rows_of(table.read(), "job_id", "seq", "replay_no") == rows_of(whole, "job_id", "seq", "replay_no")


# Attempts and leads as streams


def test_attempts_settle_at_once_or_after_a_pause(spark, tmp_path):
    schema = "url string, engine string, attempt long, status int, exit_code int, content_type string, body string, log string, at timestamp"
    start = datetime.datetime(2024, 1, 1)

    def attempt(url, engine, no, status, minute, body="text"):
        return (url, engine, no, status, 0 if status == 200 else 1, "text/plain", body, f"got {status}", start + datetime.timedelta(minutes=minute))

    frames = [
        [attempt("https://a.test/", "cli", 1, 500, 0), attempt("https://b.test/", "cli", 1, 403, 0), attempt("https://c.test/", "cli", 1, 500, 0)],
        [attempt("https://a.test/", "http", 2, 200, 10), attempt("https://b.test/", "http", 2, 200, 10), attempt("https://c.test/", "http", 2, 500, 10)],
        [attempt("https://a.test/", "http", 3, 500, 20), attempt("https://later.test/", "http", 1, 200, 3000)],
    ]
    table, names = AttemptTable(spark, str(tmp_path / "t"), pause="1 hour"), "url state engine attempt reason".split()
    for b, rows in enumerate(frames):
        for _ in range(2):  # every batch is delivered twice
            table.write_batch(spark.createDataFrame(rows, schema), b)
        if b == 0:  # a refusal is known at once, failures are open
            assert rows_of(table.read(), "url", "state") == [("https://b.test/", "skipped")]
        if b == 1:
            assert rows_of(table.read(), "url", "state") == [("https://a.test/", "scraped"), ("https://b.test/", "skipped")]
    log = spark.createDataFrame([r for f in frames for r in f], schema)
    assert rows_of(table.read().na.fill("-"), *names) == rows_of(fetch_outcomes(log).na.fill("-"), *names)


def test_leads_meet_pages_or_expire(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)

    def at(hours):
        return start + datetime.timedelta(hours=hours)

    names = [("Quay", ""), ("Pier", ""), ("Dock", "")]
    page_schema = "job_id string, page_rank long, url string, html string, at timestamp"
    listings = [
        [("j", 1, "https://l.test/1", listing(names), at(0))],
        [("j", 2, "https://l.test/2", listing([("Quay", "")]), at(1))],
        [("j", 3, "https://l.test/3", listing([("Last", "")]), at(200))],
    ]
    site_schema = "url string, html string, at timestamp"

    def site(name, path, hours):
        return (f"https://{name}.test{path}", f"<p>sales@{name}.test</p>", at(hours))

    sites = [[site("quay", "/contact", 2), site("pier", "/", 3)], [site("dock", "/", 100)], [site("other", "/", 200)]]
    folders = {}
    for name, frames, schema in (("listing", listings, page_schema), ("site", sites, site_schema)):
        folders[name] = tmp_path / name
        for i, rows in enumerate(frames):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folders[name] / f"part={i}"))
    streams = [
        spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{folders[n]}/*") for n, s in (("listing", page_schema), ("site", site_schema))
    ]
    joined = stream_completed(stream_leads(streams[0], SPEC), stream_contacts(streams[1]))
    writer = joined.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    writer.format("parquet").start(str(tmp_path / "out")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(first_addresses(out), "website", "email") == [("https://pier.test/", "sales@pier.test"), ("https://quay.test/", "sales@quay.test")]
    # The pages of the third one came after its wait: both expired without an address.
    assert rows_of(out.filter("email IS NULL AND website = 'https://dock.test/'"), "page_no") == [(0,), (1,)]
    batch = collect_leads(extract_candidates(page_text(spark.createDataFrame(listings[0], page_schema)), SPEC, keys=("job_id", "page_rank")), SPEC)
    assert {r["website"] for r in batch.collect()} == {"https://quay.test/", "https://pier.test/", "https://dock.test/"}


# Block lists


def test_block_list_of_any_pattern(spark):
    urls = ["https://ads.example.test/x", "https://WWW.Spam-Farm.test/?q=1", "http://ok.test/", None, "", "https://ok.test/" + "a" * 300, "http://ok.test/"]
    patterns = ["ads.", "SPAM-farm", "?", "zz", "aaaaaaaaaaaaaaaaaaaa", " ", None, "ok.test/", "ads."]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "id int, url string, pattern string")
    listed = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    clean = {p.strip().lower() for p in patterns if p and p.strip()}
    want = sorted({(u, p) for u in urls if u for p in clean if p in u.lower()})
    assert rows_of(url_matches(frame, listed), "url", "pattern") == want
    left = {r["id"] for r in without_blocked(frame, listed).collect()}
    assert left == {i for i, u in enumerate(urls) if not u or not any(p in u.lower() for p in clean)}
    assert url_matches(frame, listed.limit(0)).count() == 0
    plan = url_matches(frame, listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # Grams are many times the patterns they were estimated by: none of them is sent to the driver.
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
