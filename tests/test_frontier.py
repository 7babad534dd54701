"""Search results, frontier, planning and fetch outcomes."""

from pyspark.sql import functions as F

from recordlake.operators.fetches import fetch_outcomes, judge_attempts, skip_report
from recordlake.operators.frontier import build_frontier, frontier_funnel
from recordlake.operators.planning import plan_queries, with_targets
from recordlake.sources.search import limit_results, load_search_results, read_payloads, read_seeds, seed_results

INTENT = "List organic cheese dairies near Bergamo that sell wheels wholesale"


def frontier_of(spark, results, intent=INTENT, **options):
    rows = [("j", i, t, u, s, e, "q") for i, (t, u, s, e) in enumerate(results)]
    frame = spark.createDataFrame(rows, "job_id string, rank long, title string, url string, snippet string, engine string, query string")
    jobs = spark.createDataFrame([("j", intent)], "job_id string, intent string")
    return [r["url"] for r in build_frontier(frame, jobs, **options).orderBy("page_rank").collect()]


def test_off_topic_results_are_dropped(spark):
    """Two words of the intent, or their stems, have to occur in title, snippet or path."""
    one_word = [
        ("Bergamo airport arrivals", "https://fly.test/today", "", "x"),
        ("How to true bicycle wheels", "https://spokes.test/guide", "", "x"),
    ]
    two_words = [
        ("Alpine dairies", "https://alp.test/cheese", "", "x"),
        ("Shop", "https://shop.test/", "organically made, sold wholesale", "x"),
    ]
    assert frontier_of(spark, [one_word[0], two_words[0], one_word[1], two_words[1]]) == [r[1] for r in two_words]


def test_seeds_first_and_always(spark):
    results = [("Organic cheese dairies", "https://first.test/", "", "x"), ("", "https://given.test/unrelated", "", "seed")]
    assert frontier_of(spark, results) == ["https://given.test/unrelated", "https://first.test/"]


def test_thin_intent_passes_everything_in_order(spark):
    results = [("Z", "https://z.test/", "", "x"), ("Y", "https://y.test/news/y", "", "seed"), ("X", "https://x.test/", "", "x")]
    assert frontier_of(spark, results, "get cheese") == [r[1] for r in results]


def test_site_search_dropped_and_news_last(spark):
    title = "Organic cheese dairies"
    results = [
        (title, "https://gazette.test/news/dairies", "", "x"),
        (title, "https://pictures.test/search?q=cheese+dairies", "", "x"),
        (title, "https://plain.test/", "", "x"),
        (title + " directory", "https://register.test/", "", "x"),
    ]
    assert frontier_of(spark, results) == ["https://register.test/", "https://plain.test/", "https://gazette.test/news/dairies"]


def test_url_filters_dedupe_and_cap(spark):
    title = "Organic cheese dairies"
    results = [(title, u, "", "x") for u in (
        "https://a.test/1", "https://a.test/1", "ftp://a.test/2", "https://www.google.com/search?q=1",
        "https://a.test/x.pdf", "https://a.test/3", "https://a.test/4",
    )]
    assert frontier_of(spark, results) == ["https://a.test/1", "https://a.test/3", "https://a.test/4"]
    assert frontier_of(spark, results, max_pages=2) == ["https://a.test/1", "https://a.test/3"]
    rows = [("j", i, t, u, s, e) for i, (t, u, s, e) in enumerate(results)]
    frame = spark.createDataFrame(rows, "job_id string, rank long, title string, url string, snippet string, engine string")
    # The engine's own result page is off topic.
    funnel = frontier_funnel(frame, spark.createDataFrame([("j", INTENT)], "job_id string, intent string")).first()
    assert (funnel["raw_results"], funnel["on_topic_results"], funnel["unique_queued"]) == (7, 6, 3)


def test_payload_shapes(spark):
    payloads = [
        (0, '{"data": {"results": [{"url": "https://A.test/x/", "title": "T"}, 5]}}'),
        (1, '{"results": [{"link": "https://b.test", "name": "N", "description": "D"}]}'),
        (2, '[{"href": "https://c.test/?utm_x=1"}, {"url": "ftp://no"}, {"url": ""}]'),
        (3, '{"url": "https://d.test/1"}\nbad\n{"url": "https://d.test/2"}\n{broken'),
        (4, 'see https://e.test/a, <https://e.test/b>'),
        (5, '{"results": [], "organic": [{"url": "https://f.test/"}]}'),
        (6, ""),
        (7, '{"results": "text"}'),
    ]
    frame = spark.createDataFrame([("j", str(s), "cli", s, p) for s, p in payloads], "job_id string, query string, engine string, seq int, payload string")
    rows = load_search_results(frame, seq="seq").orderBy("rank").collect()
    assert [(r["query"], r["url"], r["title"], r["snippet"]) for r in rows] == [
        ("0", "https://a.test/x", "T", ""),
        ("1", "https://b.test/", "N", "D"),
        ("2", "https://c.test/", "https://c.test/?utm_x=1", ""),
        ("3", "https://d.test/1", "https://d.test/1", ""),
        ("3", "https://d.test/2", "https://d.test/2", ""),
        ("4", "https://e.test/a,", "https://e.test/a,", ""),
        ("4", "https://e.test/b", "https://e.test/b", ""),
        ("5", "https://f.test/", "https://f.test/", ""),
    ]


def test_readers_and_limits(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" https://a.test \n\nhttps://b.test\n")
    (tmp_path / "p.json").write_text('[{"url":\n"https://a.test"}]')
    assert sorted(r["url"] for r in read_seeds(spark, str(tmp_path / "seeds.txt")).collect()) == ["https://a.test", "https://b.test"]
    assert read_payloads(spark, str(tmp_path / "p.json")).first()["payload"].startswith("[")
    jobs = spark.createDataFrame([("j", [" https://a.test ", " "])], "job_id string, seed_urls array<string>")
    assert [r["url"] for r in seed_results(jobs).collect()] == ["https://a.test"]
    many = spark.range(40).select(F.lit("j").alias("job_id"), F.lit("q").alias("query"), F.lit("server").alias("engine"), F.col("id").alias("rank"))
    assert limit_results(many, 25, server_limit=20).count() == 20
    assert limit_results(many.withColumn("engine", F.lit("cli")), 25, server_limit=20).count() == 25
    assert limit_results(many, 39).count() == 39


def test_planned_queries(spark):
    rows = [
        ("a", 'Find  "marine gauges" makers in Norway.', ["email", "url"]),
        ("b", "get the list", ["string"]),
    ]
    jobs = spark.createDataFrame(rows, "job_id string, intent string, types array<string>").select(
        "job_id", "intent", F.transform("types", lambda t: F.struct(t.alias("type"))).alias("fields")
    )
    got = {}
    for r in plan_queries(jobs).orderBy("job_id", "query_no").collect():
        got.setdefault(r["job_id"], []).append(r["query"])
    assert got["a"] == [
        "marine gauges list",
        'Find "marine gauges" makers in Norway',
        "marine gauges makers in Norway directory",
        "marine gauges makers in Norway contact email",
        "marine gauges makers in Norway official website",
    ]
    assert got["b"] == ["get the list", "get the list directory"]


def test_targets_in_intents(spark):
    intents = ["Find 20 firms", "collect 500 leads", "scrape 42 records", "list firms with SOC 2 reports", "find 99999 startups", "find 20"]
    jobs = spark.createDataFrame([(t, 7 if i == 5 else None) for i, t in enumerate(intents)], "intent string, max_records int")
    assert [r["max_records"] for r in with_targets(jobs).collect()] == [20, 500, 42, None, None, 7]


_ATTEMPTS = "url string, engine string, attempt int, status int, exit_code int, content_type string, body string, log string"


def outcomes(spark, rows):
    frame = spark.createDataFrame(rows, _ATTEMPTS)
    return {r["url"]: r for r in fetch_outcomes(frame).collect()}


def test_fetch_outcomes(spark):
    rows = [
        ("https://a.test", "http", 1, 200, None, "text/html", "<p>x</p>", None),
        ("https://b.test", "cli", 1, None, 3, None, None, "HTTP 403 refused"),
        ("https://b.test", "http", 1, 200, None, "text/html", "later", None),
        ("https://c.test", "cli", 1, None, 1, None, None, "reset"),
        ("https://c.test", "cli", 2, None, 1, None, None, "reset again"),
        ("https://c.test", "http", 1, 500, None, None, None, None),
        ("https://d.test", "server", 1, 200, None, None, '{"success": false, "error": "boom"}', None),
        ("https://e.test", "server", 1, 200, None, None, '{"markdown": "# hi"}', None),
        ("https://f.test", "server", 1, 200, None, None, '{"data": {"content": "body"}}', None),
        ("https://f.test", "cli", 1, None, 1, None, None, "reset"),
        ("https://x.com/search", "http", 1, 200, None, None, "text", None),
        ("https://g.test", "http", 1, 999, None, None, None, None),
        ("https://h.test", "http", 1, 200, None, None, "  ", None),
    ]
    got = outcomes(spark, rows)
    assert got["https://a.test"]["text"] == "<p>x</p>"
    assert got["https://b.test"]["reason"] == "blocked (HTTP 403 refused)"
    assert got["https://c.test"]["reason"] == "HTTP 500 for https://c.test"
    assert got["https://d.test"]["reason"] == "boom"
    assert got["https://e.test"]["text"] == "# hi"
    assert got["https://f.test"]["text"] == "body" and got["https://f.test"]["engine"] == "server"
    assert got["https://x.com/search"]["reason"] == "blocked (domain pattern blocked)"
    assert got["https://g.test"]["reason"] == "blocked (HTTP 999)"
    assert got["https://h.test"]["reason"].startswith("no extractable content")
    frame = spark.createDataFrame(rows, _ATTEMPTS)
    report = skip_report(fetch_outcomes(frame), keys=("url",))
    assert report.count() == 6
    assert judge_attempts(frame).filter("outcome <> 'ok' AND text IS NOT NULL").count() == 0
