"""Extraction, validation, dedupe, backfill and quality."""

import pytest

from recordlake import RecordSpec
from recordlake.operators.backfill import collect_leads
from recordlake.operators.entities import dedupe_records, limit_records
from recordlake.operators.extract import extract_candidates, prefer_given, split_pages
from recordlake.operators.page_text import page_text
from recordlake.operators.quality import job_summary, quality_note, run_stats
from recordlake.operators.validate import accepted, validate_records

from .samples import DIRECTORY, LEAD_SPEC, PROFILE, SPEC, candidate_frame, page_frame


def records_of(spark, pages, spec):
    return accepted(validate_records(extract_candidates(page_text(page_frame(spark, pages)), spec), spec))


def markdown_frame(spark, rows):
    return spark.createDataFrame(rows, "job_id string, page_rank int, url string, markdown string, title string, reject string")


def raws(spark, markdown, spec, title="", url="https://dir.test/"):
    found = extract_candidates(markdown_frame(spark, [("j", 1, url, markdown, title, None)]), spec)
    return [r["raw"].asDict() for r in found.orderBy("cand_idx").collect()], found


def test_directory_page(spark):
    rows = records_of(spark, [("j", 1, "https://register.test/lakes", DIRECTORY)], SPEC).orderBy("cand_idx").collect()
    assert [r["company_name"] for r in rows] == ["Lumen Crossing", "Grebe Line", "LUMEN CROSSING", "Skerry Rowers"]
    assert rows[1]["email"] == "office@grebeline.fi" and rows[1]["fare"] == 1040.0
    assert [r["last_survey"] for r in rows] == ["2016-03-14", "2022-11-30", None, "2024-06-03"]
    assert [r["vessels"] for r in rows] == [4, 2, 4, 1]
    assert [r["carries_cars"] for r in rows] == [False, True, False, False]
    assert [r["ports"] for r in rows] == [["Aske", "Brund"], ["Tvern"], ["Aske"], ["Aske", "Ilm", "Orn"]]


def test_bold_key_with_inner_colon_is_no_pair(spark):
    row = records_of(spark, [("j", 1, "https://lakes.test/kelda", PROFILE)], SPEC).first()
    assert row["company_name"] == "Kelda Pontoons" and row["email"] == "quay@keldapontoons.is"
    assert row["homepage"] == "https://lakes.test/kelda" and row["vessels"] is None
    assert row["candidate_source"] == "bare"


def test_key_value_lines(spark):
    spec = RecordSpec.of([("company_name",), ("annual_revenue", "number"), ("email", "email"), ("site", "url")])
    text = "**Company Name**: Quay\n- Revenue: 5\nRevenue of annual size\n: 7\nRevenue： 9\n" + "Note: " + "x" * 401
    got, found = raws(spark, text, spec)
    # The last value of a key wins; the key keeps its first place.
    assert got == [{"company_name": "Quay", "annual_revenue": "9", "email": None, "site": "https://dir.test/"}]
    assert found.first()["source"] == "kv"


def test_words_of_a_field_match_a_longer_key(spark):
    spec = RecordSpec.of([("office_city",)])
    got, _ = raws(spark, "City of the main office: Kiel", spec)
    assert got == [{"office_city": "Kiel"}]


def test_table_rules(spark):
    spec = RecordSpec.of([("company_name",), ("email", "email"), ("url", "url")])
    table = (
        "| Company | Company | | E-mail |\n|---|---|---|---|\n\nnoise\n| A | B | c | d@e.io | extra |\n| F |\nend\n| G | H | i | j@k.io |"
        "\n\n| other | table |\n|---|---|\n| x | y |"
    )
    got, _ = raws(spark, table, spec)
    # A repeated header gives its last column; short rows are padded; the table ends at text.
    assert got == [
        {"company_name": "B", "email": "d@e.io", "url": None},
        {"company_name": None, "email": None, "url": None},
    ]


def test_table_needs_a_third_of_the_fields(spark):
    spec = RecordSpec.of([(f"field{i}",) for i in range(5)] + [("email", "email")])
    got, _ = raws(spark, "| email | other |\n|---|---|\n| a@b.io | x |", spec)
    assert got == [{**{f"field{i}": None for i in range(5)}, "email": "a@b.io"}]  # the bare candidate


def test_links_of_the_page(spark):
    text = "| name | website |\n|---|---|\n| [Quay](https://quay.io/x.) | Quay |\n| Pier | pier.org |"
    spec = RecordSpec.of([("name",), ("website", "url")])
    _, found = raws(spark, text, spec)
    rows = validate_records(found, spec).orderBy("cand_idx").collect()
    assert [(r["name"], r["website"]) for r in rows] == [("Quay", "https://quay.io/x"), ("Pier", "https://pier.org")]


def test_error_and_empty_pages(spark):
    pages = [
        ("j", 1, "https://a.test/", "<title>Access Denied</title><p>x@firm.io</p>"),
        ("j", 2, "https://b.test/", "<nav>menu</nav>"),
        ("j", 3, "https://c.test/", "<title>Firm</title><p>x@firm.io</p>"),
    ]
    text = page_text(page_frame(spark, pages))
    seen = extract_candidates(text, LEAD_SPEC, with_pages=True)
    candidates, log = split_pages(seen)
    assert [r["url"] for r in candidates.collect()] == ["https://c.test/"]
    reasons = {r["url"]: r["reject"] for r in log.collect()}
    assert reasons == {
        "https://a.test/": "error page (Access Denied)",
        "https://b.test/": "no extractable content: https://b.test/",
        "https://c.test/": None,
    }


def test_required_fields_and_ratio(spark):
    spec = RecordSpec.of([("company_name", "string", True), ("email", "email", True)])
    rows = [
        ("j", "https://x.linkedin.com", 1, {"company_name": "Acme", "email": "a@gmail.com"}),
        ("j", "https://x.linkedin.com", 2, {"company_name": "Nomail"}),
        ("j", "https://x.linkedin.com", 3, {"email": "x@gmail.com"}),
    ]
    validated = validate_records(candidate_frame(spark, rows, spec), spec)
    stats = quality_note(run_stats(validated, spec)).first()
    assert (stats["valid"], stats["invalid"], stats["duplicates"], stats["validity_ratio"]) == (1, 2, 0, 0.3333)
    assert stats["note"] == "validity ratio 33% below 90% target"
    errors = {r["page_rank"]: r["errors"] for r in validated.collect()}
    assert errors == {1: [], 2: ["email: missing"], 3: ["company_name: missing"]}


def test_case_does_not_make_a_new_record(spark):
    spec = RecordSpec.of([("email", "email")])
    rows = [("j", "https://one.io", 1, {"email": "a@b.io"}), ("j", "https://two.io", 2, {"Email": "A@B.io"})]
    valid = accepted(validate_records(candidate_frame(spark, rows, spec), spec))
    assert [r["page_rank"] for r in dedupe_records(valid, spec).collect()] == [1]


def test_shared_address_keeps_distinct_rows(spark):
    rows = [("j", "https://dir.test/", i, {"company_name": f"Firm {i}", "email": "info@shared.test", "website": f"https://f{i}.test"}) for i in range(3)]
    twice = rows + [(j, u, r + 10, d) for j, u, r, d in rows]
    valid = accepted(validate_records(candidate_frame(spark, twice, LEAD_SPEC), LEAD_SPEC))
    assert sorted(r["page_rank"] for r in dedupe_records(valid, LEAD_SPEC).collect()) == [0, 1, 2]
    assert run_stats(validate_records(candidate_frame(spark, twice, LEAD_SPEC), LEAD_SPEC), LEAD_SPEC).first()["duplicates"] == 3


def test_same_organisation_collapses(spark):
    rows = [
        ("j", "https://www.rivermag.com/a", 1, {"company_name": "River Mag", "email": "web@RiverMag.com", "website": "https://www.rivermag.com/"}),
        ("j", "https://www.rivermag.com/b", 2, {"company_name": "RiverMag.com", "email": "web@rivermag.com", "website": "https://www.rivermag.com/"}),
        ("j", "https://other.test/", 3, {"company_name": "Other Co", "email": "web@rivermag.com", "website": "https://other.test/"}),
        ("k", "https://www.rivermag.com/b", 4, {"company_name": "RiverMag.com", "email": "web@rivermag.com", "website": "https://www.rivermag.com/"}),
    ]
    valid = accepted(validate_records(candidate_frame(spark, rows, LEAD_SPEC), LEAD_SPEC))
    assert sorted(r["page_rank"] for r in dedupe_records(valid, LEAD_SPEC).collect()) == [1, 3, 4]


def test_zero_and_false_count_as_blank_in_keys(spark):
    spec = RecordSpec.of([("label",), ("n", "number"), ("ok", "boolean")])
    rows = [("j", "u", 1, {"label": "x", "n": "0", "ok": "no"}), ("j", "u", 2, {"label": "X"}), ("j", "u", 3, {})]
    valid = accepted(validate_records(candidate_frame(spark, rows, spec), spec))
    assert sorted(r["page_rank"] for r in dedupe_records(valid, spec).collect()) == [1, 3]


@pytest.mark.parametrize(
    "raw, url, want",
    [
        # A slogan gives way to the address's domain, also when the page is on a platform.
        ({"company_name": "Top Rated Ferry Service in Town", "email": "crew@saltmarsh.fi"}, "https://lakes.test/", "Saltmarsh"),
        ({"email": "tickets@ebbandflow.se"}, "https://www.linkedin.com/in/ebb", "Ebbandflow"),
        # A plain name stays, whatever the address is.
        ({"company_name": "Plover Barges", "email": "plover@yahoo.com"}, "https://www.linkedin.com/in/p", "Plover Barges"),
        # Free mail says nothing; the website does.
        ({"company_name": "Search Our Ferries Today", "email": "helm@gmail.com", "website": "https://tarn.is"}, "https://www.linkedin.com/in/t", "Tarn"),
        # With neither, the given text is kept.
        ({"company_name": "Search Our Ferries Today", "email": "helm@gmail.com"}, "https://www.linkedin.com/in/t", "Search Our Ferries Today"),
    ],
)
def test_name_derivation(spark, raw, url, want):
    spec = RecordSpec.of([("company_name", "string", True), ("email", "email", True), ("website", "url")])
    frame = candidate_frame(spark, [("j", url, 1, raw)], spec)
    row = validate_records(frame, spec).first()
    assert row["company_name"] == want and row["errors"] == []


def test_no_identity_stays_invalid(spark):
    spec = RecordSpec.of([("company_name", "string", True), ("email", "email", True)])
    row = validate_records(candidate_frame(spark, [("j", "https://www.linkedin.com/c", 1, {"email": "x@yahoo.co.in"})], spec), spec).first()
    assert row["errors"] == ["company_name: missing"]


def test_filled_url_still_counts_as_missing(spark):
    spec = RecordSpec.of([("url", "url", True)])
    frame = candidate_frame(spark, [("j", "https://a.test/", 1, {"url": ""})], spec)
    row = validate_records(frame, spec).first()
    assert row["url"] == "https://a.test/" and row["errors"] == ["url: missing"]
    assert validate_records(frame, spec, accept_filled=True).first()["errors"] == []


def test_reserved_names(spark):
    spec = RecordSpec.of([("job_id",)])
    with pytest.raises(ValueError):
        validate_records(candidate_frame(spark, [("j", "u", 1, {})], spec), spec)


def test_leads(spark):
    page = "https://register.test/open"
    rows = [
        ("j", page, 3, {"Company Name": "Teal Launches", "website": "teal-launches.se"}),
        ("j", page, 1, {"Company Name": "Teal", "website": "https://teal-launches.se"}),
        ("j", page, 2, {"Company Name": "Complete Ltd", "email": "pier@complete.se", "website": "https://complete.se"}),
        ("j", page, 4, {"Company Name": "Not An Address", "email": "ask at the pier", "website": "https://mole.is"}),
        ("j", page, 5, {"Company Name": "The Register", "website": page + "/"}),
        ("j", page, 6, {"Company Name": "  ", "website": "https://nameless.is"}),
        ("j", page, 7, {"Company Name": "Nowhere"}),
        ("k", page, 8, {"Company Name": "Other Job", "website": "https://teal-launches.se"}),
    ]
    leads = collect_leads(candidate_frame(spark, rows, LEAD_SPEC), LEAD_SPEC)
    assert sorted((r["job_id"], r["website"], r["company"]) for r in leads.collect()) == [
        ("j", "https://mole.is", "Not An Address"), ("j", "https://teal-launches.se", "Teal"),
        ("k", "https://teal-launches.se", "Other Job"),
    ]
    nothing_to_find = RecordSpec.of([("company", "string"), ("website", "url")])
    assert collect_leads(candidate_frame(spark, rows, nothing_to_find), nothing_to_find).count() == 0


def test_targets(spark):
    records = spark.createDataFrame([("a", i, 0) for i in range(8)] + [("b", i, 0) for i in range(3)], "job_id string, page_rank int, cand_idx int")
    jobs = spark.createDataFrame([("a", 2), ("b", None)], "job_id string, max_records int")
    kept = limit_records(records, jobs).collect()
    assert sorted((r["job_id"], r["page_rank"]) for r in kept) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]
    kept = limit_records(records, jobs, default=1).collect()
    assert sorted((r["job_id"], r["page_rank"]) for r in kept) == [("a", 0), ("a", 1), ("b", 0)]
    assert limit_records(records).count() == 11 and limit_records(records, default=2).count() == 4


def test_given_candidates_replace_heuristics(spark):
    pages = [("j", i, f"https://p{i}.test/", f"<title>Firm {i}</title><p>x@firm{i}.io</p>") for i in range(3)]
    found = extract_candidates(page_text(page_frame(spark, pages)), LEAD_SPEC)
    given = candidate_frame(spark, [("j", "https://p0.test/", 0, {"company_name": "Given", "email": "g@given.io"})], LEAD_SPEC)
    answered = spark.createDataFrame([("j", "https://p0.test/"), ("j", "https://p1.test/")], "job_id string, url string")
    mixed = prefer_given(found, given, answered, ["job_id", "url"])
    assert sorted((r["url"], r["source"]) for r in mixed.collect()) == [("https://p0.test/", "given"), ("https://p2.test/", "bare")]


def test_job_summary_states(spark):
    jobs = spark.createDataFrame([("a", "find firms"), ("b", " "), ("c", "find firms")], "job_id string, intent string")
    spec = RecordSpec.of([("email", "email", True)])
    validated = validate_records(candidate_frame(spark, [("a", "u", 1, {"email": "a@b.io"}), ("c", "u", 1, {"email": "no"})], spec), spec)
    exported = dedupe_records(accepted(validated), spec)
    queries = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "job_id string, query_no int, query string")
    outputs = spark.createDataFrame([("a", "csv", 1)], "job_id string, format string, rows int")
    timed = jobs.selectExpr("*", "current_timestamp() AS started_at")
    summary = job_summary(timed, run_stats(validated, spec), exported, queries=queries, outputs=outputs)
    rows = {r["job_id"]: r for r in summary.collect()}
    assert rows["a"]["outputs"][0]["format"] == "csv" and rows["a"]["duration_seconds"] >= 0
    assert rows["a"]["status"] == "completed" and rows["a"]["queries"] == ["one", "two"]
    assert rows["b"]["error"] == "intent is empty"
    assert rows["c"]["status"] == "failed" and rows["c"]["error"].startswith("the pages that were read")
