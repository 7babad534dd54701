"""Queries of single rules that whole jobs reach only in part: media, banners, given candidates, seeds, visited leads."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import functions as F

from ..functions.html import unescape
from ..functions.urls import is_site_search
from ..operators.backfill import collect_leads, open_leads
from ..operators.extract import attach_pages, candidates_from_maps, extract_candidates, prefer_given, split_pages
from ..operators.frontier import build_frontier
from ..operators.page_text import page_tables, page_text
from ..operators.planning import plan_queries
from ..operators.validate import accepted, validate_records
from ..plans.harvest import run_harvest
from ..plans.stages import materialise, spread
from ..sources.search import seed_results
from ..spec import RecordSpec
from .frontier import RESULTS_SQL, _STOP_SQL, jobs_of, results_of
from .pages import supplier_cells, supplier_pages
from .records import listing_pages, site_pages
from .registry import query

_SPEC = RecordSpec.of([("Company Name", "string", True), ("email", "email", True), ("website", "url")])


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _page(title, body):
    return _text("<html><head><title>", title, "</title></head><body>", body, "</body></html>")


def _parts(load):
    """Keys of the parts, dealt before each of them becomes a page."""
    return spread(load("part").select("p_partkey"), "p_partkey")


@query(
    """
    SELECT p_partkey, 'Part ' || p_partkey || ' ' || CASE p_partkey % 5 WHEN 0 THEN '![Photo of ' || p_partkey || ']'
      WHEN 1 THEN '![It is ' || p_partkey || ']' WHEN 2 THEN '![plain]' WHEN 3 THEN '' ELSE '' END || 'end' AS markdown FROM part
    """
)
def page_media(spark, load):
    """Alternative texts of images, quoted in every way or missing."""
    key = F.col("p_partkey").cast("string")
    image = (
        F.when(F.col("p_partkey") % 5 == 0, _text('<img src="a.png" alt="Photo of ', key, '">'))
        .when(F.col("p_partkey") % 5 == 1, _text("<IMG alt = 'It is ", key, "' src=a.png />"))
        .when(F.col("p_partkey") % 5 == 2, "<img alt=plain src=b.png>")
        .when(F.col("p_partkey") % 5 == 3, '<img src="a.png" alt="">')
        .otherwise('<img src="a.png">')
    )
    pages = _parts(load).select("p_partkey", F.lit("https://p.test/").alias("url"), _text("<p>Part ", key, " ", image, "end</p>").alias("html"))
    return page_text(pages).select("p_partkey", "markdown")


@query("SELECT p_partkey, 'before ' || p_partkey || chr(10) || chr(10) || 'after' AS element_scope, 'before ' || p_partkey AS rest_scope FROM part")
def page_banners(spark, load):
    """Banner elements dropped up to their own end, or with the rest of the page."""
    key = F.col("p_partkey").cast("string")
    body = _text("<p>before ", key, '</p><div id="top" class="x cookie-bar"><div>we use</div>cookies</div><p>after</p>')
    pages = _parts(load).select("p_partkey", F.lit("https://p.test/").alias("url"), body.alias("html"))
    element = page_text(pages).select("p_partkey", F.col("markdown").alias("element_scope"))
    rest = page_text(pages, banner_scope="rest").select("p_partkey", F.col("markdown").alias("rest_scope"))
    return element.join(rest, "p_partkey")


@query("SELECT p_partkey, '- a ' || p_partkey || chr(10) || chr(10) || ' - b' || chr(10) || chr(10) || ' - c' || chr(10) || chr(10) || '- stray' AS markdown FROM part")
def page_lists(spark, load):
    """Lists in lists, and an item behind all of them."""
    key = F.col("p_partkey").cast("string")
    body = _text("<ul><li>a ", key, "<UL><li>b<ol><li>c</li></ol></li></UL></li></ul><li>stray</li></ul>")
    pages = _parts(load).select("p_partkey", F.lit("https://p.test/").alias("url"), body.alias("html"))
    return page_text(pages).select("p_partkey", "markdown")


@query(
    """SELECT p_partkey, '| in ' || p_partkey || ' | deep |' || chr(10) || '| --- | --- |' || chr(10) || ' after in' || chr(10) || chr(10) || ' after mid'
      || chr(10) || chr(10) || '| next |' || chr(10) || '| --- |' AS markdown,
      'in ' || p_partkey || '/deep;next' AS cells FROM part"""
)
def page_nested_tables(spark, load):
    """Tables in cells of tables: the innermost one is drawn, rows around it are given up."""
    key = F.col("p_partkey").cast("string")
    body = _text(
        "<table><tr><td>outer ", key, "</td><td>before <table><tr><td>mid</td><td>x <table><tr><td>in ", key,
        "</td><td>deep</td></tr></table> after in</td></tr></table> after mid</td></tr><tr><td>lost</td></tr></table><table><tr><th>next</th></tr></table>",
    )
    pages = _parts(load).select("p_partkey", F.lit("https://p.test/").alias("url"), body.alias("html"))
    cells = page_tables(pages).groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("table_idx", "row_idx", "cells"))).alias("rows"))
    listed = F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], "/")), ";")
    return page_text(pages).select("p_partkey", "markdown").join(cells.select("p_partkey", listed.alias("cells")), "p_partkey")


_NAMES = sorted({name.removesuffix(";") for name in html5})


def _references(name: str) -> str:
    return f"a &{name}; b &{name} c &{name}1 d"


_REFERENCE_VALUES = ", ".join(
    f"({i}, '{html.unescape(_references(name)).replace(chr(39), chr(39) * 2)}')" for i, name in enumerate(_NAMES)
)


@query(
    f"""
    WITH names(i, decoded) AS (VALUES {_REFERENCE_VALUES}),
    keys AS (SELECT c_custkey, unnest([0, 1]) AS half FROM customer)
    SELECT c_custkey, half::INTEGER AS half, decoded FROM keys JOIN names ON i = (c_custkey * 2 + half) % {len(_NAMES)}
    """
)
def page_references(spark, load):
    """Every character reference of HTML 5, with the semicolon, without it and in front of a digit."""
    names = F.from_json(F.lit(json.dumps(_NAMES)), "array<string>")
    keys = load("customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    name = F.get(names, ((F.col("c_custkey") * 2 + F.col("half")) % len(_NAMES)).cast("int"))
    rows = keys.withColumn("name", name).withColumn("text", _text("a &", F.col("name"), "; b &", F.col("name"), " c &", F.col("name"), "1 d"))
    return rows.select("c_custkey", "half", F.expr(unescape("text")).alias("decoded"))


def _profiles(load):
    """A page of prose for every supplier: no table, no lines of keys and values."""
    key = F.col("s_suppkey").cast("string")
    body = _text("<p>write to hello@s", key, '.test or call</p><p><a href="https://www.s', key, '.test/">Visit Supplier ', key, "</a></p>")
    return load("supplier").select(
        _text("nation-", F.col("s_nationkey").cast("string")).alias("job_id"),
        F.col("s_suppkey").alias("page_rank"),
        _text("https://s", key, ".test/").alias("url"),
        _page(_text("Supplier ", key), body).alias("html"),
    )


@query(
    """SELECT 'nation-' || s_nationkey AS job_id, 'bare' AS candidate_source, 'Supplier ' || s_suppkey AS company_name,
    'hello@s' || s_suppkey || '.test' AS email, 'https://s' || s_suppkey || '.test/' AS website FROM supplier"""
)
def bare_candidates(spark, load):
    """Pages without any structure give one candidate: title, first address and own url."""
    found = extract_candidates(page_text(_profiles(load)), _SPEC)
    return accepted(validate_records(found, _SPEC)).select("job_id", "candidate_source", *_SPEC.headers)


@query(
    """SELECT 'nation-' || s_nationkey AS job_id, CASE s_suppkey % 3 WHEN 0 THEN 'given' ELSE 'bare' END AS candidate_source,
      CASE s_suppkey % 3 WHEN 0 THEN 'Given ' ELSE 'Supplier ' END || s_suppkey AS company_name,
      CASE s_suppkey % 3 WHEN 0 THEN 'given' ELSE 'hello' END || '@s' || s_suppkey || '.test' AS email,
      CASE s_suppkey % 3 WHEN 0 THEN 'https://www.s' ELSE 'https://s' END || s_suppkey || '.test/' AS website
    FROM supplier WHERE s_suppkey % 3 <> 1"""
)
def given_candidates(spark, load):
    """Answers from outside page by page: with a record, whose url is a link's label, without one, or none at all."""
    pages = _profiles(load)
    text = page_text(pages)
    key = F.col("page_rank").cast("string")
    answered = pages.filter("page_rank % 3 < 2").select("job_id", "url")
    raw = F.create_map(
        F.lit("Company Name"), _text("Given ", key), F.lit("E-Mail"), _text("given@s", key, ".test"), F.lit("website"), _text("Visit Supplier ", key)
    )
    rows = pages.filter("page_rank % 3 = 0").select("job_id", "url", "page_rank", F.lit(0).alias("cand_idx"), raw.alias("raw"))
    given = attach_pages(candidates_from_maps(rows, _SPEC), text, _SPEC)
    chosen = prefer_given(extract_candidates(text, _SPEC), given, answered, ["job_id", "url"])
    return accepted(validate_records(chosen, _SPEC)).select("job_id", "candidate_source", *_SPEC.headers)


_SEARCH_PATHS = {"/search/x": True, "/search?q=x": True, "/a/search?q=x": True, "/a/search/?q=x": True, "/a/search": False, "/research/x": False, "/Search/x": True, "/search": False}


@query(
    "SELECT page_id, CASE page_id % 8 "
    + " ".join(f"WHEN {i} THEN {str(hit).lower()}" for i, hit in enumerate(_SEARCH_PATHS.values()))
    + " END AS is_search FROM pages"
)
def site_search_urls(spark, load):
    """Pages of a site's own search."""
    paths = F.array(*[F.lit(p) for p in _SEARCH_PATHS])
    url = F.concat(F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.get(paths, (F.col("page_id") % 8).cast("int")))
    return load("pages").select("page_id", url.alias("url")).select("page_id", F.expr(is_site_search("url")).alias("is_search"))


@query(
    f"""
    WITH i AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'find "Blue Boats ' || (c_custkey + 100) || '" makers.'
        WHEN 1 THEN 'shops  for “Red Carts ' || (c_custkey + 100) || '” and "more"' ELSE 'no quotes ' || (c_custkey + 100) END AS intent,
        CASE c_custkey % 3 WHEN 0 THEN 'Blue Boats ' || (c_custkey + 100) WHEN 1 THEN 'Red Carts ' || (c_custkey + 100) END AS quoted FROM customer),
    b AS (SELECT *, rtrim(regexp_replace(intent, '\\s+', ' ', 'g'), '.') AS base FROM i),
    w AS (SELECT *, array_to_string(list_filter(regexp_extract_all(base, '[A-Za-z0-9][A-Za-z0-9+.#-]+'), lambda x: NOT list_contains({_STOP_SQL}, lower(x))), ' ') AS core FROM b),
    q AS (SELECT c_custkey, list_filter([quoted || ' list', base, core || ' directory', core || ' contact email'], lambda x: x IS NOT NULL) AS qs FROM w)
    SELECT 'job-' || c_custkey AS job_id, unnest(range(1, len(qs) + 1)) AS query_no, unnest(qs) AS query FROM q
    """
)
def quoted_intents(spark, load):
    """The first quoted phrase of an intent is searched as a list of its own."""
    key = (F.col("c_custkey") + 100).cast("string")
    intent = (
        F.when(F.col("c_custkey") % 3 == 0, _text('find "Blue Boats ', key, '" makers.'))
        .when(F.col("c_custkey") % 3 == 1, _text("shops  for “Red Carts ", key, '” and "more"'))
        .otherwise(_text("no quotes ", key))
    )
    jobs = load("customer").select(
        _text("job-", F.col("c_custkey").cast("string")).alias("job_id"), intent.alias("intent"), F.array(F.struct(F.lit("email").alias("type"))).alias("fields")
    )
    return plan_queries(jobs).select("job_id", F.col("query_no").cast("long").alias("query_no"), "query")


@query(
    RESULTS_SQL
    + """, firsts AS (SELECT * FROM keyed WHERE on_topic QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY k1, k2, k3, rank) = 1)
    SELECT job_id, url, is_seed, 2 + row_number() OVER (PARTITION BY job_id ORDER BY k1, k2, k3, rank, url) AS page_rank FROM firsts
    UNION ALL SELECT 'job-' || j, 'https://seed.test/' || j || '/' || n, true, n FROM range(3) a(j), range(1, 3) b(n)
      WHERE 'job-' || j IN (SELECT job_id FROM results)
    """
)
def seeded_frontier(spark, load):
    """Seed urls of every job ahead of its search results."""
    results = results_of(load)
    job = F.regexp_extract("job_id", "([0-9]+)$", 1)
    seeds = F.array(*[_text("https://seed.test/", job, f"/{n} ") for n in (1, 2)], F.lit(" "))
    jobs = jobs_of(results).withColumn("seed_urls", seeds)
    both = results.withColumn("rank", F.col("rank").cast("long")).unionByName(seed_results(jobs))
    return build_frontier(both, jobs).select("job_id", "url", "is_seed", F.col("page_rank").cast("long").alias("page_rank"))


@query(
    """
    SELECT 'nation-' || s_nationkey AS job_id, 'https://s' || s_suppkey || '.test' AS website,
      row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS lead_no
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 > 1
    """
)
def visited_leads(spark, load):
    """Leads whose site or contact page was read already are not visited again."""
    seen = materialise(extract_candidates(page_text(listing_pages(load)), _SPEC, with_pages=True), "listing")
    found, log = split_pages(seen)
    key = F.col("s_suppkey").cast("string")
    page = F.when(F.col("s_suppkey") % 4 == 0, _text("https://S", key, ".test")).otherwise(_text("https://s", key, ".test/contact/?utm_source=x#top"))
    read = load("supplier").filter("s_suppkey % 4 < 2").select(_text("nation-", F.col("s_nationkey").cast("string")).alias("job_id"), page.alias("url"))
    leads = open_leads(collect_leads(found, _SPEC), log.select("job_id", "url").unionByName(read))
    return leads.select("job_id", "website", F.col("lead_no").cast("long").alias("lead_no"))


def _both_waves(spark, load):
    """Listings with some e-mails, sites that were searched for as well, and targets that the first wave may meet."""
    cells = supplier_cells()
    key = F.col("s_suppkey").cast("string")
    cells["Website"] = _text("https://s", key, ".test")
    cells["Email"] = F.when(F.col("s_suppkey") % 4 == 0, cells["Email"]).otherwise("")
    listing = supplier_pages(load, {k: cells[k] for k in ("Company Name", "Email", "Website")})
    sites = load("supplier").join(load("nation"), F.col("s_nationkey") == F.col("n_nationkey")).filter("s_suppkey % 4 = 1")
    found = listing.select("job_id", F.col("page_rank").alias("rank"), "url").unionByName(
        sites.select(
            _text("nation-", F.col("n_nationkey").cast("string")).alias("job_id"),
            (F.col("s_suppkey") + 1_000_000).cast("long").alias("rank"),
            _text("https://s", key, ".test").alias("url"),
        )
    )
    results = found.select(
        "*",
        F.lit("Supplier company directory").alias("title"),
        F.lit("list of wholesale partners").alias("snippet"),
        F.lit("cli").alias("engine"),
        F.lit("q").alias("query"),
    )
    jobs = load("nation").select(
        _text("nation-", F.col("n_nationkey").cast("string")).alias("job_id"),
        F.lit("Find supplier companies with wholesale contact partners").alias("intent"),
        F.when(F.col("n_nationkey") % 2 == 0, 2).cast("int").alias("max_records"),
    )
    wanted = F.array(F.struct(F.lit("email").alias("type")), F.struct(F.lit("url").alias("type")))
    queries = plan_queries(jobs.withColumn("fields", wanted))
    pages = listing.select("url", "html").unionByName(site_pages(load))
    return run_harvest(_SPEC, jobs, results, pages, queries=queries)


_WAVES_SQL = """
    WITH s AS (SELECT n_nationkey, s_suppkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1000000000 END AS target
      FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    first AS (SELECT *, 1 AS wave, k % 4 AS kind FROM s WHERE k % 4 = 0 OR k % 12 = 9),
    had AS (SELECT n_nationkey, count(*) AS n FROM first GROUP BY 1),
    second AS (SELECT s.*, 2 AS wave, 0 AS kind FROM s LEFT JOIN had USING (n_nationkey) WHERE coalesce(n, 0) < target AND k % 4 > 1 AND k % 3 < 2),
    every AS (SELECT * FROM first UNION ALL SELECT * FROM second),
    placed AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY wave, kind, k) AS record_no FROM every)
"""


@query(
    _WAVES_SQL
    + """SELECT 'nation-' || n_nationkey AS job_id, record_no, 'Supplier ' || k AS company_name,
      CASE WHEN kind = 1 THEN 'webmaster@host.test' ELSE 'sales@s' || k || '.test' END AS email,
      'https://s' || k || '.test' || CASE WHEN kind = 1 THEN '/' ELSE '' END AS website FROM placed WHERE record_no <= target"""
)
def harvest_waves(spark, load):
    """Records of both waves: jobs that met their target and leads whose site was read have no second one."""
    records = _both_waves(spark, load).records
    return records.select("job_id", F.col("record_no").cast("long").alias("record_no"), *_SPEC.headers)


@query(
    _WAVES_SQL
    + """, counts AS (SELECT n_nationkey, count(*) AS valid, count(*) FILTER (wave = 2) AS later, count(*) FILTER (record_no <= target) AS exported FROM placed GROUP BY 1),
    pages AS (SELECT n_nationkey, count(DISTINCT k // 100) + count(*) FILTER (k % 4 = 1) AS queued, count(*) AS listed, count(*) FILTER (k % 4 = 1) AS sites FROM s GROUP BY 1)
    SELECT 'nation-' || nation.n_nationkey AS job_id, 4::BIGINT AS n_queries, coalesce(queued, 0) AS pages_queued, coalesce(queued, 0) AS pages_scraped,
      coalesce(listed + sites + coalesce(later, 0), 0) AS candidates, coalesce(valid, 0) AS valid,
      coalesce(listed + sites + coalesce(later, 0), 0) - coalesce(valid, 0) AS invalid, coalesce(exported, 0) AS records_exported,
      CASE WHEN coalesce(exported, 0) = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN coalesce(exported, 0) > 0 THEN 'webhook:' || exported END AS outputs
    FROM nation LEFT JOIN pages USING (n_nationkey) LEFT JOIN counts USING (n_nationkey)"""
)
def harvest_report(spark, load):
    """Summary of every job with its planned queries, counters of both waves and outputs."""
    done = _both_waves(spark, load)
    outputs = done.records.groupBy("job_id").agg(F.lit("webhook").alias("format"), F.count(F.lit(1)).alias("rows"))
    report = done.report(outputs)
    return report.select(
        "job_id",
        F.size("queries").cast("long").alias("n_queries"),
        "pages_queued", "pages_scraped", "candidates", "valid", "invalid", "records_exported", "status",
        F.array_join(F.transform("outputs", lambda o: F.concat(o["format"], F.lit(":"), o["rows"].cast("string"))), ",").alias("outputs"),
    )
