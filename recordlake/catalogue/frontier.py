"""Search results, frontier, planning and fetch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BLOCKED_URL_PATTERNS, DIRECTORY_HINT, NEWS_HINT, STOP_WORDS
from ..functions.urls import canonical_url, host_of, registrable_host, strip_www, unwrap_redirect
from ..operators.blocklist import url_matches
from ..operators.fetches import fetch_outcomes, first_answering_engine, skip_report
from ..operators.frontier import build_frontier, frontier_funnel, intent_tokens, query_counts
from ..operators.planning import plan_queries, with_targets
from ..plans.stages import first_per_key, spread
from ..sources.search import limit_results, load_search_results, seed_results
from .registry import query

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _canonical_sql(url: str) -> str:
    """Canonical form for urls whose parameters need no re-encoding."""
    path = f"rtrim(regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')"
    params = (
        f"list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), "
        "lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(lower(p), '^(utm_|fbclid|gclid|ref)'))"
    )
    return (
        f"lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract({url}, '://([^/?#]*)', 1)) "
        f"|| CASE WHEN {path} = '' THEN '/' ELSE {path} END "
        f"|| CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"
    )


@query(f"SELECT page_id, url, {_canonical_sql('url')} AS canonical FROM pages")
def canonical_urls(spark, load):
    return load("pages").select("page_id", "url", F.expr(canonical_url("url")).alias("canonical"))


_HOST = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"


@query(
    f"""
    SELECT regexp_extract({_HOST}, '([^.]+\\.[^.]+)$', 1) AS site, count(DISTINCT {_HOST}) AS hosts,
           count(*) AS pages FROM pages GROUP BY 1
    """
)
def host_rollup(spark, load):
    """Hosts and pages per registrable host."""
    hosts = load("pages").select(F.expr(strip_www(host_of("url"))).alias("host"))
    # Two partial aggregations instead of a distinct count in one group.
    per_host = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy(F.expr(registrable_host("host")).alias("site")).agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("pages")
    )


@query(
    """
    SELECT page_id, 'https://target.test/' || page_id || '?a=' || (page_id % 7) || '+b' AS target FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, url FROM pages WHERE page_id % 2 = 1
    """
)
def redirect_targets(spark, load):
    """Links wrapped by a search engine, unwrapped."""
    page = F.col("page_id").cast("string")
    target = F.concat(F.lit("https://target.test/"), page, F.lit("?a="), (F.col("page_id") % 7).cast("string"), F.lit("+b"))
    encoded = F.replace(F.replace(F.replace(F.replace(target, F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("?"), F.lit("%3F")), F.lit("="), F.lit("%3D"))
    wrapped = F.concat(F.lit("https://www.google.com/url?sa=D&q="), encoded, F.lit("&ust=1"))
    url = F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))
    return load("pages").select("page_id", url.alias("url")).select("page_id", F.expr(unwrap_redirect("url")).alias("target"))


# Pages as search results: the intent is made of syllables that occur in them.
_INTENT = "find the list of reliable partners with another thing and entre queue database"
_DIRECTORY = DIRECTORY_HINT.replace("(?i)", "").replace("\\d", "[0-9]")
_TOKENS = ["reliable", "partners", "another", "thing", "entre", "queue", "database"]


def results_of(load):
    pages = load("pages")
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    lead = F.regexp_extract("html", r"(?is)<p>\s*([^<]*)", 1)
    return pages.select(
        F.concat(F.lit("job-"), (F.col("page_id") % 3).cast("string")).alias("job_id"),
        F.col("page_id").alias("rank"),
        title.alias("title"),
        F.when(F.col("page_id") % 17 == 0, F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/news/"), F.col("page_id").cast("string")))
        .otherwise(F.col("url"))
        .alias("url"),
        F.when(F.col("page_id") % 5 == 0, F.concat(lead, F.lit(" company directory"))).otherwise(lead).alias("snippet"),
        F.when(F.col("page_id") % 10 == 0, "seed").otherwise("cli").alias("engine"),
        F.lit("q").alias("query"),
    )


def jobs_of(results):
    """Two jobs with a full intent and one whose intent says too little."""
    intent = F.when(F.col("job_id") == "job-2", "find leads").otherwise(_INTENT)
    return results.select("job_id").distinct().withColumn("intent", intent)


RESULTS_SQL = f"""
    WITH results AS (
      SELECT 'job-' || (page_id % 3) AS job_id, page_id AS rank, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
        CASE WHEN page_id % 17 = 0 THEN regexp_extract(url, '^(https?://[^/]+)', 1) || '/news/' || page_id ELSE url END AS url,
        regexp_extract(html, '(?is)<p>\\s*([^<]*)', 1) || CASE WHEN page_id % 5 = 0 THEN ' company directory' ELSE '' END AS snippet,
        CASE WHEN page_id % 10 = 0 THEN 'seed' ELSE 'cli' END AS engine
      FROM pages),
    paths AS (SELECT *, title || ' ' || snippet || ' ' || coalesce(nullif(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), ''), '/') AS txt,
        job_id = 'job-2' AS thin, engine = 'seed' AS is_seed FROM results),
    scored AS (SELECT *, CASE WHEN thin THEN CAST(contains(lower(txt), 'leads') AS BIGINT) ELSE len(list_filter({_TOKENS!r}, lambda t: contains(lower(txt), t) OR (length(t) >= 5 AND contains(lower(txt), left(t, 5))))) END AS hits FROM paths),
    keyed AS (SELECT *, thin OR is_seed OR hits >= 2 AS on_topic,
        CASE WHEN thin THEN 0 WHEN is_seed THEN -10000 ELSE -hits END AS k1,
        CASE WHEN NOT thin AND NOT is_seed AND regexp_matches(txt, '(?i){_DIRECTORY}') THEN -1 ELSE 0 END AS k2,
        CASE WHEN NOT thin AND NOT is_seed AND regexp_matches(url, '{NEWS_HINT}') THEN 1 ELSE 0 END AS k3 FROM scored)
"""


@query(
    RESULTS_SQL
    + """, firsts AS (SELECT * FROM keyed WHERE on_topic QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY k1, k2, k3, rank) = 1)
    SELECT job_id, url, hits, is_seed, row_number() OVER (PARTITION BY job_id ORDER BY k1, k2, k3, rank, url) AS page_rank
    FROM firsts
    """
)
def frontier_ranked(spark, load):
    """Ranked frontier of three jobs over all pages."""
    results = results_of(load)
    ranked = build_frontier(results, jobs_of(results))
    return ranked.select(
        "job_id", "url", F.col("hits").cast("long").alias("hits"), "is_seed", F.col("page_rank").cast("long").alias("page_rank")
    )


@query(
    RESULTS_SQL
    + """SELECT job_id, count(*) AS raw_results, count(*) FILTER (on_topic) AS on_topic_results,
    count(DISTINCT url) FILTER (on_topic) AS unique_queued FROM keyed GROUP BY job_id"""
)
def frontier_counts(spark, load):
    """Funnel per job: raw, on-topic, unique."""
    results = results_of(load)
    return frontier_funnel(results, jobs_of(results))


@query(
    f"""
    WITH noisy AS (
      SELECT page_id, url FROM pages
      UNION ALL SELECT page_id + 1000000, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=mail' FROM pages)
    SELECT {_canonical_sql('url')} AS canonical, min(page_id) AS first_id FROM noisy GROUP BY 1
    """
)
def frontier_dedupe(spark, load):
    """First result per canonical url among pages and their tracked copies."""
    pages = load("pages").select("page_id", "url")
    tracked = pages.select(
        (F.col("page_id") + 1000000).alias("page_id"),
        F.concat(
            F.regexp_replace("url", "#.*$", ""),
            F.when(F.col("url").contains("?"), "&").otherwise("?"),
            F.lit("utm_medium=mail"),
        ).alias("url"),
    )
    urls = pages.unionByName(tracked).select("page_id", F.expr(canonical_url("url")).alias("canonical"))
    return first_per_key(urls, ["canonical"], ["page_id"]).select("canonical", F.col("page_id").alias("first_id"))


_BLOCK_SQL = "|".join(p.replace(".", "\\.") for p in BLOCKED_URL_PATTERNS)


@query(
    f"""
    WITH urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://www.google.com/search?q=' || page_id
        WHEN 1 THEN url || '/file.PDF' WHEN 2 THEN 'ftp://files.test/' || page_id
        WHEN 3 THEN 'https://www.linkedin.com/pulse/' || page_id ELSE url END AS url FROM pages)
    SELECT page_id, url FROM urls WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), '{_BLOCK_SQL}')
      AND NOT regexp_matches(lower(url), '\\.(pdf|zip|exe|png|jpe?g|gif|svg|mp4)(\\?|$)')
    """
)
def fetchable_urls(spark, load):
    """Scheme, block-list and file-type filters."""
    from ..operators.frontier import fetchable

    page = F.col("page_id").cast("string")
    url = (
        F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("https://www.google.com/search?q="), page))
        .when(F.col("page_id") % 8 == 1, F.concat("url", F.lit("/file.PDF")))
        .when(F.col("page_id") % 8 == 2, F.concat(F.lit("ftp://files.test/"), page))
        .when(F.col("page_id") % 8 == 3, F.concat(F.lit("https://www.linkedin.com/pulse/"), page))
        .otherwise(F.col("url"))
    )
    return fetchable(load("pages").select("page_id", url.alias("url")))


@query(
    """
    WITH r AS (SELECT o_orderpriority AS job_id, o_orderstatus AS query, o_orderkey AS rank,
        CASE WHEN o_orderstatus = 'F' THEN 'server' ELSE 'cli' END AS engine FROM orders)
    SELECT job_id, query, engine, rank FROM r
    QUALIFY row_number() OVER (PARTITION BY job_id, query ORDER BY rank) <= CASE engine WHEN 'server' THEN 20 ELSE 25 END
    """
)
def query_result_limit(spark, load):
    """First results of every (job, query), with the server engine's own limit."""
    results = load("orders").select(
        F.col("o_orderpriority").alias("job_id"),
        F.col("o_orderstatus").alias("query"),
        F.when(F.col("o_orderstatus") == "F", "server").otherwise("cli").alias("engine"),
        F.col("o_orderkey").alias("rank"),
    )
    return limit_results(results, 25, server_limit=20)


@query("SELECT o_orderpriority AS job_id, o_orderstatus AS query, count(*) AS n_results FROM orders GROUP BY 1, 2")
def query_result_counts(spark, load):
    return query_counts(
        load("orders").select(F.col("o_orderpriority").alias("job_id"), F.col("o_orderstatus").alias("query"))
    )


def _payload(load):
    """Search payloads in every accepted shape, one per page."""
    page = load("pages").select("page_id", "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))
    entry = F.to_json(F.struct("url", "title", F.lit("about").alias("snippet")))
    renamed = F.to_json(F.struct(F.col("url").alias("link"), F.col("title").alias("name"), F.lit("about").alias("description")))
    junk = F.to_json(F.struct(F.lit("ftp://files.test/x").alias("url")))
    shape = F.col("page_id") % 6

    def join(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    payload = (
        F.when(shape == 0, join("[", entry, ", 7, ", junk, "]"))
        .when(shape == 1, join('{"results": [', renamed, "]}"))
        .when(shape == 2, join('{"results": [], "data": {"results": [', entry, ', "x"]}}'))
        .when(shape == 3, join('{"organic": [', renamed, "]}"))
        .when(shape == 4, join(entry, "\nnot json\n{broken\n", junk))
        .otherwise(join("see <", F.col("url"), "> for more"))
    )
    return page.select(
        F.concat(F.lit("job-"), (F.col("page_id") % 3).cast("string")).alias("job_id"),
        F.col("page_id").cast("string").alias("query"),
        F.lit("cli").alias("engine"),
        F.col("page_id").alias("seq"),
        payload.alias("payload"),
    )


@query(
    f"""
    SELECT 'job-' || (page_id % 3) AS job_id, CAST(page_id AS VARCHAR) AS query, page_id * 1000000 AS rank,
      CASE WHEN page_id % 6 = 5 THEN url ELSE coalesce(nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), ''), url) END AS title,
      {_canonical_sql('url')} AS url, CASE WHEN page_id % 6 = 5 THEN '' ELSE 'about' END AS snippet
    FROM pages
    """
)
def search_payloads(spark, load):
    """Search results read from lists, envelopes, JSON lines and free text."""
    found = load_search_results(_payload(load), seq="seq")
    return found.select("job_id", "query", "rank", "title", "url", "snippet")


@query(
    """
    SELECT 'job-' || n_nationkey AS job_id, CAST(-2 AS BIGINT) AS rank, 'https://n' || n_nationkey || '.test/' AS url FROM nation
    UNION ALL SELECT 'job-' || n_nationkey, CAST(-1 AS BIGINT), 'https://n' || n_nationkey || '.test/about' FROM nation
    """
)
def seed_urls(spark, load):
    """Seeds trimmed, blanks dropped, ranked ahead of search results."""
    base = F.concat(F.lit("https://n"), F.col("n_nationkey").cast("string"), F.lit(".test/"))
    jobs = load("nation").select(
        F.concat(F.lit("job-"), F.col("n_nationkey").cast("string")).alias("job_id"),
        F.array(F.concat(F.lit("  "), base), F.lit(" "), F.concat(base, F.lit("about "))).alias("seed_urls"),
    )
    return seed_results(jobs).select("job_id", "rank", "url")


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query(
    f"""
    WITH base AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark),
    b AS (SELECT item_id, rtrim(t, '.!?') AS base FROM base),
    w AS (SELECT item_id, base, list_filter(regexp_extract_all(base, '[A-Za-z0-9][A-Za-z0-9+.#-]+'),
            lambda x: NOT list_contains({_STOP_SQL}, lower(x))) AS words FROM b),
    c AS (SELECT item_id, base, coalesce(nullif(array_to_string(words, ' '), ''), base) AS core FROM w),
    q AS (SELECT item_id, [base, core || ' directory', core || ' contact email', core || ' official website'] AS qs FROM c)
    SELECT 'job-' || item_id AS job_id, unnest(range(1, len(qs) + 1)) AS query_no, unnest(qs) AS query FROM q
    """
)
def planned_queries(spark, load):
    """Search queries planned for every benchmark text as an intent."""
    jobs = load("benchmark").select(
        F.concat(F.lit("job-"), F.col("item_id").cast("string")).alias("job_id"),
        F.col("text").alias("intent"),
        F.array(F.struct(F.lit("email").alias("type")), F.struct(F.lit("url").alias("type"))).alias("fields"),
    )
    return plan_queries(jobs).select("job_id", F.col("query_no").cast("long").alias("query_no"), "query")


@query(
    f"""
    WITH words AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'),
        lambda x: NOT list_contains({_STOP_SQL}, x))) AS tokens FROM documents)
    SELECT doc_id, len(tokens) AS n_tokens, array_to_string(list_sort(tokens), ' ') AS tokens FROM words
    """
)
def content_tokens(spark, load):
    """Distinct content words of every document."""
    tokens = load("documents").select("doc_id", F.expr(intent_tokens("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


@query(
    """
    SELECT 'job-' || c_custkey AS job_id, CASE c_custkey % 6
        WHEN 0 THEN CASE WHEN c_custkey BETWEEN 1 AND 2000 THEN c_custkey END
        WHEN 1 THEN 42 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 7
        ELSE CASE WHEN c_custkey % 500 >= 1 THEN c_custkey % 500 END END AS max_records
    FROM customer
    """
)
def intent_targets(spark, load):
    """Record targets stated in an intent; an explicit target wins."""
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 6
    # A four-digit number is the longest that is read as a count.
    number = F.when(F.length(key) <= 4, key).otherwise("none")
    intent = (
        F.when(kind == 0, F.concat(F.lit("Find "), number, F.lit(" startups in "), "c_mktsegment"))
        .when(kind == 1, F.concat(F.lit("pages with 42 records on "), "c_mktsegment"))
        .when(kind == 2, F.concat(F.lit("list companies in "), "c_mktsegment"))
        .when(kind == 3, F.concat(F.lit("find 99999 startups in "), "c_mktsegment"))
        .when(kind == 4, F.lit("find 20 startups"))
        .otherwise(F.concat(F.lit("please gather "), (F.col("c_custkey") % 500).cast("string"), F.lit(" leads")))
    )
    jobs = load("customer").select(
        F.concat(F.lit("job-"), key).alias("job_id"), intent.alias("intent"), F.when(kind == 4, 7).alias("max_records")
    )
    return with_targets(jobs).select("job_id", F.col("max_records").cast("long").alias("max_records"))


def attempts_of(load):
    """Fetch log made of line items: one url per order, one attempt per item."""
    item = spread(load("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey")
    number = F.col("l_linenumber")
    engine = F.when(number <= 2, "cli").when(number <= 4, "server").otherwise("http")
    fate = (F.col("l_orderkey") * 7 + F.col("l_partkey") + number) % 10
    url = F.concat(F.lit("https://shop.test/"), F.col("l_orderkey").cast("string"))
    body = F.concat(F.lit("item "), F.col("l_partkey").cast("string"))
    return item.select(
        url.alias("url"),
        engine.alias("engine"),
        (number.cast("long") * 10**9 + F.col("l_partkey")).alias("attempt"),
        F.when(engine == "cli", F.lit(None)).when(fate == 0, 403).when(fate <= 4, 500).otherwise(200).cast("int").alias("status"),
        F.when((engine == "cli") & (fate <= 4), 1).otherwise(0).alias("exit_code"),
        F.lit("text/plain").alias("content_type"),
        F.when(engine == "server", F.concat(F.lit('{"success": true, "data": {"markdown": "'), body, F.lit('"}}'))).otherwise(body).alias("body"),
        F.when(fate == 0, "got 403 from host").otherwise("connection reset").alias("log"),
    )


ATTEMPTS_SQL = """
    WITH a AS (
      SELECT 'https://shop.test/' || l_orderkey AS url, CASE WHEN l_linenumber <= 2 THEN 'cli' WHEN l_linenumber <= 4 THEN 'server' ELSE 'http' END AS engine,
        CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS attempt, (l_orderkey * 7 + l_partkey + l_linenumber) % 10 AS fate, 'item ' || l_partkey AS body FROM lineitem),
    j AS (SELECT *, CASE WHEN fate = 0 THEN 'blocked' WHEN fate <= 4 THEN 'error' ELSE 'ok' END AS outcome FROM a),
    s AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY url ORDER BY outcome = 'error', CASE WHEN outcome = 'error' THEN -attempt ELSE attempt END) = 1),
    o AS (SELECT url, CASE outcome WHEN 'ok' THEN 'scraped' ELSE 'skipped' END AS state, engine, attempt, CASE WHEN outcome = 'ok' THEN body END AS text,
      CASE WHEN outcome = 'blocked' THEN CASE engine WHEN 'cli' THEN 'blocked (got 403 from host)' ELSE 'blocked (HTTP 403)' END
           WHEN outcome = 'error' THEN CASE engine WHEN 'cli' THEN 'fetcher exited 1: connection reset'
             WHEN 'server' THEN 'server scrape HTTP 500 for ' || url ELSE 'HTTP 500 for ' || url END END AS reason FROM s)
"""


@query(ATTEMPTS_SQL + "SELECT url, state, engine, attempt, text, reason FROM o")
def fetch_results(spark, load):
    """The attempt that settled every url."""
    return fetch_outcomes(attempts_of(load)).select("url", "state", "engine", "attempt", "text", "reason")


@query(ATTEMPTS_SQL + "SELECT 'shop' AS job_id, url, reason FROM o WHERE reason IS NOT NULL")
def skipped_urls(spark, load):
    """Skip report of the fetch log."""
    return skip_report(fetch_outcomes(attempts_of(load)).withColumn("job_id", F.lit("shop")))


@query(
    """
    WITH a AS (SELECT 'job-' || (o_custkey % 50) AS job_id, 'q' || (o_custkey % 7) AS query, o_orderkey AS rank,
        CASE o_orderstatus WHEN 'F' THEN 'searxng' WHEN 'O' THEN 'cli' ELSE 'server' END AS engine FROM orders)
    SELECT job_id, query, engine, rank FROM a
    QUALIFY CASE engine WHEN 'server' THEN 1 WHEN 'cli' THEN 2 ELSE 3 END = min(CASE engine WHEN 'server' THEN 1 WHEN 'cli' THEN 2 ELSE 3 END) OVER (PARTITION BY job_id, query)
    """
)
def engine_precedence(spark, load):
    """Search results of the first engine that answered a query."""
    answers = load("orders").select(
        F.concat(F.lit("job-"), (F.col("o_custkey") % 50).cast("string")).alias("job_id"),
        F.concat(F.lit("q"), (F.col("o_custkey") % 7).cast("string")).alias("query"),
        F.when(F.col("o_orderstatus") == "F", "searxng").when(F.col("o_orderstatus") == "O", "cli").otherwise("server").alias("engine"),
        F.col("o_orderkey").alias("rank"),
    )
    return first_answering_engine(answers).select("job_id", "query", "engine", "rank")


_LISTED = "CASE k % 4 WHEN 0 THEN '/' || k WHEN 1 THEN 'EN/' || (k % 1000) WHEN 2 THEN substr(c_name, 3, 9) || '.example' ELSE 'th' || chr((97 + k % 26)::INTEGER) || 're' END"


@query(
    f"""
    WITH listed AS (SELECT DISTINCT lower({_LISTED}) AS pattern FROM (SELECT c_custkey AS k, c_name FROM customer)
      UNION SELECT * FROM (VALUES ('-farm'), ('?'), ('spam'), ('example.org/fr/'))),
    hits AS (SELECT url, count(*) AS n, min(pattern) AS first FROM (SELECT DISTINCT url FROM pages) JOIN listed ON contains(lower(url), pattern) GROUP BY url)
    SELECT page_id, pages.url, coalesce(n, 0) AS n_patterns, first AS first_pattern FROM pages LEFT JOIN hits USING (url)
    """
)
def blocked_by_list(spark, load):
    """Urls against a block list that grows with the data: patterns of every length met at their rarest part."""
    k = F.col("c_custkey")
    pattern = (
        F.when(k % 4 == 0, F.concat(F.lit("/"), k.cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("EN/"), (k % 1000).cast("string")))
        .when(k % 4 == 2, F.concat(F.substring("c_name", 3, 9), F.lit(".example")))
        .otherwise(F.concat(F.lit("th"), F.char(97 + k % 26), F.lit("re")))
    )
    fixed = spark.sql("SELECT * FROM VALUES ('-farm'), ('?'), ('Spam '), ('example.org/fr/'), (' '), (NULL) AS t(pattern)")
    listed = load("customer").select(pattern.alias("pattern")).unionByName(fixed)
    pages = load("pages").select("page_id", "url")
    hits = url_matches(pages, listed).groupBy("url").agg(F.count(F.lit(1)).alias("n_patterns"), F.min("pattern").alias("first_pattern"))
    return pages.join(hits, "url", "left").select("page_id", "url", F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"), "first_pattern")


_MANY_JOBS = ("urgent delivery partner", "medium shipping clerk", "specified high delivery", "low")


@query(
    f"""
    WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 1000 END AS j, o_orderkey AS rank, o_orderpriority AS title,
        CASE WHEN o_orderkey % 2 = 0 THEN 'delivery service' ELSE 'shipping clerk' END AS snippet,
        'https://h' || (o_custkey % 50) || '.test/o/' || (o_orderkey % 4000) AS url FROM orders),
    t AS (SELECT *, string_split([{", ".join(f"'{i}'" for i in _MANY_JOBS)}][1 + j % 4], ' ') AS tokens, lower(title || ' ' || snippet) AS txt FROM r),
    s AS (SELECT *, len(tokens) < 3 AS thin, len(list_filter(tokens, lambda w: contains(txt, w) OR (length(w) >= 5 AND contains(txt, left(w, 5))))) AS hits FROM t),
    k AS (SELECT *, CASE WHEN thin THEN 0 ELSE -hits END AS k1 FROM s WHERE thin OR hits >= 2),
    firsts AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY j, url ORDER BY k1, rank) = 1)
    SELECT 'job-' || j AS job_id, url, hits, row_number() OVER (PARTITION BY j ORDER BY k1, rank, url) AS page_rank FROM firsts
    """
)
def frontier_many_jobs(spark, load):
    """Ranked frontiers of 1 000 jobs, of which one holds a third of all results."""
    orders = spread(load("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    number = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 1000)
    results = orders.select(
        F.concat(F.lit("job-"), number.cast("string")).alias("job_id"),
        F.col("o_orderkey").alias("rank"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://h"), (F.col("o_custkey") % 50).cast("string"), F.lit(".test/o/"), (F.col("o_orderkey") % 4000).cast("string")).alias("url"),
        F.when(F.col("o_orderkey") % 2 == 0, "delivery service").otherwise("shipping clerk").alias("snippet"),
        F.lit("cli").alias("engine"),
        F.lit("q").alias("query"),
    )
    intents = F.array(*[F.lit(i) for i in _MANY_JOBS])
    kind = F.regexp_extract("job_id", "([0-9]+)$", 1).cast("int") % 4
    jobs = results.select("job_id").distinct().withColumn("intent", F.get(intents, kind))
    ranked = build_frontier(results, jobs)
    return ranked.select("job_id", "url", F.col("hits").cast("long").alias("hits"), F.col("page_rank").cast("long").alias("page_rank"))
