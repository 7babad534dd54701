"""Extraction, validation, dedupe, backfill and whole-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..functions.contacts import preferred_email
from ..operators.backfill import backfill_candidates, collect_leads, lead_pages, open_leads, page_contacts
from ..operators.entities import dedupe_records, limit_records
from ..operators.extract import candidates_from_maps, extract_candidates, split_pages
from ..operators.page_text import page_text
from ..operators.quality import NO_RECORDS, quality_note, run_stats
from ..operators.validate import accepted, rejected, validate_records
from ..plans.harvest import corpus_by_url, run_harvest
from ..plans.stages import materialise, spread
from ..sources.corpora import key_value_page
from ..spec import FieldSpec, RecordSpec
from .pages import supplier_cells, supplier_pages
from .registry import query

SUPPLIERS = RecordSpec.of(
    [("Company Name", "string", True), ("email", "email", True), ("website", "url"), ("balance", "number")]
)

_SUPPLIER_RECORD = """'Supplier ' || s_suppkey AS company_name, 'sales@s' || s_suppkey || '.test' AS email,
    'https://s' || s_suppkey || '.test/' AS website, CAST(s_acctbal AS DOUBLE) AS balance"""


@query(
    f"""SELECT 'nation-' || n_nationkey AS job_id, s_suppkey // 100 AS page_rank, 'table' AS candidate_source, {_SUPPLIER_RECORD}
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def directory_extract(spark, load):
    """Directory pages to typed records: what was rendered comes back."""
    found = extract_candidates(page_text(supplier_pages(load)), SUPPLIERS)
    valid = accepted(validate_records(found, SUPPLIERS))
    return valid.select("job_id", "page_rank", "candidate_source", *SUPPLIERS.headers)


CUSTOMERS = RecordSpec.of(
    [
        ("company", "string", True),
        ("email", "email", True),
        ("website", "url"),
        ("segment", "string"),
        ("employees", "integer"),
        ("active", "boolean"),
        ("founded", "date"),
        ("tags", "array"),
    ]
)


def customer_pages(load):
    """One profile page of key-value lines per customer."""
    key = F.col("c_custkey").cast("string")
    pairs = {
        "Email": F.concat(F.lit("Info@C"), key, F.lit(".test")),
        "Segment": F.lower("c_mktsegment"),
        "Employees": F.concat(F.lit("about "), F.format_number(F.col("c_custkey") * 3, 0), F.lit(" people")),
        "Active": F.when(F.col("c_custkey") % 2 == 0, "YES").otherwise("inactive"),
        "Founded": F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 5000).cast("int")), "d MMM yyyy"),
        "Tags": F.concat(F.lit("a"), (F.col("c_custkey") % 7).cast("string"), F.lit("; b | c"), key),
    }
    return spread(load("customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(
        F.lit("customers").alias("job_id"),
        F.col("c_custkey").alias("page_rank"),
        F.concat(F.lit("https://www.c"), key, F.lit(".test/")).alias("url"),
        key_value_page(F.concat(F.lit("Customer "), key), pairs).alias("html"),
    )


@query(
    """
    SELECT c_custkey AS page_rank, 'Customer ' || c_custkey AS company, 'info@c' || c_custkey || '.test' AS email,
      'https://www.c' || c_custkey || '.test/' AS website, lower(c_mktsegment) AS segment, c_custkey * 3 AS employees, c_custkey % 2 = 0 AS active,
      CAST(DATE '1990-01-01' + CAST(c_custkey % 5000 AS INTEGER) AS VARCHAR) AS founded,
      'a' || (c_custkey % 7) || '/b/c' || c_custkey AS tags
    FROM customer
    """
)
def kv_extract(spark, load):
    """Profile pages to typed records; name and website come from page defaults."""
    found = extract_candidates(page_text(customer_pages(load)), CUSTOMERS)
    valid = accepted(validate_records(found, CUSTOMERS))
    return valid.select("page_rank", *[h for h in CUSTOMERS.headers if h != "tags"], F.array_join("tags", "/").alias("tags"))


ORDERS = RecordSpec.of([("order", "integer", True), ("email", "email", True), ("total", "number"), ("placed", "date"), ("shop", "url")])


@query(
    """
    SELECT o_orderkey AS "order", 'buyer' || o_custkey || '@shop.test' AS email, o_totalprice AS total,
      strftime(o_orderdate, '%Y-%m-%d') AS placed, 'https://shop.test/orders/' || o_orderkey AS shop
    FROM orders
    """
)
def order_pages(spark, load):
    """One page per order: the largest rendered corpus, page to record."""
    key = F.col("o_orderkey").cast("string")
    pairs = {
        "Order": F.concat(F.lit("no. "), key),
        "Email": F.concat(F.lit("buyer"), F.col("o_custkey").cast("string"), F.lit("@shop.test")),
        "Total": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        "Placed": F.date_format(F.col("o_orderdate").cast("date"), "d MMM yyyy"),
    }
    orders = spread(load("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    pages = orders.select(
        F.lit("orders").alias("job_id"),
        F.col("o_orderkey").alias("page_rank"),
        F.concat(F.lit("https://shop.test/orders/"), key).alias("url"),
        key_value_page(F.concat(F.lit("Order "), key), pairs).alias("html"),
    )
    found = extract_candidates(page_text(pages), ORDERS)
    return accepted(validate_records(found, ORDERS)).select(*ORDERS.headers)


@query(
    """
    SELECT o_orderkey, o_totalprice AS price, CAST(o_orderkey AS BIGINT) * 1000 AS units, CAST(round_even(o_orderkey + 0.5, 0) AS BIGINT) AS halves,
      strftime(o_orderdate, '%Y-%m-%d') AS d_iso, strftime(o_orderdate, '%Y-%m-%d') AS d_short, strftime(o_orderdate, '%Y-%m-%d') AS d_us, strftime(o_orderdate, '%Y-%m-%d') AS d_long,
      CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d_slash,
      strftime(o_orderdate, '%Y') || '-01-01' AS d_year, strftime(o_orderdate, '%Y') AS d_loose, o_orderstatus = 'F' AS final,
      'x' || o_orderkey || '/y' AS listed, 'urgent order' AS note, 'buyer' || o_custkey || '@shop.test' AS mail,
      'https://shop.test/o/' || o_orderkey AS link
    FROM orders
    """
)
def coerce_types(spark, load):
    """Values wrapped in prose, coerced to every type."""
    d = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    # The driver's prices need no rounding, so their plain text is exact.
    cells = {
        ("price", "number"): F.concat(F.lit("total $"), F.format_number("o_totalprice", 2), F.lit(" net")),
        ("units", "integer"): F.concat(F.lit("about "), F.format_number(key * 1000, 0), F.lit(" units")),
        ("halves", "integer"): F.concat(key.cast("string"), F.lit(".5")),
        ("d_iso", "date"): F.date_format(d, "yyyy-M-d"),
        ("d_short", "date"): F.lower(F.date_format(d, "d  MMM yyyy")),
        ("d_us", "date"): F.date_format(d, "MMM d, yyyy"),
        ("d_long", "date"): F.date_format(d, "MMMM dd, yyyy"),
        ("d_slash", "date"): F.date_format(d, "M/d/yyyy"),
        ("d_year", "date"): F.date_format(d, "yyyy"),
        ("d_loose", "date"): F.concat(F.lit("since "), F.date_format(d, "d MMMM yyyy"), F.lit(" or so")),
        ("final", "boolean"): F.when(F.col("o_orderstatus") == "F", " Verified ").otherwise("No"),
        ("listed", "array"): F.concat(F.lit('["x'), key.cast("string"), F.lit('", " y "]')),
        ("note", "string"): F.lit(" [urgent](https://x.test/a)\n order "),
        ("mail", "email"): F.concat(F.lit("mail: Buyer"), F.col("o_custkey").cast("string"), F.lit("@Shop.TEST now")),
        ("link", "url"): F.concat(F.lit("see https://shop.test/o/"), key.cast("string"), F.lit(".")),
    }
    orders = spread(load("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"), "o_orderkey")
    raw = orders.select("o_orderkey", *[text.alias(n) for (n, _), text in cells.items()])
    typed = raw.select("o_orderkey", *[F.expr(coerce(FieldSpec(n, t), n)).alias(n) for n, t in cells])
    return typed.withColumn("listed", F.array_join("listed", "/"))


_CUSTOMER_SPEC = RecordSpec.of([("company_name", "string", True), ("email", "email", True), ("website", "url"), ("url", "url", True)])


def customer_candidates(load):
    """Candidates with gaps: blank names, placeholder and missing e-mails, no url."""
    key = F.col("c_custkey").cast("string")
    k = F.col("c_custkey")
    raw = F.create_map(
        F.lit("Company Name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("Best Supplier of Things "), key)).otherwise(F.concat(F.lit("Customer "), key)),
        F.lit("email"),
        F.when(k % 7 == 0, F.concat(F.lit("test@c"), key, F.lit(".test")))
        .when(k % 7 == 1, "none")
        .when(k % 7 == 2, F.concat(F.lit("c"), key, F.lit("@gmail.com")))
        .otherwise(F.concat(F.lit("info@firm"), key, F.lit(".test"))),
        F.lit("WEBSITE"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("www.site"), key, F.lit(".test/x"))),
        F.lit("url"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://u"), key, F.lit(".test"))),
    )
    rows = spread(load("customer").select("c_custkey", "c_nationkey"), "c_custkey").select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("job_id"),
        F.concat(F.lit("https://www.linkedin.com/company/"), key).alias("url"),
        k.alias("page_rank"),
        F.lit(0).alias("cand_idx"),
        raw.alias("raw"),
    )
    return candidates_from_maps(rows, _CUSTOMER_SPEC)


_VALID_SQL = """
    WITH base AS (SELECT c_custkey AS k, c_nationkey,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'Best Supplier of Things ' || c_custkey ELSE 'Customer ' || c_custkey END AS given,
        CASE WHEN c_custkey % 7 IN (0, 1) THEN NULL WHEN c_custkey % 7 = 2 THEN 'c' || c_custkey || '@gmail.com' ELSE 'info@firm' || c_custkey || '.test' END AS email,
        CASE WHEN c_custkey % 3 <> 0 THEN 'https://www.site' || c_custkey || '.test/x' END AS site,
        CASE WHEN c_custkey % 11 <> 0 THEN 'https://u' || c_custkey || '.test' END AS u FROM customer),
    page AS (SELECT *, 'https://www.linkedin.com/company/' || k AS page_url FROM base),
    filled AS (SELECT *, coalesce(site, page_url) AS website, coalesce(u, page_url) AS url_value FROM page),
    named AS (SELECT *, CASE WHEN k % 5 IN (0, 1) THEN
          CASE WHEN k % 7 >= 3 THEN 'Firm' || k WHEN k % 3 <> 0 THEN 'Site' || k END END AS derived FROM filled),
    checked AS (SELECT *, coalesce(derived, given) AS company_name,
        list_filter([CASE WHEN given IS NULL AND derived IS NULL THEN 'company_name: missing' END,
          CASE WHEN email IS NULL THEN 'email: missing' END, CASE WHEN u IS NULL THEN 'url: missing' END], lambda e: e IS NOT NULL) AS errors FROM named)
"""


@query(_VALID_SQL + "SELECT k AS page_rank, company_name, email, website, url_value, array_to_string(errors, '; ') AS errors FROM checked")
def validate_split(spark, load):
    """Every candidate with its values and errors."""
    valid = validate_records(customer_candidates(load), _CUSTOMER_SPEC)
    return valid.select(
        "page_rank", "company_name", "email", "website", F.col("url").alias("url_value"), F.array_join("errors", "; ").alias("errors")
    )


@query(
    _VALID_SQL
    + """SELECT 'nation-' || c_nationkey AS job_id, unnest(errors) AS error, count(*) AS n FROM checked GROUP BY 1, 2"""
)
def reject_reasons(spark, load):
    """Rejected candidates by reason."""
    bad = rejected(validate_records(customer_candidates(load), _CUSTOMER_SPEC))
    return bad.select("job_id", F.explode("errors").alias("error")).groupBy("job_id", "error").agg(F.count(F.lit(1)).alias("n"))


_ENTITY_SPEC = RecordSpec.of([("company_name", "string", True), ("email", "email", True), ("website", "url"), ("balance", "number")])


def supplier_candidates(load):
    """Suppliers seen three times: as is, with changed case and title, on another site."""
    key = F.col("s_suppkey").cast("string")
    suppliers = spread(load("supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey")
    copies = suppliers.select("s_suppkey", "s_nationkey", "s_acctbal", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("copy"))
    name = F.when(F.col("copy") == 1, F.concat(F.lit("SUPPLIER "), key, F.lit(" Ltd"))).otherwise(F.concat(F.lit("Supplier "), key))
    email = F.when(
        F.col("s_suppkey") % 10 == 0, F.lit("")
    ).otherwise(F.concat(F.when(F.col("copy") == 1, "Sales@S").otherwise("sales@s"), key, F.lit(".test")))
    site = F.when(F.col("copy") == 2, F.concat(F.lit("https://mirror.test/"), key)).otherwise(F.concat(F.lit("https://www.s"), key, F.lit(".test/")))
    return load_ranked(
        copies.select(
            F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("job_id"),
            site.alias("url"),
            (F.col("s_suppkey") * 3 + F.col("copy")).alias("page_rank"),
            F.create_map(
                F.lit("company_name"), name, F.lit("email"), email, F.lit("website"), site,
                F.lit("balance"), F.col("s_acctbal").cast("string"),
            ).alias("raw"),
        )
    )


def load_ranked(rows):
    return candidates_from_maps(rows.withColumn("cand_idx", F.lit(0)), _ENTITY_SPEC)


_ENTITY_SQL = """
    WITH copies AS (SELECT s_suppkey AS k, s_nationkey, s_acctbal, unnest([0, 1, 2]) AS copy FROM supplier),
    cand AS (SELECT *, 'nation-' || s_nationkey AS job_id, k * 3 + copy AS page_rank, k % 10 = 0 AS bad,
        CASE copy WHEN 1 THEN 'SUPPLIER ' || k || ' Ltd' ELSE 'Supplier ' || k END AS company_name, 'sales@s' || k || '.test' AS email,
        CASE copy WHEN 2 THEN 'https://mirror.test/' || k ELSE 'https://www.s' || k || '.test/' END AS website FROM copies),
    firsts AS (SELECT * FROM cand WHERE NOT bad
        QUALIFY row_number() OVER (PARTITION BY job_id, k, copy = 2 ORDER BY page_rank) = 1)
"""


@query(_ENTITY_SQL + "SELECT job_id, page_rank, company_name, email, website, s_acctbal AS balance FROM firsts")
def entity_dedupe(spark, load):
    """First record per entity: own-domain copies collapse, the mirror stays."""
    records = dedupe_records(accepted(validate_records(supplier_candidates(load), _ENTITY_SPEC)), _ENTITY_SPEC)
    return records.select("job_id", "page_rank", *_ENTITY_SPEC.headers)


@query(
    _ENTITY_SQL
    + """, a AS (SELECT job_id, count(*) AS candidates, count(*) FILTER (bad) AS invalid FROM cand GROUP BY 1),
    b AS (SELECT job_id, count(*) AS valid FROM firsts GROUP BY 1)
    SELECT job_id, candidates, coalesce(valid, 0) AS valid, invalid, candidates - coalesce(valid, 0) - invalid AS duplicates,
      coalesce(round(valid / (valid + invalid), 4), 0) AS validity_ratio,
      CASE WHEN coalesce(round(valid / (valid + invalid), 4), 0) < 0.9
        THEN 'validity ratio ' || CAST(CAST(round(coalesce(round(valid / (valid + invalid), 4), 0) * 100) AS INTEGER) AS VARCHAR) || '% below 90% target' END AS note
    FROM a LEFT JOIN b USING (job_id)"""
)
def quality_report(spark, load):
    """Counters, validity ratio and note per job."""
    validated = validate_records(supplier_candidates(load), _ENTITY_SPEC)
    return quality_note(run_stats(validated, _ENTITY_SPEC))


@query(
    """
    SELECT 'nation-' || n_nationkey AS job_id, count(*) AS candidates, count(*) AS valid,
      CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS duplicates, CAST(1.0 AS DOUBLE) AS validity_ratio
    FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
    """
)
def validity_report(spark, load):
    """Flagship: HTML directory pages to records, with counters per job."""
    validated = validate_records(extract_candidates(page_text(supplier_pages(load)), SUPPLIERS), SUPPLIERS)
    return run_stats(validated, SUPPLIERS)


@query(
    """
    SELECT 'segment-' || c_mktsegment AS job_id, c_custkey AS page_rank, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS record_no
    FROM customer QUALIFY record_no <= CASE c_mktsegment WHEN 'BUILDING' THEN 5 WHEN 'MACHINERY' THEN 2500 ELSE 1000000000 END
    """
)
def record_target(spark, load):
    """Records up to each job's target, in order; all of a job without one."""
    records = load("customer").select(
        F.concat(F.lit("segment-"), F.col("c_mktsegment")).alias("job_id"), F.col("c_custkey").alias("page_rank"), F.lit(0).alias("cand_idx")
    )
    target = F.when(F.col("job_id") == "segment-BUILDING", 5).when(F.col("job_id") == "segment-MACHINERY", 2500)
    jobs = records.select("job_id").distinct().withColumn("max_records", target)
    return limit_records(records, jobs).select("job_id", "page_rank", F.col("record_no").cast("long").alias("record_no"))


LEADS = RecordSpec.of([("Company Name", "string", True), ("email", "email", True), ("website", "url")])


def site_pages(load):
    """Company sites: a third name an e-mail at home, a third on /contact, a third nowhere."""
    key = F.col("s_suppkey").cast("string")
    site = F.concat(F.lit("https://s"), key, F.lit(".test"))
    text = F.concat(F.lit("<title>Supplier "), key, F.lit("</title><p>write to webmaster@host.test or sales@s"), key, F.lit(".test</p>"))
    plain = F.concat(F.lit("<title>Supplier "), key, F.lit("</title><p>no address here</p>"))
    home = F.struct(site.alias("url"), F.when(F.col("s_suppkey") % 3 == 0, text).otherwise(plain).alias("html"))
    contact = F.struct(
        F.concat(site, F.lit("/contact")).alias("url"), F.when(F.col("s_suppkey") % 3 == 1, text).otherwise(plain).alias("html")
    )
    return spread(load("supplier").select("s_suppkey"), "s_suppkey").select(F.inline(F.array(home, contact)))


def listing_pages(load):
    cells = supplier_cells()
    cells["Website"] = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".test"))
    return supplier_pages(load, {k: cells[k] for k in ("Company Name", "Website")})


@query(
    """
    WITH leads AS (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS no
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT 'nation-' || n_nationkey AS job_id, 'Supplier ' || s_suppkey AS company_name, 'sales@s' || s_suppkey || '.test' AS email,
      'https://s' || s_suppkey || '.test' AS website FROM leads WHERE s_suppkey % 3 < 2
    """
)
def lead_backfill(spark, load):
    """Listings without e-mails, completed from the companies' own pages."""
    seen = materialise(extract_candidates(page_text(listing_pages(load)), LEADS, with_pages=True), "listing")
    found, visited = split_pages(seen)
    counts = dedupe_records(accepted(validate_records(found, LEADS)), LEADS).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_records"))
    leads = materialise(open_leads(collect_leads(found, LEADS), visited, record_counts=counts), "leads")
    visits = corpus_by_url(site_pages(load), lead_pages(leads))
    contacts = page_contacts(page_text(visits, url="canonical"), url="canonical")
    completed = validate_records(backfill_candidates(leads, contacts, LEADS), LEADS)
    return dedupe_records(accepted(completed), LEADS).select("job_id", *LEADS.headers)


@query(
    """
    WITH mails AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}') AS m FROM documents),
    rows AS (SELECT doc_id, unnest(range(len(m))) AS pos, unnest(m) AS email FROM mails),
    parts AS (SELECT *, split_part(email, '@', 2) AS domain FROM rows),
    ranked AS (SELECT *, CASE WHEN regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) = 'example.com' AND doc_id % 2 = 0 THEN 0
        WHEN domain IN ('gmail.com', 'yahoo.com') THEN 2 ELSE 1 END AS cls FROM parts
        WHERE domain NOT IN ('example.com', 'example.org', 'example.net', 'test.com') AND split_part(email, '@', 1) NOT IN ('test', 'user', 'name', 'email'))
    SELECT doc_id, email FROM ranked QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cls, pos) = 1
    """
)
def email_preference(spark, load):
    """Preferred address of every document that has one."""
    host = F.when(F.col("doc_id") % 2 == 0, "www.example.com").otherwise("other.test")
    best = load("documents").withColumn("host", host).select("doc_id", F.expr(preferred_email("text", "host")).alias("email"))
    return best.filter(F.col("email").isNotNull())


def _harvest(load, spark):
    """Jobs per nation over rendered listings and company sites."""
    listing = listing_pages(load)
    results = listing.select(
        "job_id",
        F.col("page_rank").alias("rank"),
        F.lit("Supplier company directory").alias("title"),
        "url",
        F.lit("list of wholesale partners").alias("snippet"),
        F.lit("cli").alias("engine"),
        F.lit("q").alias("query"),
    )
    jobs = load("nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("job_id"),
        F.lit("Find supplier companies with wholesale contact partners").alias("intent"),
        F.when(F.col("n_nationkey") % 2 == 0, 2).cast("int").alias("max_records"),
    )
    pages = listing.select("url", "html").unionByName(site_pages(load))
    return run_harvest(LEADS, jobs, results, pages)


_HARVEST_SQL = """
    WITH leads AS (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey // 100, s_suppkey) AS no
      FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    hits AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY no) AS record_no FROM leads WHERE s_suppkey % 3 < 2),
    kept AS (SELECT * FROM hits WHERE record_no <= CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1000000000 END)
"""


@query(
    _HARVEST_SQL
    + """SELECT 'nation-' || n_nationkey AS job_id, record_no, 'Supplier ' || s_suppkey AS company_name, 'sales@s' || s_suppkey || '.test' AS email,
      'https://s' || s_suppkey || '.test' AS website FROM kept"""
)
def harvest_records(spark, load):
    """The whole job: results, frontier, pages, extraction, second wave, target."""
    harvest = _harvest(load, spark)
    return harvest.records.select("job_id", F.col("record_no").cast("long").alias("record_no"), *LEADS.headers)


@query(
    _HARVEST_SQL
    + """, n AS (SELECT n_nationkey, count(*) AS exported FROM kept GROUP BY 1),
    f AS (SELECT n_nationkey, count(DISTINCT s_suppkey // 100) AS queued FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT 'nation-' || nation.n_nationkey AS job_id, coalesce(queued, 0) AS pages_queued, coalesce(exported, 0) AS records_exported,
      CASE WHEN coalesce(exported, 0) = 0 THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN queued IS NULL THEN 'no source pages' WHEN coalesce(exported, 0) = 0 THEN 'no valid records' END AS error
    FROM nation LEFT JOIN f USING (n_nationkey) LEFT JOIN n USING (n_nationkey)"""
)
def harvest_summary(spark, load):
    """Summary row of every job, failed ones included."""
    summary = _harvest(load, spark).summary
    error = F.when(F.col("error") == NO_RECORDS, "no valid records").otherwise(F.col("error"))
    return summary.select("job_id", "pages_queued", "records_exported", "status", error.alias("error"))
