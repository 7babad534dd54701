"""Page text queries over the raw pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import ERROR_TITLE, SKIP_TAGS
from ..functions.headings import first_heading, name_heading
from ..functions.contacts import emails
from ..functions.names import best_name, is_org_name, trim_separator
from ..operators.page_text import extractor_input, page_links, page_tables, page_text
from ..sources.corpora import directory_pages
from .registry import query

# Expected results: the same text rules, one regular expression per element,
# which is exact for these well-formed pages.
_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), "
    "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?is)<![^>]*>', '', 'g')"
)
for _tag in SKIP_TAGS[2:]:
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}(\\s[^>]*)?>.*?(</{_tag}\\s*>|$)', '', 'g')"


def _entities(text: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        # The semicolon may be missing: some titles are cut inside a reference.
        text = f"replace(replace({text}, '&{name};', '{char}'), '&{name}', '{char}')"
    return text


_RENDER = [
    ("(?is)<title[^>]*>.*?</title>", ""),
    ("(?i)<h1[^>]*>", "\n\n# "),
    ("(?i)</h1>", "\n\n"),
    ("(?i)</?p(\\s[^>]*)?>", "\n\n"),
    ("(?i)<br[^>]*>", "\n"),
    ("(?i)</?b>", "**"),
    ("<[^>]*>", ""),
]
_MARKDOWN = "kept"
for _pattern, _by in _RENDER:
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '{_pattern}', '{_by}', 'g')"
_MARKDOWN = _entities(_entities(_MARKDOWN))
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_MARKDOWN = f"trim(regexp_replace(regexp_replace({_MARKDOWN}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS})"
_TITLE_SQL = f"trim({_entities('''regexp_extract(kept, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, {_WS})"
TEXT_SQL = f"""
    WITH kept_pages AS (SELECT page_id, url, {_VISIBLE} AS kept FROM pages),
    text_pages AS (SELECT page_id, url, {_TITLE_SQL} AS title, {_MARKDOWN} AS markdown FROM kept_pages)
"""
_FIRST_LINE = "trim(split_part(markdown, chr(10), 1))"


def _heading_sql(levels: str) -> str:
    return f"nullif(trim(regexp_extract(markdown, '(?m)^#{{{levels}}}\\s+(.+)$', 1)), '')"


def _text(load):
    return page_text(load("pages").select("page_id", "url", "html"))


@query(TEXT_SQL + "SELECT page_id, url, markdown FROM text_pages")
def page_body_text(spark, load):
    """Markdown of every page."""
    return _text(load).select("page_id", "url", "markdown")


@query(TEXT_SQL + f"SELECT page_id, coalesce(nullif(title, ''), {_heading_sql('1,3')}, {_FIRST_LINE}) AS title FROM text_pages")
def page_titles(spark, load):
    return _text(load).select("page_id", "title")


@query(
    TEXT_SQL
    + f"SELECT page_id, coalesce({_heading_sql('1,3')}, {_FIRST_LINE}) AS heading, {_heading_sql('1,2')} AS name_heading FROM text_pages"
)
def page_headings(spark, load):
    text = _text(load)
    return text.select(
        "page_id",
        F.expr(first_heading("markdown")).alias("heading"),
        F.expr(name_heading("markdown")).alias("name_heading"),
    )


@query(
    TEXT_SQL
    + """SELECT page_id, CAST(unnest(range(0, greatest(length(markdown) - 1, 0) // 1500 + 1)) + 1 AS INTEGER) AS chunk_no,
      substr(markdown, unnest(range(0, greatest(length(markdown) - 1, 0) // 1500 + 1)) * 1500 + 1, 1500) AS extractor_input,
      length(markdown) AS n_chars FROM text_pages"""
)
def extractor_inputs(spark, load):
    """Whole pages in numbered pieces for an outside extractor."""
    pieces = extractor_input(_text(load), 1500)
    return pieces.select("page_id", "chunk_no", "extractor_input", F.length("markdown").cast("long").alias("n_chars"))


def _linked(load):
    """Pages whose navigation list counts as content, so that links remain."""
    return load("pages").select(
        "page_id", "url", F.regexp_replace("html", "(?i)(</?)nav>", "$1section>").alias("html")
    )


@query(
    """
    WITH raw AS (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS found FROM pages),
    rows AS (SELECT page_id, url, unnest(range(len(found))) AS pos, unnest(found) AS a FROM raw)
    SELECT page_id, url, pos, trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')) AS "text",
           regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(a, 'href="([^"]*)"', 1) AS href
    FROM rows
    """
)
def page_anchor_links(spark, load):
    """Label and absolute target of every link."""
    return page_links(_linked(load)).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "text", "href")


def supplier_cells():
    key = F.col("s_suppkey").cast("string")
    return {
        "Company Name": F.concat(F.lit("Supplier "), key),
        "Email": F.concat(F.lit("sales@s"), key, F.lit(".test")),
        "Website": F.concat(F.lit("https://s"), key, F.lit(".test/")),
        "Balance": F.concat(F.lit("$"), F.format_number("s_acctbal", 2)),
    }


def supplier_pages(load, cells=None):
    """Directory pages of the suppliers, one set per nation."""
    rows = load("supplier").join(load("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return directory_pages(
        rows,
        group=F.col("n_name"),
        order="s_suppkey",
        cells=cells or supplier_cells(),
        job=F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")),
        host=F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".listing.test")),
    )


@query(
    """
    WITH rows AS (
      SELECT 'nation-' || n_nationkey AS job_id, s_suppkey // 100 AS page_rank, s_suppkey, s_acctbal,
             row_number() OVER (PARTITION BY n_nationkey, s_suppkey // 100 ORDER BY s_suppkey) AS row_idx
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT job_id, page_rank, row_idx, 'Supplier ' || s_suppkey AS company, 'sales@s' || s_suppkey || '.test' AS email,
           '$' || format('{:,.2f}', s_acctbal) AS balance
    FROM rows
    """
)
def page_table_cells(spark, load):
    """Cells of every table row of rendered directory pages."""
    rows = page_tables(supplier_pages(load)).filter("row_idx > 0")
    return rows.select(
        "job_id",
        "page_rank",
        F.col("row_idx").cast("long").alias("row_idx"),
        F.col("cells")[0].alias("company"),
        F.col("cells")[1].alias("email"),
        F.col("cells")[3].alias("balance"),
    )




REJECTS_SQL = (
    TEXT_SQL
    + """, rewritten AS (
      SELECT page_id, url, CASE page_id % 10 WHEN 0 THEN 'Access Denied' WHEN 1 THEN '404 Not Found'
             WHEN 2 THEN 'Just a moment...' WHEN 4 THEN '' ELSE title END AS title, page_id % 10 = 4 AS bare FROM text_pages)
    SELECT page_id, CASE WHEN bare THEN 'no extractable content: ' || url
           ELSE 'error page (' || title || ')' END AS reason
    FROM rewritten WHERE bare OR regexp_matches(title, '"""
    + ERROR_TITLE
    + "')"
)


def spoiled_pages(pages):
    """The raw pages, some with titles of error pages, some without content."""
    title = (
        F.when(F.col("page_id") % 10 == 0, "Access Denied")
        .when(F.col("page_id") % 10 == 1, "404 Not Found")
        .when(F.col("page_id") % 10 == 2, "Just a moment...")
    )
    retitled = F.regexp_replace("html", F.lit("(?is)<title>.*?</title>"), F.concat(F.lit("<title>"), title, F.lit("</title>")))
    html = F.when(F.col("page_id") % 10 == 4, "<html><nav>menu</nav></html>").when(title.isNotNull(), retitled).otherwise(F.col("html"))
    return pages.select("page_id", "url", html.alias("html"))


@query(REJECTS_SQL)
def page_rejects(spark, load):
    """Pages that yield nothing: titles of error pages, bodies without content."""
    text = page_text(spoiled_pages(load("pages")))
    return text.filter(F.col("reject").isNotNull()).select("page_id", F.col("reject").alias("reason"))


# Organisation names: one alternation per rule.
_GATE = r"""
    length({0}) BETWEEN 1 AND 60
    AND NOT regexp_matches({0}, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}\x{{FE0F}}]')
    AND NOT ends_with({0}, '!') AND NOT contains({0}, '?')
    AND NOT regexp_matches({0}, '[\x{{0400}}-\x{{04FF}}\x{{0600}}-\x{{06FF}}\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]')
    AND len(string_split_regex({0}, '\s+')) <= 6
    AND NOT (regexp_matches({0}, '(?i)^(?:best|leading|top|trusted|award[- ]winning|your|get|find|we are|about|list of|search|discover|why|how|what)\b')
             AND len(string_split_regex({0}, '\s+')) > 2)
    AND NOT regexp_matches({0}, '(?i)\b(?:leading|trusted|award[- ]winning|premium|fastest|growing)\.?$')
    AND NOT regexp_matches(' ' || lower({0}) || ' ', ' for all | your digital | needs | we help | the emerging | of india|,india| in nagpur')
"""


@query(
    TEXT_SQL
    + f""", named AS (SELECT page_id, url, title, coalesce({_heading_sql('1,2')}, '') AS heading FROM text_pages),
    cleaned AS (
      SELECT page_id, trim(regexp_replace(title, '\\s*[|\\-–—·•]\\s*$', '')) AS t,
             trim(regexp_replace(heading, '\\s*[|\\-–—·•]\\s*$', '')) AS h,
             regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host
      FROM named)
    SELECT page_id, {_GATE.format('t')} AS title_is_name,
      CASE WHEN {_GATE.format('t')} THEN t WHEN {_GATE.format('h')} THEN h
           WHEN contains(host, '.') AND length(split_part(host, '.', 1)) >= 3 AND NOT regexp_matches(split_part(host, '.', 1), '^[0-9]+$')
           THEN upper(left(split_part(host, '.', 1), 1)) || substr(split_part(host, '.', 1), 2) END AS best_name
    FROM cleaned
    """
)
def page_names(spark, load):
    """Best entity name of every page: title, heading or host."""
    text = _text(load).withColumn("title", F.coalesce("title", F.lit("")))
    heading = f"coalesce({name_heading('markdown')}, '')"
    return text.select(
        "page_id",
        F.expr(is_org_name(trim_separator("title"))).alias("title_is_name"),
        F.expr(best_name("title", heading, "url")).alias("best_name"),
    )


@query(
    """
    WITH found AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS mails FROM documents)
    SELECT doc_id, unnest(range(len(mails))) AS pos, lower(unnest(mails)) AS email FROM found
    """
)
def email_scan(spark, load):
    """Every e-mail address in every document, in order."""
    found = load("documents").select("doc_id", F.posexplode_outer(F.expr(emails("text"))).alias("pos", "email"))
    return found.filter(F.col("email").isNotNull()).select("doc_id", F.col("pos").cast("long").alias("pos"), "email")
