"""Page corpus to page text: Markdown, title, links and table rows.

Everything here is a narrow projection: no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.headings import first_heading
from ..functions.html import anchors, drop_boilerplate, page_title, table_rows, to_markdown
from ..functions.names import is_error_title
from ..functions.text import WHITE, blank_to_null, replace, strip
from ..plans.stages import fence


def clean_pages(pages: DataFrame, *, html: str = "html", banner_scope: str = "element") -> DataFrame:
    """Replace the page body by its ``kept`` part, boilerplate removed."""
    if banner_scope not in ("element", "rest"):
        raise ValueError("banner_scope is 'element' or 'rest'")
    return pages.withColumn("kept", F.expr(drop_boilerplate(f"coalesce(`{html}`, '')", banner_scope)))


def page_text(
    pages: DataFrame,
    *,
    url: str = "url",
    html: str = "html",
    content_type: str | None = None,
    banner_scope: str = "element",
) -> DataFrame:
    """Add ``markdown``, ``title`` and ``reject`` and drop the body.

    ``reject`` is null for a usable page, else the reason it yields nothing: an
    empty page or an error page.  Bodies that are not HTML pass through trimmed.
    """
    body = f"coalesce(`{html}`, '')"
    marked_up = f"contains({body}, '<')"
    if content_type is not None:
        marked_up = f"(coalesce(contains(`{content_type}`, 'html'), false) OR {marked_up})"
    keep = [c for c in pages.columns if c != html]
    cleaned = clean_pages(pages.withColumn("__html", F.expr(marked_up)), html=html, banner_scope=banner_scope)
    # A page the renderer cannot read gives its bare text.
    bare = replace(replace("__raw", "<[^>]+>", " "), WHITE + "+", " ")
    rendered = cleaned.withColumn("__raw", F.expr(body)).select(
        *keep,
        F.expr(f"CASE WHEN __html THEN {page_title('kept')} ELSE '' END").alias("__title"),
        F.expr(
            f"CASE WHEN __html THEN coalesce({to_markdown('kept', f'`{url}`')}, {bare}) ELSE {strip('__raw')} END"
        ).alias("markdown"),
    )
    titled = rendered.select(
        *keep,
        "markdown",
        F.expr(f"coalesce({blank_to_null('__title')}, {first_heading('markdown')})").alias("title"),
    )
    judged = titled.withColumn(
        "reject",
        F.expr(
            f"CASE WHEN markdown = '' THEN concat('no extractable content: ', `{url}`) "
            f"WHEN {is_error_title('title')} THEN concat('error page (', title, ')') END"
        ),
    )
    return fence(judged)


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One row per link outside boilerplate: position, label and absolute target."""
    keep = [c for c in pages.columns if c != html]
    found = clean_pages(pages, html=html).select(*keep, F.expr(anchors("kept", f"`{url}`")).alias("__links"))
    rows = found.select(*keep, F.posexplode_outer("__links").alias("pos", "__link"))
    return rows.filter(F.col("__link").isNotNull()).select(*keep, "pos", "__link.text", "__link.href")


def page_tables(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """One row per table row: ``table_idx``, ``row_idx`` and ``cells``."""
    keep = [c for c in pages.columns if c != html]
    found = clean_pages(pages, html=html).select(*keep, F.expr(table_rows("kept")).alias("__tables"))
    tables = found.select(*keep, F.posexplode_outer("__tables").alias("table_idx", "__rows"))
    rows = tables.select(*keep, "table_idx", F.posexplode_outer("__rows").alias("row_idx", "cells"))
    return rows.filter(F.col("cells").isNotNull())


def extractor_input(text: DataFrame, chunk_chars: int) -> DataFrame:
    """The whole page in pieces that an outside extractor takes: ``chunk_no`` from 1, ``extractor_input``."""
    starts = F.expr(f"sequence(0, greatest(length(markdown) - 1, 0) DIV {chunk_chars})")
    return text.withColumn("__chunk", F.explode(starts)).select(
        *text.columns,
        (F.col("__chunk") + 1).cast("int").alias("chunk_no"),
        F.expr(f"substring(markdown, CAST(__chunk * {chunk_chars} + 1 AS INT), {chunk_chars})").alias("extractor_input"),
    )
