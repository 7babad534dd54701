"""Page corpora rendered from relational tables.

The test tables hold no directory pages, so pages are rendered from them; the
rows that went in are what extraction has to give back.  Work grows with the
tables, and one page holds a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_PAGE = 100


def _tag(name: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>"))


def _page(title: Column, body: Column) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"),
        title,
        F.lit("</title><style>td{margin:0}</style></head><body><nav><a href=\"/\">Start</a></nav>"),
        body,
        F.lit("<footer>generated page</footer></body></html>"),
    )


def directory_pages(rows: DataFrame, *, group: Column, order: str, cells: dict[str, Column], job: Column, host: Column) -> DataFrame:
    """Pages with one table of at most ``ROWS_PER_PAGE`` rows each.

    Rows go to the page of their (group, ``order`` div 100), so a page is bounded
    however large a group is.
    """
    line = F.concat(F.lit("<tr>"), *[_tag("td", c) for c in cells.values()], F.lit("</tr>"))
    keyed = rows.select(
        job.alias("job_id"),
        group.alias("grp"),
        host.alias("host"),
        F.floor(F.col(order) / ROWS_PER_PAGE).alias("chunk"),
        F.struct(F.col(order).alias("at"), line.alias("line")).alias("row"),
    )
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in cells) + "</tr>"
    pages = keyed.groupBy("job_id", "grp", "host", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    table = F.concat(F.lit(f"<table>{head}"), F.array_join(F.transform("rows", lambda r: r["line"]), ""), F.lit("</table>"))
    return pages.select(
        "job_id",
        F.col("chunk").cast("long").alias("page_rank"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/list/"), F.col("chunk").cast("string")).alias("url"),
        _page(F.concat(F.lit("Directory of "), F.col("grp")), F.concat(F.lit("<h1>Members</h1>"), table)).alias("html"),
    )


def key_value_page(title: Column, pairs: dict[str, Column]) -> Column:
    """HTML of a profile page with one ``Key: value`` paragraph per pair."""
    lines = [F.concat(F.lit(f"<p>{k}: "), v, F.lit("</p>")) for k, v in pairs.items()]
    return _page(title, F.concat(_tag("h1", title), *lines))
