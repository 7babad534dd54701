"""Line dedup by how many of a site's pages carry a line.

Contract of edge cases: a null text stays null and counts as a page without
lines; rows without a host are no site and keep all lines; blank lines are
neither counted nor dropped; a line counts once for a page however often it
stands there; repeated rows are pages of their own, or with ``copies_once`` all
pages of a host with one text are one page, and null texts none; a page whose lines
all go keeps its row with an empty text; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import materialise

_DIGEST = "unhex(md5(CAST(l AS BINARY)))"


def boilerplate_lines(
    docs: DataFrame, *, host: str, text: str, ratio: float, min_pages: int, copies_once: bool = False
) -> DataFrame:
    """One row per host: digests of the lines on more than ``ratio`` of its pages and on ``min_pages`` at least.

    A host has at most (mean lines of a page) / ratio of them, so a row stays small.
    """
    pages = docs.select(F.col(host).alias("__host"), F.col(text).alias("__text")).filter("__host IS NOT NULL")
    digests = F.expr(f"array_distinct(transform(filter(split(__text, '\n', -1), l -> trim(l) <> ''), l -> {_DIGEST}))")
    texts = pages.filter("__text IS NOT NULL").select("__host", "__text", digests.alias("__digests"))
    if copies_once:
        texts = texts.withColumn("__text", F.expr("unhex(md5(CAST(__text AS BINARY)))")).dropDuplicates(["__host", "__text"])
        pages = texts
    counts = (
        texts.select("__host", F.explode("__digests").alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__pages"))
        .filter(F.col("__pages") >= min_pages)
    )
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
    return (
        counts.join(totals, "__host")
        .filter(F.col("__pages") > F.lit(ratio) * F.col("__total"))
        .groupBy("__host")
        .agg(F.collect_list("__line").alias("__lines"))
    )


def line_dedup(
    docs: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.05,
    min_pages: int = 3,
    copies_once: bool = False,
) -> DataFrame:
    """Drop each site's boilerplate lines; adds n_lines and n_dropped (long).

    Only digests of lines are shuffled.  The boilerplate table is written first, so
    the join back is planned with its true size: it is sent to the pages while it is
    small, and otherwise the pages go to it, where a host with many pages is split.
    """
    boilerplate = materialise(
        boilerplate_lines(docs, host=host, text=text, ratio=ratio, min_pages=min_pages, copies_once=copies_once),
        "boilerplate",
    )
    keep = f"split(`{text}`, '\n', -1)"
    kept = f"filter({keep}, l -> trim(l) = '' OR NOT array_contains(__lines, {_DIGEST}))"
    joined = docs.join(boilerplate.withColumnRenamed("__host", "__site"), F.col(host) == F.col("__site"), "left")
    joined = joined.withColumn("__kept", F.expr(f"IF(__lines IS NULL, NULL, {kept})"))
    n_lines = F.expr(f"IF(`{text}` IS NULL, 0L, CAST(size({keep}) AS BIGINT))")
    dropped = F.expr(f"IF(__kept IS NULL, 0L, CAST(size({keep}) - size(__kept) AS BIGINT))")
    return (
        joined.withColumns({"n_lines": n_lines, "n_dropped": dropped})
        .withColumn(text, F.expr(f"IF(__kept IS NULL, `{text}`, array_join(__kept, '\n'))"))
        .drop("__site", "__lines", "__kept")
    )
