"""Block lists of any size: which urls contain which patterns.

An alternation of all patterns does not carry a list of hundreds of thousands.  Here a
pattern waits at its rarest q-gram: urls and patterns meet in an equality join of grams,
and only those that met are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the substrings that urls and patterns meet at; shorter patterns meet whole.
GRAM = 5


def _grams(text: str, lengths: list[int]) -> str:
    """SQL of the distinct substrings of the given lengths."""
    parts = [
        f"IF(length({text}) < {n}, array(), transform(sequence(1, greatest(length({text}) - {n - 1}, 1)), i -> substr({text}, i, {n})))"
        for n in lengths
    ]
    return f"array_distinct(concat({', '.join(parts)}))"


def url_matches(urls: DataFrame, patterns: DataFrame, *, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """One row for each different url and pattern that it contains, case aside: ``url``, ``pattern``.

    Blank patterns match nothing.  How often a gram occurs is counted over all urls,
    among the grams of the patterns alone; a pattern with a gram that no url has is out.
    The driver reads the few lengths that patterns have.  Grams never pass through it:
    there are several to a pattern, which Spark's size estimates do not see, so both
    sides of their joins are dealt by gram.
    """
    listed = patterns.select(F.lower(F.trim(F.col(pattern))).alias("pattern")).filter("pattern <> ''").distinct()
    listed = listed.withColumn("size", F.least(F.length("pattern"), F.lit(GRAM)))
    lengths = sorted(r[0] for r in listed.select("size").distinct().collect())
    if not lengths:
        return urls.filter(F.lit(False)).select(F.col(url).alias("url"), F.lit("").alias("pattern"))
    low = urls.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct().withColumn("low", F.lower("url"))
    met = low.select("url", "low", F.explode(F.expr(_grams("low", lengths))).alias("gram"))
    own = F.explode(F.expr("array_distinct(transform(sequence(1, length(pattern) - size + 1), i -> substr(pattern, i, size)))"))
    held = listed.select("pattern", own.alias("gram"))
    asked = held.select("gram").distinct().hint("merge")
    frequent = met.select("gram").join(asked, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        held.join(frequent.hint("merge"), "gram", "left")
        .groupBy("pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("at"))
        .filter("at.n > 0")
        .select("pattern", F.col("at.gram").alias("gram"))
    )
    return met.join(rarest.hint("merge"), "gram").filter("contains(low, pattern)").select("url", "pattern")


def without_blocked(rows: DataFrame, patterns: DataFrame, *, url: str = "url", pattern: str = "pattern") -> DataFrame:
    """Rows whose url contains no pattern of the list; rows without a url stay."""
    hit = url_matches(rows, patterns, url=url, pattern=pattern).select(F.col("url").alias(url)).distinct()
    return rows.join(hit, url, "left_anti")
