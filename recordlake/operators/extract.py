"""Page text to candidate rows: tables, key-value lines, page defaults.

A narrow flat-map per page.  Cell text, page links and the page's own e-mail are
resolved while the page is at hand, so the Markdown never leaves this step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MARKDOWN_LINK, URL_IN_TEXT
from ..functions.contacts import EMAIL
from ..functions.headings import name_heading
from ..functions.names import best_name
from ..functions.text import LINE_BREAK, WHITE, compact, let, match, match_all, q, strip
from ..spec import FieldSpec, RecordSpec

# A header line, a rule line, lines without a pipe, then the rows.
_TABLE_BLOCK = (
    r"(?:^|\n)[^\n|]*+\|[^\n]*+"
    r"\n(?=[^\n]*\|)[^\S\n]*\|?[^\S\n]*:?-{3,}[^\n]*+"
    r"(?:\n[^|\n]*+(?=\n|\z))*+(?:\n[^\n|]*+\|[^\n]*+)++"
)
_KEY_VALUE = (
    rf"(?md)^{WHITE}*+(?:[-*]{WHITE}+)?\*\*([^*]{{1,60}})\*\*{WHITE}*[:：]{WHITE}*(.+)$",
    rf"(?md)^{WHITE}*+(?:[-*]{WHITE}+)?([A-Za-z][A-Za-z0-9 /&_+-]{{1,40}}){WHITE}*[:：]{WHITE}*(.+)$",
)


def _cells(line: str) -> str:
    return f"transform(split(btrim({strip(line)}, '|'), {q(chr(92) + '|')}, -1), c -> {strip('c')})"


def _link(text: str) -> str:
    """First page link whose label holds, or is held by, a text without a url."""
    hit = let(
        f"lower({strip(text)})",
        "low",
        "trim(TRAILING '.,;' FROM get(filter(__links, l -> contains(l.label, low) OR contains(low, l.label)), 0).href)",
    )
    return f"CASE WHEN {strip(text)} <> '' AND NOT {text} RLIKE {q(URL_IN_TEXT)} THEN {hit} END"


def _candidate(source: str, spec: RecordSpec, values: dict[str, str], with_links: bool = True) -> str:
    raw = ", ".join(f"'{f.name}', cast({values.get(f.name, 'NULL')} AS STRING)" for f in spec.fields)
    parts = [f"'source', '{source}'", f"'raw', named_struct({raw})"]
    urls = [f for f in spec.fields if f.type == "url"]
    if urls:
        links = ", ".join(
            f"'{f.name}', cast({_link(values[f.name]) if with_links and f.name in values else 'NULL'} AS STRING)"
            for f in urls
        )
        parts.append(f"'page_link', named_struct({links})")
    return f"named_struct({', '.join(parts)})"


def _default(field: FieldSpec, url: str) -> str | None:
    """Column that stands in for a field the page does not spell out."""
    if field.type == "email":
        return "__email"
    if field.type == "url":
        return f"`{url}`"
    return "__name" if field.is_name else None


def _any(columns: Sequence[str]) -> str:
    return " OR ".join(f"coalesce({c}, '') <> ''" for c in columns) or "false"


def extract_candidates(
    text: DataFrame,
    spec: RecordSpec,
    *,
    keys: Sequence[str] = ("job_id", "page_rank"),
    url: str = "url",
    with_pages: bool = False,
) -> DataFrame:
    """Candidate rows of every usable page.

    ``text`` is the output of ``page_text``; ``keys`` are carried along.  Result:
    keys, ``url``, ``cand_idx``, ``source`` (table, kv or bare), ``raw`` (one
    string per field), ``page_link`` (per url field) and ``may_fill`` (the page
    names its own url, so a missing url may be taken from it).

    With ``with_pages`` a page without candidates keeps one row whose
    ``cand_idx`` is null, and ``reject`` is kept, so that one pass over the pages
    gives both the candidates and the page log.
    """
    if with_pages:
        keys = [*keys, "reject"]
        usable = text.withColumn("markdown", F.when(F.col("reject").isNull(), F.col("markdown")))
    else:
        usable = text.filter(F.col("reject").isNull())
    targets = {f.name: q(f.compact) for f in spec.fields}

    lines = f"regexp_replace(markdown, {q(LINE_BREAK)}, {q(chr(10))})"
    block = F.expr(
        "CASE WHEN contains(markdown, '|') THEN "
        f"trim(LEADING {q(chr(10))} FROM {match(lines, _TABLE_BLOCK, 0)}) END"
    )
    entries = []
    for pattern in _KEY_VALUE:
        entries.append(
            f"zip_with({match_all('markdown', pattern, 1)}, {match_all('markdown', pattern, 2)}, (k, v) -> named_struct("
            f"'k', {compact(strip('k'))}, 'v', {strip('v')}))"
        )
    read = usable.select(
        *keys,
        url,
        (F.col("markdown").contains(F.col(url)) | (F.col("markdown") == "")).alias("may_fill"),
        F.split(F.nullif(block, F.lit("")), "\n").alias("__lines"),
        F.expr(f"concat({', '.join(entries)})").alias("__kv"),
        F.expr(_page_links("markdown")).alias("__links"),
        F.nullif(F.regexp_extract("markdown", EMAIL, 0), F.lit("")).alias("__email"),
        F.expr(
            best_name("coalesce(title, '')", f"coalesce({name_heading('markdown')}, '')", f"`{url}`")
        ).alias("__name"),
    )
    read = read.select(
        "*",
        F.expr(_cells("__lines[0]")).alias("__head"),
        F.expr(f"transform(filter(slice(__lines, 3, size(__lines)), r -> contains(r, '|')), r -> {_cells('r')})").alias(
            "__rows"
        ),
    )
    # Column of each field: the last one that carries the first matching header.
    columns, values = [], []
    for f in spec.fields:
        t = targets[f.name]
        fits = let(compact("h"), "n", f"n <> '' AND (contains({t}, n) OR contains(n, {t}))")
        columns.append(
            F.expr(
                let(
                    f"get(filter(__head, h -> {fits}), 0)",
                    "hit",
                    "size(__head) - array_position(reverse(__head), hit)",
                )
            ).alias(f"__c_{f.name}")
        )
        words = [w for w in f.name.split("_") if len(w) > 2]
        all_words = " AND ".join(f"contains(e.k, {q(w)})" for w in words) or "false"
        values.append(
            F.expr(
                let(
                    f"coalesce(get(filter(__kv, e -> contains(e.k, {t}) OR contains({t}, e.k)), 0).k, "
                    f"get(filter(__kv, e -> {all_words}), 0).k)",
                    "key",
                    "try_element_at(filter(__kv, e -> e.k = key), -1).v",
                )
            ).alias(f"__v_{f.name}")
        )
    mapped = read.select("*", *columns, *values)

    count = " + ".join(f"CASE WHEN __c_{f.name} IS NULL THEN 0 ELSE 1 END" for f in spec.fields)
    row = _candidate(
        "table", spec, {f.name: f"nullif(get(r, cast(__c_{f.name} AS INT)), '')" for f in spec.fields}
    )
    table = (
        f"CASE WHEN size(__rows) > 0 AND {count} >= {max(1, len(spec.fields) // 3)} "
        f"THEN transform(__rows, r -> {row}) END"
    )
    kv_values = {}
    for f in spec.fields:
        default = _default(f, url)
        kv_values[f.name] = f"coalesce(__v_{f.name}, {default})" if default else f"__v_{f.name}"
    bare_values = {f.name: d for f in spec.fields if (d := _default(f, url))}
    kv = f"CASE WHEN size(__kv) > 0 AND ({_any(list(kv_values.values()))}) THEN array({_candidate('kv', spec, kv_values)}) END"
    bare = (
        f"CASE WHEN {'reject IS NULL AND ' if with_pages else ''}({_any(list(bare_values.values()))}) "
        f"THEN array({_candidate('bare', spec, bare_values, with_links=False)}) END"
    )
    found = mapped.select(
        *keys, url, "may_fill", F.expr(table).alias("__table"), F.expr(kv).alias("__kvs"), F.expr(bare).alias("__bare")
    ).select(
        *keys,
        url,
        "may_fill",
        F.expr(
            "CASE WHEN __table IS NOT NULL AND __kvs IS NOT NULL THEN concat(__table, __kvs) "
            "ELSE coalesce(__table, __kvs, __bare) END"
        ).alias("__all"),
    )
    rows = found.select(*keys, url, "may_fill", F.posexplode_outer("__all").alias("cand_idx", "__c"))
    extra = ["__c.page_link"] if any(f.type == "url" for f in spec.fields) else []
    if not with_pages:
        rows = rows.filter(F.col("__c").isNotNull())
    return rows.select(
        *keys, url, "cand_idx", "__c.source", "__c.raw", *extra, "may_fill"
    )


def split_pages(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and page log of an extraction that kept its pages."""
    candidates = seen.filter(F.col("cand_idx").isNotNull()).drop("reject")
    first = F.coalesce(F.col("cand_idx"), F.lit(0)) == 0
    return candidates, seen.filter(first).select("job_id", "page_rank", "url", "reject")


def candidates_from_maps(
    rows: DataFrame, spec: RecordSpec, *, raw: str = "raw", source: str = "given"
) -> DataFrame:
    """Candidates supplied as ``MAP<STRING,STRING>`` with any spelling of the keys."""
    fields = [
        F.coalesce(
            F.try_element_at(F.col(raw), F.lit(f.name)),
            F.expr(
                f"get(filter(map_entries(`{raw}`), e -> {compact('e.key')} = {q(f.compact)}), 0).value"
            ),
        ).alias(f.name)
        for f in spec.fields
    ]
    keep = [c for c in rows.columns if c not in (raw, "source")]
    return rows.select(*keep, F.lit(source).alias("source"), F.struct(*fields).alias("raw"))


def _page_links(markdown: str) -> str:
    """Links of a page as ``array<struct<label, href>>``, labels in lower case."""
    return (
        f"transform({match_all(markdown, MARKDOWN_LINK)}, m -> named_struct("
        f"'label', lower({match('m', MARKDOWN_LINK, 1)}), 'href', {match('m', MARKDOWN_LINK, 2)}))"
    )


def attach_pages(
    given: DataFrame, text: DataFrame, spec: RecordSpec, *, url: str = "url", text_url: str = "url"
) -> DataFrame:
    """Give candidates from outside what extracted ones get from their page.

    Adds ``page_link`` (the page's link that goes with a url value that is only a
    label) and ``may_fill``.  The join carries links, not page text; a candidate
    without its page keeps neither.
    """
    context = text.filter(F.col("reject").isNull()).select(
        F.col(text_url).alias(url),
        (F.col("markdown").contains(F.col(text_url)) | (F.col("markdown") == "")).alias("may_fill"),
        F.expr(_page_links("markdown")).alias("__links"),
    )
    joined = given.drop("may_fill", "page_link").join(context, url, "left")
    urls = [f.name for f in spec.fields if f.type == "url"]
    links = [F.expr(f"cast({_link(f'raw.`{n}`')} AS STRING)").alias(n) for n in urls]
    out = joined.withColumn("page_link", F.struct(*links)) if urls else joined
    return out.withColumn("may_fill", F.coalesce("may_fill", F.lit(False))).drop("__links")


def prefer_given(heuristic: DataFrame, given: DataFrame, answered: DataFrame, page_keys: Sequence[str]) -> DataFrame:
    """Candidates supplied from outside replace the extracted ones page by page.

    ``answered`` names the pages that have an answer; an empty answer means the
    page has no records, a missing one leaves the page to the heuristics.
    """
    kept = heuristic.join(answered.select(*page_keys).distinct(), list(page_keys), "left_anti")
    return kept.unionByName(given, allowMissingColumns=True)
