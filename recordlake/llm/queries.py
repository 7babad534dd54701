"""Registered queries of this package, each with the SQL of its result where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .chat import chat_examples, conversation_digests
from .jaccard import jaccard_groups
from .licenses import TEMPLATES, license_scan, needed, template_shingles, window_step, window_width
from .lines import line_dedup
from .merkle import folded, merkle_manifest, merkle_proofs, proof_bytes, row_digest, to_hex
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .pieces import piece_decode, piece_encode
from .quality import quality_rules
from .session import prepared
from .substrings import suffix_dedup
from .trie import numbered_turns, prefix_trie, with_shared_heads
from .wrappers import extract_main_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(table: str, sql: str | None = None):
    """Register a function of one whole table under its own name."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


LINE_RATIO, LINE_PAGES = 0.05, 3

#: Texts after line dedup, from any table ``docs`` with doc_id, source and text.
LINE_SQL = f"""
lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM docs),
boilerplate AS (
  SELECT l.source, l.line
  FROM (SELECT source, line, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL) l
  JOIN (SELECT source, count(*) AS total FROM docs GROUP BY source) t ON l.source = t.source
  WHERE pages >= {LINE_PAGES} AND pages > {LINE_RATIO} * total),
marked AS (
  SELECT lines.*, boilerplate.line IS NOT NULL AS dropped
  FROM lines LEFT JOIN boilerplate ON lines.source = boilerplate.source AND lines.line = boilerplate.line),
deduped AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text
  FROM marked GROUP BY doc_id)
"""


@query(
    "documents",
    f"WITH docs AS (SELECT doc_id, source, text FROM documents), {LINE_SQL} "
    "SELECT doc_id, n_lines, n_dropped, md5(text) AS text_md5 FROM deduped",
)
def op1_line_dedup(documents):
    """Documents without their sources' boilerplate lines."""
    out = line_dedup(documents, ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


@query("documents")
def op4_byte_bpe(documents):
    """Encode every text, decode it again; digests of both."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_decode(bpe_encode(documents, path), path)
    return out.select(
        "doc_id",
        F.expr("CAST(length(bpe.ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("bpe.ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("documents")
def op8_best_fit_packing(documents):
    """All documents in sequences of 1024 tokens."""
    ranks, library = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(documents, ranks, library, capacity=1024, end_id=2)


_ESC = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"


@query(
    "conversations",
    f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 14 + len(replace({_ESC.format("role")}, ':', '\\c')) + len({_ESC.format("text")}) AS size,
         row_number() OVER t AS no, count(*) OVER (PARTITION BY conv_id) AS total
  FROM rows WINDOW t AS (PARTITION BY conv_id ORDER BY turn, role, text)),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY no) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR no = total), 0)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
""",
)
def op5_chat_format(conversations):
    """Every assistant turn as an example; digests read back from the formatted texts and their masks."""
    said = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    return conversation_digests(chat_examples(turns))


def _repeated(size: int) -> str:
    return f"""
  SELECT doc_id, count(DISTINCT pos) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {size})) AS pos FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM (
        SELECT doc_id, i, array_to_string(list_slice(words, i, i + {size - 1}), ' ') AS gram FROM (
          SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM w WHERE len(words) >= {size})))
    WHERE times > 1) GROUP BY doc_id"""


#: Measures and verdicts of the quality rules, from any table ``docs`` with doc_id and text.
QUALITY_SQL = rf"""
w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM docs),
repeated AS ({_repeated(5)}),
phrases AS ({_repeated(3)}),
passages AS ({_repeated(41)}),
base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: len(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS inked,
         coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(phrases.n, 0) AS covered, passages.n IS NULL AS short
  FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN phrases USING (doc_id) LEFT JOIN passages USING (doc_id)),
judged AS (
  SELECT *, (len(inked) - len(list_distinct(inked)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base),
quality AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND covered <= 0.25 * n_words AND short AS kept
  FROM judged)
"""


@query("documents", f"WITH docs AS (SELECT doc_id, text FROM documents), {QUALITY_SQL} SELECT * FROM quality")
def op6_quality_rules(documents):
    """Measures and verdict for every text."""
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    out = quality_rules(documents.select("doc_id", "text"), least_repeat=3, max_covered=0.25, max_longest=40)
    return out.select("doc_id", *[f"quality.{f}" for f in fields])


def _license_sql() -> str:
    rows = []
    for name, body in TEMPLATES.items():
        grams = template_shingles(body)
        width = window_width(len(grams))
        rows += [
            f"('{name}', '{gram}', {len(grams)}, {needed(len(grams), 0.8)}, {width}, {window_step(width)})" for gram in grams
        ]
    return f"""
WITH templates(license_id, gram, n_shingles, needed, width, step) AS (VALUES {", ".join(rows)}),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
grams AS (
  SELECT doc_id, pos, array_to_string(list_slice(words, pos + 1, pos + 5), ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 4)) AS pos FROM words WHERE len(words) >= 5)),
hits AS (
  SELECT doc_id, license_id, n_shingles, needed, step, gram,
         unnest(range(greatest(0, (pos - width + step) // step), pos // step + 1)) AS w
  FROM grams JOIN templates USING (gram)),
windows AS (
  SELECT doc_id, license_id, n_shingles, w * step AS start, count(DISTINCT gram) AS n_matched
  FROM hits GROUP BY doc_id, license_id, n_shingles, needed, w * step HAVING count(DISTINCT gram) >= needed)
SELECT doc_id, license_id, n_shingles::BIGINT AS n_shingles, max(n_matched)::BIGINT AS n_matched,
       arg_min(start, -n_matched * 1000000000 + start)::BIGINT AS first_shingle
FROM windows GROUP BY doc_id, license_id, n_shingles"""


@query("documents", _license_sql())
def op10_license_scan(documents):
    """Known license notices in all documents."""
    return license_scan(documents, TEMPLATES, containment=0.8)


@query("documents")
def op3_suffix_dedup(documents):
    """What is left of every text when strings of 50 bytes that earlier documents have are removed."""
    out = suffix_dedup(documents.select("doc_id", "text"), length=50)
    return out.select(
        "doc_id", "deduped.n_bytes", "deduped.n_removed", "deduped.n_spans", F.sha2(F.coalesce("deduped.kept", F.lit(b"")), 256).alias("kept_sha256")
    )


@query("documents")
def op2_jaccard_join(documents):
    """Components of documents whose 4-word shingles overlap by 85 % or more."""
    return jaccard_groups(documents, size=4, percent=85)


@query("pages")
def op7_html_extract(pages):
    """The main text of every page."""
    out = extract_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.expr("CAST(length(text) AS BIGINT)").alias("n_chars"))


@query("embeddings")
def op9_nearest_neighbours(embeddings):
    """The ten nearest rows of every row whose id is divisible by 100."""
    return nearest_neighbours(embeddings, F.col("vec_id") % 100 == 0, k=10)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _crc32_sql(text: str) -> str:
    """DuckDB's way to the unsigned CRC-32 of ASCII text: one bit after the other."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k::INTEGER) & 1)))"
    step = "xor(s >> 1, 3988292384 * (xor(s, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda s, b: {step}), 4294967295)"


def _merkle_sql(levels: int = 8) -> str:
    """Leaves, then level after level inside the sources and over them, and the siblings of every document's run on each."""

    def field(sql: str) -> str:
        return f"CASE WHEN {sql} IS NULL THEN '-' ELSE strlen({sql}::VARCHAR) || ':' || ({sql}::VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, group: str) -> str:
        """{name}0 has g, place, digest; {name}1 and so on each a sixteenth of it, a group with one node staying as it is."""
        steps = []
        for i in range(levels):
            steps.append(f"""
{name}{i}n AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {name}{i}),
{name}{i + 1} AS (
  SELECT {group}, place // 16 AS place, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE any_value(digest) END AS digest
  FROM {name}{i}n GROUP BY {group}, place // 16)""")
        return ",".join(steps)

    def climb(name: str, group: str, start: str, at: str, out: str) -> str:
        """From ``start`` (a row per document, with {at}, folded and proof) up through all levels."""
        steps, last = [], start
        for i in range(levels):
            steps.append(f"""
{out}{i} AS (
  SELECT any_value(COLUMNS(d.* EXCLUDE (folded, proof, {at}))), any_value(d.{at}) // 16 AS {at},
         any_value(d.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.place) FILTER (t.place <> d.{at}), '') AS proof,
         CASE WHEN any_value(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.place = d.{at} THEN d.folded ELSE t.digest END, '' ORDER BY t.place))
              ELSE any_value(d.folded) END AS folded
  FROM {last} d JOIN {name}{i}n t ON t.{group} = d.{group} AND t.place // 16 = d.{at} // 16
  GROUP BY d.no)""")
            last = f"{out}{i}"
        return ",".join(steps)

    return f"""
WITH docs AS (
  SELECT *, {leaf("text")} AS leaf, {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 AS touched, {leaf(f"translate(text, {_LETTERS})")} AS changed,
         coalesce('+' || source, '') AS g, 0 AS one
  FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS no, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM docs),
s0 AS (SELECT g, place, leaf AS digest FROM placed),{tree("s", "g")},
r0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY g) - 1 AS place, digest, g FROM s{levels}),
{tree("r", "one").lstrip()},
begin AS (SELECT no, g, one, doc_id, leaf, place, CASE WHEN touched THEN changed ELSE leaf END AS folded, '' AS proof FROM placed),
{climb("s", "g", "begin", "place", "up").lstrip()},
middle AS (SELECT up{levels - 1}.* EXCLUDE (place), r0.place AS spot, r0.digest AS subroot FROM up{levels - 1} JOIN r0 USING (g)),
{climb("r", "one", "middle", "spot", "over").lstrip()}
SELECT doc_id, leaf, subroot, (SELECT digest FROM r{levels}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT digest FROM r{levels}) AS verified
FROM over{levels - 1}"""


@query("documents", _merkle_sql())
def op11_merkle_manifest(documents):
    """A proof for every document, folded from a text that was tampered with where 5 divides the id's crc32."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    changed = row_digest([*fields, f"translate(text, {_LETTERS})"])
    rows = documents.select(*fields, "text").select(
        "doc_id",
        "source",
        row_digest([*fields, "text"]).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed).alias("claimed"),
    )
    proofs = merkle_proofs(merkle_manifest(rows, group="source", order="doc_id", digest="leaf"))
    return proofs.select(
        F.col("row.doc_id").alias("doc_id"),
        to_hex("leaf").alias("leaf"),
        to_hex("subroot").alias("subroot"),
        to_hex("root").alias("root"),
        F.expr(f"sha2(lower(hex({proof_bytes()})), 256)").alias("proof_sha256"),
        to_hex(folded("coalesce(row.claimed, leaf)")).alias("folded_root"),
    ).withColumn("verified", F.expr("folded_root = root"))


@query("documents")
def op12_sentence_pieces(documents):
    """Encode every text into pieces, decode it again; digests of both."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_decode(piece_encode(documents.select("doc_id", "text"), path), path)
    return out.select(
        "doc_id",
        F.expr("CAST(size(pieces.ids) AS BIGINT)").alias("n_tokens"),
        F.expr("sha2(concat_ws(',', CAST(pieces.ids AS ARRAY<STRING>)), 256)").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "conversations",
    rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT conv_id, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos
  FROM turns),
every AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h, any_value(n) AS n
  FROM numbered GROUP BY conv_id),
plan AS (
  SELECT e.*, least(e.h, coalesce(b.n, 0)) AS taken FROM every e LEFT JOIN every b ON b.conv_id = e.base),
rebuilt AS (
  SELECT plan.conv_id, pos + 1 AS depth, role, text FROM plan JOIN numbered ON numbered.conv_id = plan.base AND pos < h
  UNION ALL
  SELECT conv_id, pos - h + taken + 1, role, text FROM plan JOIN numbered USING (conv_id) WHERE pos >= h),
said AS (
  SELECT conv_id, depth, sha256(strlen(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^ 	-]+')) AS words FROM rebuilt),
rows AS (
  SELECT conv_id, depth, words, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM said
  UNION ALL SELECT conv_id, 0, 0, '' FROM every),
lengths AS (SELECT conv_id, max(depth) AS d FROM rows GROUP BY conv_id),
nodes AS (
  SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = d), '')) AS ends_sha256
  FROM rows JOIN lengths USING (conv_id) GROUP BY node),
links AS (
  SELECT nodes.node, up.node AS parent, first.conv_id AS parent_conv_id
  FROM nodes JOIN rows up ON up.conv_id = nodes.conv_id AND up.depth = nodes.depth - 1 JOIN nodes first ON first.node = up.node),
children AS (SELECT parent AS node, count(*) AS n_children FROM links GROUP BY parent),
totals AS (
  SELECT up.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n_convs - 1) * below.words)::BIGINT AS saved_tokens
  FROM nodes below JOIN rows up ON up.conv_id = below.conv_id AND up.depth <= below.depth LEFT JOIN children c ON c.node = below.node
  GROUP BY up.node)
SELECT nodes.conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes JOIN totals USING (node) LEFT JOIN links USING (node) LEFT JOIN children USING (node)""",
)
def op13_prefix_trie(conversations):
    """All nodes of the prefix trie of conversations that share their families' first turns."""
    return prefix_trie(*with_shared_heads(numbered_turns(conversations)))
