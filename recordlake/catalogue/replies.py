"""Queries over logged replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.validate import accepted, validate_records
from ..sources.replies import json_payloads, merge_replies, parse_replies, reply_candidates, reply_queries
from ..spec import RecordSpec
from .registry import query


@query(
    """
    SELECT conv_id AS session, nullif(trim(string_agg(text, '' ORDER BY turn), ' ' || chr(9) || chr(10) || chr(13)), '') AS text FROM conversations GROUP BY conv_id
    """
)
def reply_merge(spark, load):
    """Event log to reply text: every turn is a part that is updated once."""
    turns = load("conversations")
    part = F.concat(F.lit("p"), F.col("turn").cast("string"))

    def event(text, step):
        return F.struct(
            (F.col("turn") * 3 + step).alias("seq"),
            F.to_json(F.struct(F.lit("text").alias("type"), F.struct(part.alias("id"), text.alias("text")).alias("part"))).alias("line"),
        )

    noise = F.struct((F.col("turn") * 3 + 2).alias("seq"), F.lit('{"type": "step-start"} trailing').alias("line"))
    log = turns.select(
        F.col("conv_id").alias("session"),
        F.inline(F.array(event(F.lit("draft"), F.lit(0)), event(F.col("text"), F.lit(1)), noise)),
    )
    return merge_replies(log).select("session", "text")


@query(
    """
    SELECT 'job-' || item_id AS job_id, unnest([1, 2]) AS query_no, unnest(['list of ' || (item_id % 9), 'directory ' || item_id]) AS query
    FROM benchmark WHERE item_id % 4 < 3
    """
)
def reply_search_queries(spark, load):
    """Planner replies: bare, fenced, wrapped in prose, or without JSON."""
    key = F.col("item_id").cast("string")
    body = F.concat(
        F.lit('{"queries": ["list of '), (F.col("item_id") % 9).cast("string"), F.lit('", "", "directory '), key, F.lit('"]}')
    )
    text = (
        F.when(F.col("item_id") % 4 == 0, body)
        .when(F.col("item_id") % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(F.col("item_id") % 4 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" enjoy")))
        .otherwise(F.col("text"))
    )
    replies = load("benchmark").select(F.concat(F.lit("job-"), key).alias("job_id"), text.alias("text"))
    return reply_queries(replies).select("job_id", F.col("query_no").cast("int").alias("query_no"), "query")


_SPEC = RecordSpec.of([("company_name", "string", True), ("size", "integer"), ("price", "number"), ("active", "boolean"), ("tags", "array")])


def _replies(load):
    """One extractor reply per part: typed JSON, text values, an empty list, or no JSON."""
    key = F.col("p_partkey").cast("string")
    typed = F.concat(
        F.lit('{"records": [{"Company Name": "Part '), key, F.lit('", "size": '), F.col("p_size").cast("string"),
        F.lit('.9, "price": '), F.col("p_retailprice").cast("string"), F.lit(', "active": true, "tags": ["a", " b ", ""]}, 7]}'),
    )
    worded = F.concat(
        F.lit('```json\n{"records": [{"company_name": "Part '), key, F.lit('", "size": "'), F.col("p_size").cast("string"),
        F.lit(' pieces", "price": "$'), F.col("p_retailprice").cast("string"), F.lit('", "active": "no", "tags": "a; b"}]}\n```'),
    )
    text = (
        F.when(F.col("p_partkey") % 4 == 0, typed)
        .when(F.col("p_partkey") % 4 == 1, worded)
        .when(F.col("p_partkey") % 4 == 2, '{"records": []}')
        .otherwise("nothing found")
    )
    return load("part").select(
        F.lit("parts").alias("job_id"), F.concat(F.lit("https://p"), key, F.lit(".test/")).alias("url"), text.alias("text")
    )


@query(
    """
    SELECT 'https://p' || p_partkey || '.test/' AS url, 'Part ' || p_partkey AS company_name, CAST(p_size AS BIGINT) AS size, p_retailprice AS price,
      p_partkey % 4 = 0 AS active, 'a/b' AS tags FROM part WHERE p_partkey % 4 < 2
    """
)
def reply_records(spark, load):
    """Records of the replies; JSON values and text values are coerced alike or not, as they must."""
    parsed = parse_replies(_replies(load))
    valid = accepted(validate_records(reply_candidates(parsed, _SPEC, keys=["job_id", "url"]), _SPEC))
    return valid.select(F.col("source_url").alias("url"), "company_name", "size", "price", "active", F.array_join("tags", "/").alias("tags"))


@query("SELECT 'https://p' || p_partkey || '.test/' AS url, p_partkey % 4 = 2 AS empty FROM part WHERE p_partkey % 4 < 3")
def reply_answers(spark, load):
    """Pages that have an answer, and whether it is empty."""
    parsed = parse_replies(_replies(load))
    return parsed.filter(F.col("records").isNotNull()).select("url", (F.size("records") == 0).alias("empty"))


@query(
    """
    SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [p_partkey, p_partkey + 1] WHEN 1 THEN [p_partkey] ELSE [p_partkey + 2] END) AS v FROM part
    """
)
def reply_payloads(spark, load):
    """JSON objects of every fenced block, else of the text."""
    key = F.col("p_partkey")

    def obj(n):
        return F.concat(F.lit('{"v": '), n.cast("string"), F.lit("}"))

    text = (
        F.when(key % 3 == 0, F.concat(F.lit("a ```json\n"), obj(key), F.lit("\n``` b ```["), obj(key + 1), F.lit(", 5]```")))
        .when(key % 3 == 1, F.concat(F.lit("so: "), obj(key), F.lit(" bye")))
        .otherwise(F.concat(F.lit("list ["), obj(key + 2), F.lit(", 3] end")))
    )
    rows = load("part").select("p_partkey", text.alias("text"))
    found = rows.select("p_partkey", F.posexplode_outer(F.expr(json_payloads("text"))).alias("pos", "o"))
    return found.filter(F.col("o").isNotNull()).select("p_partkey", F.try_variant_get("o", "$.v", "long").alias("v"))
