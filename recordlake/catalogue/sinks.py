"""Export queries: batches, files written and read back, evolving tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import DESTINATIONS
from ..plans.stages import run_folder, wide_row_number
from ..sinks.export import (
    export,
    flatten_records,
    grid,
    manifest,
    read_table,
    sheet_rows,
    table_versions,
    webhook_batches,
    write_csv,
    write_json,
    write_markdown,
    write_table,
)
from ..spec import RecordSpec
from .registry import query

_SPEC = RecordSpec.of([("c_custkey", "integer"), ("c_name", "string"), ("c_acctbal", "number"), ("vip", "boolean"), ("tags", "array")])


def _records(load):
    """Customers as typed records with a boolean, an array and gaps."""
    return load("customer").select(
        F.concat(F.lit("segment-"), F.col("c_mktsegment")).alias("job_id"),
        "c_custkey",
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("c_name"),
        "c_acctbal",
        (F.col("c_custkey") % 2 == 0).alias("vip"),
        F.array(F.col("c_mktsegment"), (F.col("c_custkey") % 4).cast("string")).alias("tags"),
    )


_FLAT_SQL = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE '' END AS c_name,
    CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS vip, c_mktsegment || ', ' || (c_custkey % 4) AS tags"""


def _folder(spark, name: str) -> str:
    """A new folder next to the other intermediate tables of the run."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    """
    WITH n AS (SELECT 'segment-' || c_mktsegment AS job_id, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer),
    b AS (SELECT job_id, (rn - 1) // 25 + 1 AS batch, count(*) AS count, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM n GROUP BY 1, 2)
    SELECT *, max(batch) OVER (PARTITION BY job_id) AS batches FROM b
    """
)
def webhook_payloads(spark, load):
    """Payload batches of 25 records per job."""
    batches = webhook_batches(_records(load), _SPEC.headers, position="c_custkey")
    body = F.from_json("payload", "count long, batch long, records array<struct<c_custkey: long>>")
    return batches.withColumn("body", body).select(
        "job_id",
        "batch",
        "batches",
        F.col("body.count").alias("count"),
        F.array_min("body.records.c_custkey").alias("first_key"),
        F.array_max("body.records.c_custkey").alias("last_key"),
    )


@query(
    """SELECT c_mktsegment AS segment, c_custkey AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer"""
)
def wide_ranks(spark, load):
    """Positions within jobs of any size, numbered by range."""
    rows = load("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    return wide_row_number(rows, ["segment"], ["k"], "rn")


@query(_FLAT_SQL + " FROM customer")
def flattened_records(spark, load):
    """Record values as text."""
    return flatten_records(_records(load), ["c_custkey", "c_name", "vip", "tags"])


@query(_FLAT_SQL + " FROM customer")
def csv_roundtrip(spark, load):
    """CSV files written with a header and read back."""
    headers = ["c_custkey", "c_name", "vip", "tags"]
    path = _folder(spark, "csv")
    write_csv(_records(load), headers, path)
    schema = ", ".join(f"{h} string" for h in headers)
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(h, F.lit("")).alias(h) for h in headers])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS c_name, c_acctbal, c_custkey % 2 = 0 AS vip,
    c_mktsegment || '/' || (c_custkey % 4) AS tags FROM customer"""
)
def json_roundtrip(spark, load):
    """JSON rows keep their types."""
    path = _folder(spark, "json")
    write_json(_records(load), _SPEC.headers, path, "job-1")
    back = spark.read.schema(_SPEC.struct).json(f"{path}/records")
    return back.withColumn("tags", F.array_join("tags", "/"))


@query("SELECT 'job-1' AS job_id, count(*) AS count, 'c_custkey,c_name,c_acctbal,vip,tags' AS fields FROM customer")
def json_manifest(spark, load):
    """The envelope of a JSON export."""
    rows = manifest(_records(load), _SPEC.headers, "job-1")
    return rows.select("job_id", "count", F.array_join("fields", ",").alias("fields"))


@query(
    """
    SELECT '| c_custkey | c_name | vip |' AS line UNION ALL SELECT '| --- | --- | --- |'
    UNION ALL SELECT '| ' || c_custkey || ' | ' || CASE WHEN c_custkey % 9 <> 0 THEN c_name || ' \\| x' ELSE '' END || ' | '
      || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ' |' FROM customer
    """
)
def markdown_roundtrip(spark, load):
    """Lines of a Markdown table, escaped, written and read back."""
    path = _folder(spark, "markdown")
    records = _records(load).withColumn("c_name", F.concat("c_name", F.lit(" | x")))
    write_markdown(records, ["c_custkey", "c_name", "vip"], path, order=["c_custkey"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    """
    SELECT 'first' AS job_id, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(NULL AS VARCHAR) AS email FROM supplier
    UNION ALL SELECT 'second', CAST(s_suppkey AS VARCHAR), s_name, 'sales@s' || s_suppkey || '.test' FROM supplier
    """
)
def evolving_table(spark, load):
    """A table that gains a column with its second append."""
    root = _folder(spark, "table")
    rows = load("supplier").select("s_suppkey", "s_name")
    write_table(rows.withColumn("job_id", F.lit("first")), ["s_suppkey", "s_name"], root, "My Suppliers!")
    email = F.concat(F.lit("sales@s"), F.col("s_suppkey").cast("string"), F.lit(".test"))
    second = rows.withColumn("job_id", F.lit("second")).withColumn("email", email)
    write_table(second, ["s_suppkey", "s_name", "email"], root, "My Suppliers!")
    return read_table(spark, root, "My Suppliers!").select("job_id", "s_suppkey", "s_name", "email")


@query(
    """SELECT CAST(-1 AS BIGINT) AS row_no, 'c_custkey;c_name;vip' AS cells UNION ALL
    SELECT c_custkey, c_custkey || ';' || CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE '' END || ';' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM customer"""
)
def sheet_value_rows(spark, load):
    """Header and value rows for a sheet."""
    rows = sheet_rows(_records(load), ["c_custkey", "c_name", "vip"], position="c_custkey")
    return rows.select("row_no", F.array_join("values", ";").alias("cells"))


@query(
    """
    WITH v AS (SELECT * FROM (VALUES (0, 1, 'job_id,s_name,source_at'), (1, 2, 'job_id,s_name,source_at,email')) t(version, n_folders, columns)),
    n AS (SELECT count(*) AS rows FROM supplier)
    SELECT version::BIGINT AS version, n_folders::BIGINT AS n_folders, columns, (version + 1) * rows AS n_rows,
      (version + 1) * rows - CASE WHEN version = 1 THEN rows ELSE 0 END AS without_email FROM v, n
    """
)
def table_snapshots(spark, load):
    """Versions of an evolving table; an append that fails midway or is repeated leaves no trace."""
    root, rows = _folder(spark, "snapshots"), load("supplier").select("s_name")
    first = rows.withColumn("job_id", F.lit("first"))
    write_table(first, ["s_name"], root, append_id="one")
    broken = first.withColumn("s_name", F.expr("IF(s_name IS NULL, s_name, raise_error('broken'))"))
    try:
        write_table(broken, ["s_name"], root, append_id="two")
    except Exception as error:
        if "broken" not in str(error):
            raise
    second = rows.withColumn("job_id", F.lit("second")).withColumn("email", F.concat("s_name", F.lit("@x.test")))
    for _ in range(2):
        write_table(second, ["s_name", "email"], root, append_id="two")
    out = None
    for version in (0, 1):
        table = read_table(spark, root, version=version)
        email = F.col("email") if "email" in table.columns else F.lit(None)
        counts = table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(email.isNull()).alias("without_email"))
        counts = counts.withColumn("version", F.lit(version).cast("long"))
        out = counts if out is None else out.unionByName(counts)
    versions = table_versions(spark, root).withColumn("columns", F.array_join("columns", ","))
    return versions.join(out, "version")


@query(
    """
    WITH n AS (SELECT count(*) AS rows FROM customer),
    routes AS (SELECT * FROM (VALUES ('csv', 'csv', true), ('json', 'json', true), ('markdown', 'markdown', true), ('sqlite', 'sqlite', true),
      ('webhook', 'json', true), ('webhook', 'webhook', true), ('google_sheets', 'json', true), ('google_sheets', 'google_sheets', true),
      ('failed', 'json', false)) t(destination, format, works))
    SELECT destination, format, CASE WHEN works THEN rows ELSE 0 END AS n_rows, NOT works AS failed,
      CASE WHEN format = 'json' AND works THEN rows END AS n_mirrored FROM routes, n
    UNION ALL SELECT 'grid', 'c_custkey,c_name,c_acctbal,vip,tags', rows, false, NULL FROM n
    """
)
def export_routes(spark, load):
    """Every destination with its outputs, the mirrors of remote ones, a sink that fails and the plain grid."""
    records, root, outputs = _records(load), _folder(spark, "routes"), []
    for destination in DESTINATIONS:
        for out in export(records, _SPEC, destination, f"{root}/{destination}", job_id="job-1", order=["c_custkey"]):
            outputs.append((destination, out))
    # A folder cannot be made below a file.
    blocked = spark.read.text(f"{root}/csv").inputFiles()[0]
    outputs += [("failed", out) for out in export(records, _SPEC, "json", f"{blocked}/below")]
    rows = []
    for destination, out in outputs:
        mirrored = None
        if out["format"] == "json" and "error" not in out:
            mirrored = spark.read.json(f"{out['path']}/records").count()
        rows.append((destination, out["format"], out["rows"], "error" in out, mirrored))
    flat = grid(records, _SPEC)
    rows.append(("grid", ",".join(flat.columns), flat.count(), False, None))
    return spark.createDataFrame(rows, "destination string, format string, n_rows long, failed boolean, n_mirrored long")
