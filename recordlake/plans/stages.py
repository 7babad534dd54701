"""Plan helpers: stage boundaries, written intermediate tables, wide ranks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Row limits per window group up to this size are cut before the shuffle.
GROUP_LIMIT = 4096


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; all can change at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(GROUP_LIMIT))
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above this point.

    Catalyst pushes a filter on a computed column below the projection that
    computes it, which evaluates the expression twice.  Regular expressions over
    whole pages are worth computing once, so the row passes through ``inline``,
    which filters on its output do not cross.  It is a narrow step: no shuffle,
    no Python.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.array(row)))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows by key before each of them becomes a page or an expensive value.

    A table with few row groups is read by few tasks, however much work its rows mean.
    Only key columns pass this shuffle; page bodies that are read stay where they are.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, else the warehouse.

    ``spark.checkpoint.dir`` is named by the deployment for this use, so it is taken as it
    is: a ``file:`` folder there may be a mount that all machines share.  Without it, a
    warehouse on one machine's disk would be written and read in parts on a cluster; there
    a ``file:`` warehouse is an error, but for one that a standalone cluster names itself.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") or named
    root = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.sparkContext.master
    own_disk = root.startswith("file:") or "://" not in root
    mounted = master.startswith("spark://") and not root.rstrip("/").endswith("/spark-warehouse")
    if own_disk and not mounted and not master.startswith("local"):
        raise ValueError(f"intermediate tables need a shared folder in spark.checkpoint.dir, not {root}")
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back with a short lineage.

    The table is columnar, so later steps read only the columns they use, and it
    outlives lost executors.  ``discard_intermediates`` removes a session's tables.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        own = f"/recordlake/{spark.sparkContext.applicationId}/"
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if own in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_folder(spark: SparkSession) -> str:
    """The session's own folder for intermediate tables."""
    return f"{checkpoint_root(spark)}/recordlake/{spark.sparkContext.applicationId}"


def discard_intermediates(spark: SparkSession) -> None:
    """Remove the intermediate tables of this session; no result that reads them works afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row of every key.

    Planned with a group limit on both sides of the shuffle: each map task sends
    one row per key, however many rows a hot key has.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None, rank: str
) -> DataFrame:
    """First ``limit`` rows of every key with their 1-based rank; all rows without a limit.

    A small limit is cut inside the map tasks, so a hot key sends at most ``limit`` rows
    from each of them.  Larger ones number all rows.  ``order`` has to be unique.
    """
    if limit is None or limit > GROUP_LIMIT:
        numbered = wide_row_number(df, keys, order, rank)
        return numbered if limit is None else numbered.filter(F.col(rank) <= limit)
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def wide_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str, *, total: str | None = None
) -> DataFrame:
    """``row_number`` per key for keys of any size, and the key's number of rows in ``total``.

    The rows are dealt by range of (keys, order), sorted and written once, each with its
    place in its partition.  What a key has in the partitions before is a running sum
    over one number for each key and partition.  ``order`` has to be unique within a key,
    also to spread a key over partitions.  This writes when it is called.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The upper bits are the partition, the lower 33 the place in it.
    rows = materialise(ordered.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(*keys, part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__start"))
    by_key = W.partitionBy(*keys)
    running = F.sum("__n").over(by_key.orderBy("__part").rowsBetween(W.unboundedPreceding, 0))
    starts = counts.select(
        *keys, "__part", (running - F.col("__n") - F.col("__start") + 1).alias("__shift"), F.sum("__n").over(by_key).alias("__total")
    )
    starts = materialise(starts, "starts")
    joined = rows.withColumn("__part", part).join(starts, [*keys, "__part"])
    out = joined.withColumn(rank, F.col("__at") + F.col("__shift"))
    if total is not None:
        out = out.withColumn(total, F.col("__total"))
    return out.select(*df.columns, rank, *([total] if total is not None else []))
