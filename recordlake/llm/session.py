"""What a session needs before these operators run in it."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..plans.stages import configure, materialise

#: Otherwise shuffle files stay until the driver happens to collect its garbage, however large they are.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings, and the library's place for Python workers that start in another folder."""
    configure(spark)
    # A worker holds several batches: bound them by bytes, as texts are of any length.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of jobs started in here go when the job ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, after which disk holds the table and no shuffle files of the job."""
    with passing_shuffles(df.sparkSession):
        return materialise(df, name)
