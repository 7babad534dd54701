import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from recordlake.plans.stages import configure, discard_intermediates

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    discard_intermediates(session)
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of a SQL text over one row of named strings."""

    def evaluate(sql, **columns):
        from pyspark.sql import functions as F

        frame = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in columns.items()])
        return frame.select(F.expr(sql).alias("out")).first()["out"]

    return evaluate
