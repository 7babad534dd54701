import pytest

from recordlake.llm.session import prepared


@pytest.fixture(scope="session")
def llm(spark):
    """The session with small Arrow batches, so that streams cross their edges."""
    prepared(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    return spark
