import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablecare-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a table of text columns, with a row_id in the order given unless one is there."""

    def build(schema=None, **columns):
        names = list(columns)
        rows = list(zip(*columns.values()))
        schema = schema or ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def numbered(table):
    def build(**columns):
        n = len(next(iter(columns.values())))
        schema = "row_id BIGINT, " + ", ".join(f"`{c}` STRING" for c in columns)
        return table(schema, row_id=list(range(n)), **columns)

    return build
