import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from catalog.session import ship  # noqa: E402
from fixture_data import DATA  # noqa: E402


def builder():
    return (
        SparkSession.builder.master("local[8]")
        .appName("layerstack-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
    )


@pytest.fixture(scope="session")
def spark():
    session = builder().getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.stop()
        folder = tempfile.mkdtemp(prefix="layerstack-")
        session = builder().config("spark.checkpoint.dir", folder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet")
