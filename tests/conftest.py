import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from strandframe.session import drop_run


def make_session():
    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).appName("strandframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    drop_run(session)
