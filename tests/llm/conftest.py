import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
