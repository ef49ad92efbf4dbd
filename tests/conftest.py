from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def _release():
    yield
    from survloom.settings import release

    release()


@pytest.fixture(scope="session")
def micro(spark):
    """Six rows with hand-computed results."""
    rows = [
        (1, 1.0, 1, 0.9),
        (2, 2.0, 1, 0.5),
        (3, 2.0, 0, 0.5),
        (4, 3.0, 1, 0.7),
        (5, 4.0, 0, 0.2),
        (6, 5.0, 0, 0.1),
    ]
    return spark.createDataFrame(rows, "id long, time double, event int, pred double")
