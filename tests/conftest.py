from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glyphloom import ship

    settings = {
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.sql.shuffle.partitions": "2",
        # tiny inputs: compiling a plan takes longer than interpreting it
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture
def texts(spark):
    """Frame of (file_path, language, content) rows."""

    def make(*rows):
        return spark.createDataFrame(list(rows), "file_path string, language string, content string")

    return make
