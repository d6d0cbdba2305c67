from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from genotiles.session import SQL_DEFAULTS, configure  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    builder = SparkSession.builder.master("local[8]").appName("genotiles-tests")
    settings = {
        **SQL_DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted(tuple(r) for r in df.select(*(order or df.columns)).collect())
