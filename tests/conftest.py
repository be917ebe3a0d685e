import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "shelfmark-tests",
        "local[8]",
        8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column over one row of named strings."""
    def run(column, **inputs):
        row = spark.createDataFrame([tuple(inputs.values())], list(inputs)) if inputs else spark.range(1)
        return row.select(column.alias("v")).collect()[0].v

    return run
