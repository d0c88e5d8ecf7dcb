import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkstream.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over one-column rows and return the results in order."""

    def run(inputs, expression, schema="i int, v string"):
        frame = spark.createDataFrame(list(enumerate(inputs)), schema)
        rows = frame.select("i", expression.alias("r")).collect()
        return [row["r"] for row in sorted(rows, key=lambda row: row["i"])]

    return run
