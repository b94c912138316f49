import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from urlshift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", "tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of a one-column expression over a list of texts."""
    def values(texts, expression):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", expression.alias("y"))
        return [row.y for row in sorted(rows.collect())]

    return values
