import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopgauge.schema import STAR_SCHEMAS  # noqa: E402
from shopgauge.session import build_session  # noqa: E402
from shopgauge.star import Star  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_star(spark):
    """A star from rows per table; tables not given are empty."""

    def make(**rows):
        return Star(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in STAR_SCHEMAS.items()})

    return make
