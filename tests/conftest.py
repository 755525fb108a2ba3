import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.operators.calendar import build_calendar  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.settings import MarketSettings  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false", spark__sql__adaptive__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def calendar(spark):
    """Weekdays of 2024-2028 minus the fixed holidays and one extra closure."""
    closures = spark.sql("SELECT DATE '2026-03-11' AS date")
    return build_calendar(
        spark, ("NSE",), MarketSettings(), closures, start="2024-01-01", end="2028-12-31").cache()
