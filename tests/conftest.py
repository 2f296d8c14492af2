import datetime as dt
import math

import pytest

from panelwright.scratch import release
from panelwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "panelwright-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__sql__warehouse__dir="/tmp/spark-panelwright-warehouse",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


def business_days(first: dt.date, count: int) -> list[dt.date]:
    days = []
    day = first
    while len(days) < count:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


@pytest.fixture(scope="session")
def formula_prices(spark):
    """320 business days of three assets from closed formulas."""
    rows = []
    for t, day in enumerate(business_days(dt.date(2020, 1, 1), 320)):
        rows.append(("RISK", day, 100 + t * 0.2))
        rows.append(("RISK2", day, 100 + math.sin(t / 7) * 3))
        rows.append(("BOND", day, 100 + t * 0.03))
    return spark.createDataFrame(rows, "symbol string, date date, close double").cache()
