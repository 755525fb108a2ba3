"""Small frames for the tests."""

from __future__ import annotations

import datetime as dt

import pandas as pd

BAR_SCHEMA = "ticker string, exchange string, date date, open double, high double, low double, close double, volume double"


def weekdays(start: str, n: int, skip=()) -> list[dt.date]:
    days, day = [], dt.date.fromisoformat(start)
    while len(days) < n:
        if day.weekday() < 5 and day not in skip:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


def long_bars(n: int = 320, ticker: str = "INFY", start: str = "2025-01-02", scale: float = 1.0) -> pd.DataFrame:
    """Closed-form bars; the fixed holidays of the calendar are left out."""
    holidays = {dt.date(y, m, d) for y in range(2024, 2029) for m, d in ((1, 26), (5, 1), (8, 15), (10, 2))}
    holidays.add(dt.date(2026, 3, 11))
    rows = []
    for i, day in enumerate(weekdays(start, n, holidays)):
        close = (100 + 0.35 * i + ((i % 5) - 2) * 0.4) * scale
        rows.append((ticker, "NSE", day, close, close + 1, close - 1, close, float(1000 + 25 * i + 10 * (i % 3))))
    return pd.DataFrame(rows, columns=["ticker", "exchange", "date", "open", "high", "low", "close", "volume"])


def frame(spark, pdf: pd.DataFrame, schema: str = BAR_SCHEMA):
    return spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], schema)


def rows(df, *order) -> list[dict]:
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
