import datetime as dt

from pyspark.sql import functions as F

from tests.helpers import BAR_SCHEMA, frame, long_bars, rows
from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.settings import MarketSettings, PriceSettings

RAW = "ticker string, exchange string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, source_row_number long"


def test_quarantine_and_dedupe(spark):
    raw = spark.createDataFrame([
        ("INFY", "NSE", "2026-03-09", 100.0, 103.0, 99.0, 102.0, 102.0, 10.0, 0),
        ("INFY", "NSE", "2026-03-10", 101.0, 104.0, 100.0, 103.0, 103.0, 10.0, 1),
        ("INFY", "NSE", "2026-03-10", 101.0, 105.0, 100.0, 104.0, 104.0, 10.0, 2),
        ("INFY", "NSE", "2026-03-13", 110.0, 108.0, 111.0, 110.0, 110.0, 10.0, 3),
    ], RAW)
    valid, bad = B.split_quarantine(B.bar_reasons(B.normalize_provider_columns(raw)))
    clean = rows(B.dedupe_bars(valid), "date")
    assert [(r["date"], r["close"], r["duplicates"]) for r in clean] == [
        (dt.date(2026, 3, 9), 102.0, 0), (dt.date(2026, 3, 10), 104.0, 1)]
    assert [r["reasons"] for r in rows(bad)] == [["invalid_high_low_relationship"]]


def test_missing_values_are_named_before_the_high_low_rule(spark):
    raw = spark.createDataFrame([("INFY", "NSE", "soon", 1.0, 0.0, 2.0, None, None, -1.0, 0)], RAW)
    found = rows(B.bar_reasons(B.normalize_provider_columns(raw)))[0]["reasons"]
    assert found == ["invalid_date", "invalid_close", "invalid_volume"]


def test_gap_row_repeats_prices_with_zero_volume(spark, calendar):
    pdf = long_bars(35, start="2026-01-05")
    cut = pdf.drop(index=3)
    out = rows(B.align_to_sessions(frame(spark, cut), calendar), "date")
    gaps = [r for r in out if r["market_data_gap_flag"]]
    assert len(out) == 35 and len(gaps) == 1
    assert gaps[0]["date"] == pdf.date[3] and gaps[0]["volume"] == 0.0
    assert gaps[0]["close"] == pdf.close[2] and gaps[0]["high"] == pdf.high[2]


def test_weekend_bars_vanish_but_bound_the_grid(spark, calendar):
    sat, mon, tue, sun = (dt.date(2026, 4, d) for d in (4, 6, 7, 12))
    made = [("X", "NSE", d, 1.0, 1.0, 1.0, c, 5.0) for d, c in ((sat, 9.0), (tue, 2.0), (sun, 8.0))]
    out = rows(B.align_to_sessions(spark.createDataFrame(made, BAR_SCHEMA), calendar), "date")
    assert [r["date"] for r in out] == [mon, tue, *(dt.date(2026, 4, d) for d in (8, 9, 10))]
    assert out[0]["close"] is None and out[0]["open"] == 1.0
    assert [r["close"] for r in out[1:]] == [2.0] * 4
    assert [r["market_data_gap_flag"] for r in out] == [1, 0, 1, 1, 1]


def test_align_equals_grid_join(spark, calendar):
    """The exploded gap fill gives what a plain grid join and fills give."""
    pdf = long_bars(120).sample(frac=0.5, random_state=3)
    got = B.align_to_sessions(frame(spark, pdf), calendar).toPandas().sort_values("date").reset_index(drop=True)
    days = [r["date"] for r in rows(calendar.where("is_session").where(
        F.col("date").between(F.lit(pdf.date.min()), F.lit(pdf.date.max()))), "date")]
    want = pdf.set_index("date").reindex(days)
    assert list(got.date) == days
    assert list(got.market_data_gap_flag) == list(want.close.isna().astype(int))
    assert list(got.close) == list(want.close.ffill())
    assert list(got.volume) == list(want.volume.fillna(0.0))


def test_contract_names_violations(spark):
    bad = long_bars(3).assign(close=[0.0, 1.0, 2.0])
    out = rows(B.bar_contract(frame(spark, bad), PriceSettings()))[0]
    assert out["violations"] == ["nonpositive_close", "insufficient_rows"]
    assert PriceSettings().minimum_rows == 255


def test_calendar_neighbours(spark, calendar):
    by_day = {r["date"]: r for r in rows(calendar.where("date between '2026-03-05' and '2026-03-20'"))}
    closed = by_day[dt.date(2026, 3, 11)]
    assert not closed["is_session"]
    assert closed["next_session"] == closed["on_or_after"] == dt.date(2026, 3, 12)
    assert closed["previous_session"] == closed["on_or_before"] == dt.date(2026, 3, 10)
    assert closed["second_session"] == dt.date(2026, 3, 13)
    saturday = by_day[dt.date(2026, 3, 14)]
    assert saturday["second_session"] == dt.date(2026, 3, 17)


def test_closures_from_both_json_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('["2026-03-11"]')
    (tmp_path / "b.json").write_text('{"holidays": ["2026-03-12"]}')
    found = [[r["date"] for r in rows(C.closures_from_json(spark, str(tmp_path / f)))] for f in ("a.json", "b.json")]
    assert found == [[dt.date(2026, 3, 11)], [dt.date(2026, 3, 12)]]


def test_calendar_refuses_unbounded_range(spark):
    import pytest

    with pytest.raises(ValueError):
        C.build_calendar(spark, tuple(f"E{i}" for i in range(200)), MarketSettings())


def test_tail_merge_takes_refetched_rows(spark):
    old = long_bars(10)
    new = long_bars(12).iloc[5:].assign(close=lambda d: d.close + 50)
    out = rows(B.merge_tail(frame(spark, old), frame(spark, new), 3), "date")
    assert len(out) == 12
    refetched = [r["close"] > 150 for r in out]
    assert refetched == [False] * refetched.index(True) + [True] * (12 - refetched.index(True))


def test_provider_choice_is_per_instrument(spark):
    df = spark.createDataFrame([
        ("A", "NSE", "upstox", 1), ("A", "NSE", "yfinance", 2), ("B", "NSE", "yfinance", 3)],
        "ticker string, exchange string, provider string, x int")
    out = rows(B.choose_provider(df, ("nse_bhavcopy", "upstox", "yfinance")), "x")
    assert [r["x"] for r in out] == [1, 3]
