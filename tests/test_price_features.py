import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, long_bars, rows
from tidemark.operators import price_features as P
from tidemark.operators.bars import align_to_sessions
from tidemark.operators.ema import BLOCK, span_alpha, with_ema
from tidemark.settings import PriceSettings

S = PriceSettings()


def features(spark, calendar, pdf):
    return P.price_feature_rows(align_to_sessions(frame(spark, pdf), calendar), calendar, S)


@pytest.fixture(scope="module")
def long_result(spark, calendar):
    return features(spark, calendar, long_bars()).toPandas().sort_values("date").reset_index(drop=True)


def test_warmup_and_label_drop(spark, calendar):
    summary = rows(P.price_feature_summary(features(spark, calendar, long_bars()), S))[0]
    assert summary["warmup_rows_dropped"] == 253 and summary["label_rows_dropped"] == 1
    assert summary["hole_count"] == 0 and summary["input_row_count"] == 320
    assert summary["output_row_count"] == 320 - 253 - 1


def test_indicators_match_pandas(long_result):
    pdf = long_bars()
    close, high, low, volume = pdf.close, pdf.high, pdf.low, pdf.volume
    ema = lambda s, k: s.ewm(span=k, adjust=False, min_periods=k).mean()
    macd = ema(close, 12) - ema(close, 26)
    delta = close.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    prev = close.shift(1)
    tr = pd.concat([high - low, (high - prev).abs(), (low - prev).abs()], axis=1).max(axis=1)
    obv = (np.sign(close.diff().fillna(0)) * volume).cumsum()
    stoch = ((close - low.rolling(14).min()) / (high.rolling(14).max() - low.rolling(14).min()) * 100).fillna(50)
    mid, std = close.rolling(20).mean(), close.rolling(20).std(ddof=0)
    want = {
        "ret_3d": close / close.shift(3) - 1, "ma_20": mid, "volatility_10d": close.pct_change().rolling(10).std(ddof=0),
        "volume_ma_ratio": volume / volume.rolling(20).mean(), "macd": macd,
        "macd_signal": macd.ewm(span=9, adjust=False, min_periods=9).mean(), "rsi_14": 100 - 100 / (1 + gain / loss),
        "price_vs_52w_high": close / close.rolling(252).max(), "atr_14": tr.rolling(14).mean(),
        "obv_ratio": (obv / obv.rolling(20, min_periods=1).mean().where(lambda x: x != 0)).mask(
            obv.rolling(20, min_periods=1).mean() == 0, 1.0),
        "stoch_k": stoch, "stoch_d": stoch.rolling(3, min_periods=1).mean(), "bb_width": 4 * std / mid,
        "bb_position": ((close - (mid - 2 * std)) / (4 * std)).clip(0, 1).fillna(0.5),
        "ret_1d_lag2": (close / close.shift(1) - 1).shift(2),
    }
    for name, series in want.items():
        got = long_result[name]
        assert list(got.isna()) == list(series.isna()), name
        assert np.allclose(got.dropna(), series.dropna(), rtol=1e-9, atol=1e-9), name
    assert long_result.macd.first_valid_index() == 25
    assert long_result.macd_signal.first_valid_index() == 33
    assert long_result.rsi_14.first_valid_index() == 14


def test_rsi_special_cases(spark, calendar):
    for closes, expected in (([5.0] * 20, 50.0), ([5.0 + i for i in range(20)], 100.0), ([50.0 - i for i in range(20)], 0.0)):
        pdf = long_bars(20).assign(close=closes)
        out = rows(P.technical_features(align_to_sessions(frame(spark, pdf), calendar), S), "date")
        assert out[-1]["rsi_14"] == expected


@pytest.mark.parametrize("alpha", [2 / 13, 1 / 14, 0.5])
def test_ema_across_blocks(spark, alpha):
    rng = np.random.default_rng(7)
    n = 3 * BLOCK + 17
    x = pd.Series(rng.normal(1000, 50, n))
    x[:5] = np.nan
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    got = with_ema(df, {"e": ("x", alpha, 10)}, ("k",), "i").orderBy("i").toPandas().e
    want = x.ewm(alpha=alpha, adjust=False, min_periods=10).mean()
    assert list(got.isna()) == list(want.isna())
    assert np.allclose(got.dropna(), want.dropna(), rtol=1e-12)


def test_tie_is_down_and_zero_volume_is_neutral(spark, calendar):
    pdf = long_bars(30)
    pdf.loc[10, "close"] = pdf.close[9]
    pdf.loc[12, "volume"] = 0.0
    out = rows(P.with_label(P.technical_features(align_to_sessions(frame(spark, pdf), calendar), S), calendar), "date")
    assert out[9][P.LABEL] == 0
    assert out[13]["volume_change_1d"] == 0.0
    assert out[-1][P.LABEL] is None and out[-1]["target_date"] > out[-1]["date"]


def test_no_look_ahead(spark, calendar, long_result):
    changed = long_bars()
    changed.loc[300:, ["close", "high", "low", "volume"]] *= 3.0
    after = features(spark, calendar, changed).toPandas().sort_values("date").reset_index(drop=True)
    pd.testing.assert_frame_equal(
        after.loc[:299, list(S.feature_columns)], long_result.loc[:299, list(S.feature_columns)])


def test_union_of_instruments_equals_each_alone(spark, calendar):
    one, two = long_bars(290), long_bars(280, "TCS", "2025-02-03", 2.5).iloc[::2]
    both = features(spark, calendar, pd.concat([one, two])).toPandas()
    for pdf in (one, two):
        alone = features(spark, calendar, pdf).toPandas().sort_values("date").reset_index(drop=True)
        part = both[both.ticker == pdf.ticker.iloc[0]].sort_values("date").reset_index(drop=True)
        pd.testing.assert_frame_equal(part, alone)


def test_one_shuffle_feeds_every_window(spark, calendar):
    """All windows reuse the instrument partitioning of the gap fill."""
    df = P.price_feature_rows(align_to_sessions(frame(spark, long_bars(40)), calendar), calendar, S)
    plan = df._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.splitlines() if "Exchange hashpartitioning(ticker" in line]
    assert len(hashed) == 1, plan
