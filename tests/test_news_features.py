import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import merge as G
from tidemark.operators import news_features as N
from tidemark.operators import windows as W
from tidemark.settings import NewsSettings

SCHEMA = ("article_id string, ticker string, exchange string, published_at_ist timestamp, published_at_utc timestamp, provider string, "
          "extraction_mode string, content_quality_score double, warning_flag boolean, relevance_score double, sentiment_label string, "
          "sentiment_score double, event_type string, event_severity double, directional_bias string, confidence_score double")
QUALITY = {"full_article": 1.0, "headline_plus_snippet": 0.75, "headline_only": 0.5}


def article(i, at, mode, warn, rel, sent, bias, event, sev, conf, ticker="INFY", provider="marketaux"):
    when = dt.datetime.fromisoformat(at)
    return (i, ticker, "NSE", when, None, provider, mode, QUALITY[mode], warn, rel, "neutral", sent, event, sev, bias, conf)


THREE = [
    article("a", "2026-03-09 08:45", "full_article", False, 1.0, 0.5, "bullish", "earnings", 0.7, 0.8),
    article("b", "2026-03-09 11:00", "headline_plus_snippet", True, 0.8, -0.2, "bearish", "lawsuit", 0.9, 0.5),
    article("c", "2026-03-10 08:00", "headline_only", True, 0.4, 0.1, "neutral", "other", 0.3, 0.6),
]


@pytest.fixture(scope="module")
def golden(spark, calendar):
    out = N.build_news_features(spark.createDataFrame(THREE, SCHEMA), calendar)
    return {(r["date"].isoformat(), r["prediction_mode"]): r for r in rows(out)}


@pytest.mark.parametrize("at, phase, market, pre, after", [
    ("2026-03-10 08:30", "pre_market", "2026-03-10", "2026-03-10", "2026-03-12"),
    ("2026-03-10 10:30", "intraday", "2026-03-10", "2026-03-12", "2026-03-12"),
    ("2026-03-10 16:15", "after_close", "2026-03-12", "2026-03-12", "2026-03-12"),
    ("2026-03-14 10:00", "non_trading", "2026-03-16", "2026-03-16", "2026-03-17"),
    ("2026-03-11 11:00", "non_trading", "2026-03-12", "2026-03-12", "2026-03-13"),
])
def test_target_dates(spark, calendar, at, phase, market, pre, after):
    df = spark.createDataFrame([article("x", at, "full_article", False, 1.0, 0.0, "neutral", "other", 0.0, 1.0)], SCHEMA)
    r = rows(N.article_times(df, calendar))[0]
    assert (r["market_phase"], str(r["market_date"]), str(r["pre_market_target_date"]), str(r["after_close_target_date"])) == (
        phase, market, pre, after)


def test_utc_time_is_used_without_a_local_one(spark, calendar):
    df = spark.createDataFrame([THREE[0]], SCHEMA).withColumns({
        "published_at_utc": F.lit("2026-03-10 03:00:00").cast("timestamp"), "published_at_ist": F.lit(None).cast("timestamp")})
    assert rows(N.article_times(df, calendar))[0]["market_phase"] == "pre_market"


def test_article_weight(spark):
    df = spark.createDataFrame([article("x", "2026-03-10 08:30", "headline_plus_snippet", False, 0.8, 0.0, "neutral", "other", 0.0, 0.25)], SCHEMA)
    assert rows(N.article_weights(df))[0]["article_weight"] == pytest.approx(0.15)
    assert rows(N.article_weights(df, NewsSettings(use_confidence=False)))[0]["article_weight"] == pytest.approx(0.6)
    other = rows(N.article_weights(df.withColumn("provider", F.lit("nse_rss"))))[0]
    assert other["source_quality_weight"] == 0.85


def test_pre_market_golden(golden):
    r = golden["2026-03-10", "pre_market"]
    want = {
        "news_article_count": 2, "news_avg_sentiment": -0.05, "news_max_severity": 0.9, "news_avg_relevance": 0.6,
        "news_avg_confidence": 0.55, "news_fallback_article_ratio": 1.0, "news_avg_content_quality_score": 0.625,
        "news_weighted_relevance_score": 0.64, "news_weighted_confidence_score": 0.54,
        "news_weighted_sentiment_score": -0.1142857, "news_weighted_bearish_score": 0.7142857}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    assert r["news_signal_state"] == "fallback_heavy"


def test_after_close_golden(golden):
    r = golden["2026-03-10", "after_close"]
    want = {
        "news_article_count": 2, "news_fallback_article_ratio": 0.5, "news_avg_content_quality_score": 0.875,
        "news_weighted_relevance_score": 0.9142857, "news_weighted_confidence_score": 0.6714286,
        "news_weighted_sentiment_score": 0.3090909, "news_weighted_bullish_score": 0.7272727,
        "news_weighted_bearish_score": 0.2727273}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    assert r["news_signal_state"] == "fresh_news"


def test_lineage(spark, calendar):
    enriched = N.enrich_articles(spark.createDataFrame(THREE, SCHEMA), calendar)
    found = {}
    for r in rows(N.row_lineage(enriched), "published_at_market", "article_id"):
        found.setdefault((str(r["date"]), r["prediction_mode"]), []).append(r["article_id"])
    assert found["2026-03-10", "pre_market"] == ["b", "c"]
    assert found["2026-03-10", "after_close"] == ["a", "b"]


def _written_rule(zero, values, carry_days, decay):
    """The row-by-row rule, applied in place."""
    zero, carried, values = list(zero), [0] * len(zero), list(values)
    for pos in range(len(zero)):
        if not zero[pos]:
            continue
        for back in range(1, carry_days + 1):
            prior = pos - back
            if prior < 0:
                break
            if zero[prior] and not carried[prior]:
                continue
            values[pos] = values[prior] * decay**back
            zero[pos], carried[pos] = 0, 1
            break
    return zero, carried, values


def test_carry_forward_equals_written_rule(spark, calendar):
    rng = random.Random(11)
    made, want = [], {}
    days = [r["date"] for r in rows(calendar.where("is_session and date >= '2026-01-01'").limit(40), "date")]
    for k in range(30):
        zero = [int(rng.random() < 0.6) for _ in days]
        vals = [0.0 if z else round(rng.uniform(-1, 1), 3) for z in zero]
        want[f"T{k}"] = _written_rule(zero, vals, 2, 0.7)
        made += [(d, f"T{k}", "NSE", "pre_market", z, v) for d, z, v in zip(days, zero, vals)]
    grid = spark.createDataFrame(made, "date date, ticker string, exchange string, prediction_mode string, news_zero_flag long, v double")
    grid = grid.withColumns({c: F.lit(0).cast("long") for c in (
        "news_carried_flag", "has_news_signal", "carried_forward_signal", "is_carried_forward")})
    grid = grid.withColumns({c: F.col("v") for c in N.DECAYED_COLUMNS})
    out = N.carry_forward(grid).select("ticker", "date", "news_zero_flag", "news_carried_flag", "news_avg_sentiment")
    for t, (zero, carried, values) in want.items():
        got = rows(out.where(F.col("ticker") == t), "date")
        assert [r["news_zero_flag"] for r in got] == zero
        assert [r["news_carried_flag"] for r in got] == carried
        assert [r["news_avg_sentiment"] for r in got] == pytest.approx(values)


def test_carry_cap(spark, calendar):
    made = [article("a", "2026-03-02 08:00", "full_article", False, 1.0, 0.5, "bullish", "earnings", 0.7, 0.8),
            article("b", "2026-03-16 08:00", "full_article", False, 1.0, 0.5, "bullish", "earnings", 0.7, 0.8)]
    df = spark.createDataFrame(made, SCHEMA)
    free = rows(N.build_news_features(df, calendar).where("prediction_mode = 'pre_market'"), "date")
    capped = rows(N.build_news_features(df, calendar, NewsSettings(max_carry_sessions=2)).where("prediction_mode = 'pre_market'"), "date")
    assert [r["news_carried_flag"] for r in free] == [0] + [1] * (len(free) - 3) + [0, 1]
    assert [r["news_carried_flag"] for r in capped][:5] == [0, 1, 1, 0, 0]
    assert free[2]["news_avg_sentiment"] == pytest.approx(0.5 * 0.49)
    assert free[2]["news_sentiment_dispersion_1d"] == 0.0


def test_contract_is_clean_on_built_features(spark, calendar):
    found = rows(N.news_feature_contract(N.build_news_features(spark.createDataFrame(THREE, SCHEMA), calendar)))
    assert all(r["violations"] == 0 for r in found)


def test_live_lags_equal_batch_lags(spark, calendar):
    rng = random.Random(5)
    made = [article(f"n{i}", f"2026-03-{rng.randint(2, 28):02d} {rng.randint(7, 18):02d}:10", "full_article", False,
                    1.0, rng.uniform(-1, 1), "neutral", "other", 0.1, 0.9, ticker=rng.choice(["A", "B"])) for i in range(60)]
    news = N.build_news_features(spark.createDataFrame(made, SCHEMA), calendar)
    cols = ["news_avg_sentiment", "news_article_count"]
    batch = {(r["ticker"], r["prediction_mode"], r["prediction_date"]): r for r in rows(G.with_lags(
        news.withColumnRenamed("date", "prediction_date"), tuple(cols), (1, 2), ("ticker", "exchange", "prediction_mode"),
        "prediction_date", fill=0.0))}
    wins = news.select("ticker", "exchange", "prediction_mode", F.col("date").alias("prediction_date"))
    for r in rows(W.live_news_lags(wins, news, cols, (1, 2))):
        want = batch[r["ticker"], r["prediction_mode"], r["prediction_date"]]
        for c in cols:
            for k in (1, 2):
                assert r[f"{c}_lag{k}"] == pytest.approx(want[f"{c}_lag{k}"])
