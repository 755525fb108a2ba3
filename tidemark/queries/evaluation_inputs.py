"""Predictions derived from bar keys, in Spark and in SQL.

Probabilities, labels and news context are integer functions of the bar's volume, day and
instrument, so both engines hold identical inputs for the metric operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import MERGE_KEYS
from tidemark.operators.price_features import LABEL
from tidemark.queries import inputs as I
from tidemark.queries.oracle import cte
from tidemark.settings import KEYS, MODES


def _keyed(spark, sf) -> DataFrame:
    """Bars with the shared key `h` and the split; prediction date is the next session."""
    day = F.datediff("date", F.lit("1995-01-01").cast("date")).cast("long")
    number = F.substring("ticker", 2, 9).cast("long")
    cal = I.calendar(spark).select("exchange", "date", "next_session")
    bars = I.bars(spark, sf).join(F.broadcast(cal), ["exchange", "date"])
    return bars.select(
        *KEYS, F.col("date").alias("historical_date"), F.col("next_session").alias("prediction_date"),
        (F.col("volume").cast("long") * 7919 + day * 104729 + number * 1299709).alias("h"),
        F.when(day % 20 < 14, "train").when(day % 20 < 17, "validation").otherwise("test").alias("split"),
    ).withColumn(LABEL, (F.floor(F.col("h") / 17) % 2).cast("int"))


def _share(x, divisor: int):
    return (F.floor(x / divisor) % 1000) / 1000.0


def baseline_predictions(spark, sf) -> DataFrame:
    h = F.col("h")
    return _keyed(spark, sf).select(
        "split", F.col("historical_date").alias("date"), F.col("prediction_date").alias("target_date"), *KEYS, LABEL,
        _share(h, 1).alias("raw_predicted_probability_up"),
        _share(h, 7).alias("calibrated_predicted_probability_up"),
        (_share(h, 7) >= 0.5).cast("int").alias("predicted_next_day_direction"),
        (((h % 41) - 20) / 1000.0).alias("ret_1d"),
    )


def enhanced_predictions(spark, sf) -> DataFrame:
    modes = F.array(*[
        F.struct(F.lit(m).alias("prediction_mode"), F.lit(i * 15485863).cast("long").alias("_off"))
        for i, m in enumerate(MODES)])
    rows = _keyed(spark, sf).withColumn("_m", F.explode(modes)).select("*", "_m.*")
    rows = rows.withColumn("x", F.col("h") + F.col("_off"))
    x = F.col("x")
    count = x % 4
    ratio = (F.floor(x / 5) % 5) / 4.0
    return rows.select(
        "split", "historical_date", "prediction_date", *KEYS, "prediction_mode", LABEL,
        _share(x, 11).alias("raw_predicted_probability_up"),
        _share(x, 13).alias("calibrated_predicted_probability_up"),
        (_share(x, 13) >= 0.5).cast("int").alias("predicted_next_day_direction"),
        count.alias("news_article_count"),
        ratio.alias("news_fallback_article_ratio"),
        (x % 2).alias("news_warning_article_count"),
        ((F.floor(x / 19) % 201 - 100) / 100.0).alias("news_weighted_sentiment_score"),
        ((F.floor(x / 3) % 10) / 10.0).alias("news_avg_confidence"),
        (count > 0).cast("long").alias("has_fresh_news"),
        ((count == 0) & (F.floor(x / 23) % 2 == 0)).cast("long").alias("is_carried_forward"),
        ((count > 0) & (ratio > 0.5)).cast("long").alias("is_fallback_heavy"),
        (((F.col("h") % 41) - 20) / 1000.0).alias("ret_1d"),
        "x",
    )


def ablation_columns(test: DataFrame, divisors: dict[str, int]) -> DataFrame:
    """Scores of the given ablation variants for the test rows, side by side."""
    x = F.col("x")
    columns = {}
    for name, divisor in divisors.items():
        columns[f"{name}_raw_predicted_probability_up"] = _share(x, divisor)
        columns[f"{name}_predicted_probability_up"] = _share(x, divisor + 2)
        columns[f"{name}_predicted_next_day_direction"] = (_share(x, divisor + 2) >= 0.5).cast("int")
    return test.select(*MERGE_KEYS, *[c.alias(n) for n, c in columns.items()])


cte("keyed", """
SELECT b.ticker, b.exchange, b.date AS historical_date, c.next_session AS prediction_date,
       CAST(b.volume AS BIGINT) * 7919 + date_diff('day', DATE '1995-01-01', b.date) * 104729
         + CAST(substr(b.ticker, 2) AS BIGINT) * 1299709 AS h,
       date_diff('day', DATE '1995-01-01', b.date) % 20 AS slot
FROM bars b JOIN cal c ON c.date = b.date""")
cte("base_pred", """
SELECT ticker, exchange, historical_date, prediction_date, h,
       CASE WHEN slot < 14 THEN 'train' WHEN slot < 17 THEN 'validation' ELSE 'test' END AS split,
       CAST((h // 17) % 2 AS INTEGER) AS y, (h % 1000) / 1000.0::DOUBLE AS raw_b, ((h // 7) % 1000) / 1000.0::DOUBLE AS cal_b,
       ((h % 41) - 20) / 1000.0::DOUBLE AS ret_1d
FROM keyed""")
cte("enh_x", """
SELECT *, h AS x, 'pre_market' AS prediction_mode FROM base_pred
UNION ALL SELECT *, h + 15485863 AS x, 'after_close' AS prediction_mode FROM base_pred""")
cte("enh_pred", """
SELECT *, ((x // 11) % 1000) / 1000.0::DOUBLE AS raw_e, ((x // 13) % 1000) / 1000.0::DOUBLE AS cal_e,
       x % 4 AS news_article_count, ((x // 5) % 5) / 4.0::DOUBLE AS news_fallback_article_ratio, x % 2 AS news_warning_article_count,
       ((x // 19) % 201 - 100) / 100.0::DOUBLE AS news_weighted_sentiment_score, ((x // 3) % 10) / 10.0::DOUBLE AS news_avg_confidence,
       CAST(x % 4 > 0 AS BIGINT) AS has_fresh_news,
       CAST(x % 4 = 0 AND (x // 23) % 2 = 0 AS BIGINT) AS is_carried_forward,
       CAST(x % 4 > 0 AND ((x // 5) % 5) / 4.0::DOUBLE > 0.5 AS BIGINT) AS is_fallback_heavy
FROM enh_x""")
# News weight, blend, state, quality and decision of the held-out rows.
cte("ev_weight", """
SELECT *, CASE WHEN news_article_count = 0 AND is_carried_forward = 0 THEN 0.0::DOUBLE ELSE
  least(greatest((CASE WHEN has_fresh_news = 1 THEN 0.8::DOUBLE WHEN is_carried_forward = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
    * news_avg_confidence * (CASE WHEN is_fallback_heavy = 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)
    * (0.4::DOUBLE + 0.6::DOUBLE * least(news_article_count / 3.0::DOUBLE, 1.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE) END AS w
FROM enh_pred""")
cte("ev_blend", """
SELECT *, (1 - w) * raw_b + w * raw_e AS raw_x, (1 - w) * cal_b + w * cal_e AS cal_x,
       CASE WHEN is_fallback_heavy = 1 THEN 'fallback_heavy' WHEN has_fresh_news = 1 THEN 'fresh_news'
            WHEN is_carried_forward = 1 THEN 'carried_forward_only' WHEN news_article_count > 0 THEN 'fresh_news' ELSE 'zero_news' END AS state
FROM ev_weight""")
cte("ev_quality", """
SELECT *, 100.0::DOUBLE AS q_market,
       100 - CASE WHEN news_article_count = 0 THEN 60 WHEN news_article_count = 1 THEN 20 ELSE 0 END AS q_source,
       85 - CASE WHEN news_avg_confidence < 0.55 THEN 15 ELSE 0 END AS q_extract,
       100 - CASE state WHEN 'fallback_heavy' THEN 55 WHEN 'carried_forward_only' THEN 25 WHEN 'zero_news' THEN 40 ELSE 0 END AS q_state
FROM ev_blend""")
cte("ev_scored", """
SELECT *, round_even(q_market * 0.25::DOUBLE + q_source * 0.30::DOUBLE + q_extract * 0.20::DOUBLE + q_state * 0.25::DOUBLE, 1) AS quality,
       abs(cal_x - 0.5) AS margin,
       CASE state WHEN 'carried_forward_only' THEN 0.05::DOUBLE + 0.02::DOUBLE WHEN 'zero_news' THEN 0.05::DOUBLE + 0.05::DOUBLE
                  WHEN 'fallback_heavy' THEN 0.05::DOUBLE + 0.05::DOUBLE ELSE 0.05::DOUBLE END AS required
FROM ev_quality""")
cte("ev_decided", """
SELECT *, CASE WHEN quality >= 90 THEN 'A' WHEN quality >= 80 THEN 'B' WHEN quality >= 70 THEN 'C' WHEN quality >= 60 THEN 'D'
               WHEN quality >= 50 THEN 'E' ELSE 'F' END AS grade,
       concat_ws(',', CASE WHEN state = 'fallback_heavy' THEN 'fallback_heavy' END,
                      CASE WHEN quality < 55 THEN 'data_quality_below_floor' END,
                      CASE WHEN margin < required THEN 'low_conviction_margin' END,
                      CASE WHEN margin < required AND state IN ('carried_forward_only', 'zero_news') THEN state END) AS reasons
FROM ev_scored""")
cte("evaluated", """
SELECT *, reasons <> '' AS abstain, CASE WHEN reasons <> '' THEN 'abstain' WHEN cal_x >= 0.5 THEN 'up' ELSE 'down' END AS action,
       margin >= greatest(required, 0.10::DOUBLE) AS confident, CAST(cal_x >= 0.5 AS INTEGER) AS pred_x,
       CAST(cal_b >= 0.5 AS INTEGER) AS pred_b, CAST(cal_e >= 0.5 AS INTEGER) AS pred_e
FROM ev_decided""")
