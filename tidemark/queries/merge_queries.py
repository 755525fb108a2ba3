"""Merged training table: mode expansion, news join, lags, crosses, splits, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import merge as G
from tidemark.operators import news_features as N
from tidemark.operators import price_features as P
from tidemark.operators.metrics import balanced_weights
from tidemark.queries import evaluation_inputs as E
from tidemark.queries import inputs as I
from tidemark.queries import news_queries as NQ
from tidemark.queries import price_queries as PQ
from tidemark.queries.inputs import r
from tidemark.queries.oracle import cte, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, MODES, ModelSettings, PriceSettings

SPEC = G.default_spec()
CROSSES = tuple(i.name for i in SPEC.crosses)
ID = ", ".join(G.MERGE_KEYS)


def price_rows(spark, sf):
    return P.build_price_features(PQ.aligned(spark, sf), I.calendar(spark), PQ.S)


def merged(spark, sf):
    return G.build_merged(price_rows(spark, sf), NQ.features(spark, sf), SPEC)


_news = ", ".join(f"CAST(coalesce(n.{c}, 0) AS DOUBLE) AS {c}" for c in N.NEWS_COLUMNS)
_price = ", ".join(f"p.{c}" for c in PriceSettings().feature_columns)
cte("merged_raw", f"""
SELECT p.date AS historical_date, p.target_date AS prediction_date, p.ticker, p.exchange, m.prediction_mode, p.close, p.volume,
       p.target_next_day_direction, coalesce(n.news_signal_state, 'zero_news') AS news_signal_state,
       n.date IS NULL AS news_missing, {_price}, {_news}
FROM price_features p CROSS JOIN (VALUES ('pre_market'), ('after_close')) m(prediction_mode)
LEFT JOIN news_features n ON n.date = p.target_date AND n.ticker = p.ticker AND n.exchange = p.exchange AND n.prediction_mode = m.prediction_mode""")
_wm = "(PARTITION BY ticker, exchange, prediction_mode ORDER BY prediction_date)"
_lag_cols = N.NEWS_COLUMNS
_lags = ", ".join(f"coalesce(lag({c}, {k}) OVER {_wm}, 0) AS {c}_lag{k}" for k in (1, 2) for c in _lag_cols)
_cross = {
    "cross_rsi_14_sentiment": "(rsi_14 - 50) * news_sentiment_3d",
    "cross_momentum_confidence": "ret_5d * news_weighted_confidence_score",
    "cross_company_sector_sentiment": "news_company_weighted_sentiment_score * news_sector_weighted_sentiment_score",
    "cross_macd_sentiment": "macd * news_sentiment_3d",
    "cross_price_vs_52w_high_sentiment": "price_vs_52w_high * news_sentiment_3d",
}
_crosses = ", ".join(f"{v} AS {k}" for k, v in _cross.items())
cte("merged", f"SELECT *, {_lags}, {_crosses} FROM merged_raw")
cte("merged_split", f"""
SELECT {ID}, target_next_day_direction, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
       WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER {_wm} AS rn, count(*) OVER (PARTITION BY ticker, exchange, prediction_mode) AS n FROM merged_raw)""")


@query("mode_expansion", "J3", """
SELECT p.date AS historical_date, p.target_date AS prediction_date, p.ticker, p.exchange, m.prediction_mode, p.close
FROM pf_rows p CROSS JOIN (VALUES ('pre_market'), ('after_close')) m(prediction_mode)""")
def mode_expansion(spark, sf):
    labelled = P.with_label(PQ.aligned(spark, sf), I.calendar(spark))
    return G.expand_modes(labelled).select(*G.MERGE_KEYS, "close")


_join_cols = N.NEWS_COLUMNS


@query("news_join", "J4", f"""
SELECT {ID}, news_signal_state, news_missing, {', '.join(f'{rnd(c)} AS {c}' for c in _join_cols)} FROM merged_raw""")
def news_join(spark, sf):
    joined = G.join_news(G.expand_modes(price_rows(spark, sf)), NQ.features(spark, sf))
    return joined.select(*G.MERGE_KEYS, N.STATE, "news_missing", *[r(c).alias(c) for c in _join_cols])


_lag_names = tuple(f"{c}_lag{k}" for k in (1, 2) for c in _lag_cols)


@query("news_lags_and_crosses", "W19 X21", f"""
SELECT {ID}, {', '.join(f'{rnd(c)} AS {c}' for c in _lag_names)}, {', '.join(f'{rnd(c, 4)} AS {c}' for c in CROSSES)} FROM merged""")
def news_lags_and_crosses(spark, sf):
    return merged(spark, sf).select(
        *G.MERGE_KEYS, *[r(c).alias(c) for c in _lag_names], *[r(c, 4).alias(c) for c in CROSSES])


@query("temporal_split", "W24 U6", f"""
SELECT {ID}, split FROM merged_split""")
def temporal_split(spark, sf):
    rows = G.expand_modes(price_rows(spark, sf))
    return G.split_merged(rows).select(*G.MERGE_KEYS, "split")


@query("evaluation_union", "U6", f"""
SELECT {ID}, split FROM merged_split WHERE split <> 'train'""")
def evaluation_union(spark, sf):
    rows = G.split_merged(G.expand_modes(price_rows(spark, sf)))
    return G.evaluation_rows(rows).select(*G.MERGE_KEYS, "split")


@query("split_summary", "M18", """
SELECT ticker, exchange, prediction_mode, split, count(*) AS row_count, min(prediction_date) AS date_start, max(prediction_date) AS date_end
FROM merged_split GROUP BY ALL""")
def split_summary(spark, sf):
    rows = G.split_merged(G.expand_modes(price_rows(spark, sf)))
    return G.split_summary(rows, "prediction_date", (*KEYS, "prediction_mode"))


@query("class_weights", "M2", f"""
SELECT ticker, historical_date, prediction_mode, {rnd('n / (2.0::DOUBLE * nc)')} AS class_weight FROM (
  SELECT *, count(*) OVER (PARTITION BY prediction_mode) AS n, count(*) OVER (PARTITION BY prediction_mode, y) AS nc
  FROM enh_pred WHERE split = 'train')""")
def class_weights(spark, sf):
    train = E.enhanced_predictions(spark, sf).where("split = 'train'")
    return balanced_weights(train, ["prediction_mode"], P.LABEL).select(
        "ticker", "historical_date", "prediction_mode", r("class_weight").alias("class_weight"))


@query("training_contract", "F6", """
SELECT rule, CASE rule WHEN 'invalid_volume' THEN (SELECT count(*) FROM pf_rows WHERE volume > 200)
                       WHEN 'non_binary_label' THEN (SELECT count(*) FROM pf_rows WHERE target_next_day_direction IS NULL)
                       WHEN 'invalid_close' THEN (SELECT count(*) FROM pf_rows WHERE close IS NULL)
                       WHEN 'non_finite_feature' THEN (SELECT count(*) FILTER (ret_1d IS NULL) + count(*) FILTER (ma_20 IS NULL)
                                                              + count(*) FILTER (macd_signal IS NULL) FROM pf_rows)
                       ELSE 0 END AS violations
FROM (SELECT unnest(['non_finite_feature', 'empty_key', 'invalid_close', 'invalid_volume', 'non_binary_label', 'duplicate_key']) AS rule)""")
def training_contract(spark, sf):
    """The contract on rows before the warm-up cut, with large volumes negated."""
    rows = PQ.rows(spark, sf).withColumn(
        "volume", F.when(F.col("volume") > 200, -F.col("volume")).otherwise(F.col("volume")))
    return G.training_contract(rows, ("date", *KEYS), ("ret_1d", "ma_20", "macd_signal"))


_TRAINING_RULES = ("non_finite_feature", "empty_key", "invalid_close", "invalid_volume", "non_binary_label", "duplicate_key")
_EXTRACTION_RULES = ("empty_article_id", "unsupported_sentiment_label", "unsupported_event_type", "invalid_confidence_score",
                     "out_of_range_sentiment_score", "invalid_warning_flag")


@query("observed_contracts", "J4 F4 F6", """
SELECT 'training' AS table_name, rule, CASE rule WHEN 'row_count' THEN (SELECT count(*) FROM pf_rows) + (SELECT count(*) FROM pf_rows WHERE volume > 200)
    WHEN 'invalid_volume' THEN 2 * (SELECT count(*) FROM pf_rows WHERE volume > 200)
    WHEN 'duplicate_key' THEN (SELECT count(*) FROM pf_rows WHERE volume > 200)
    WHEN 'non_binary_label' THEN (SELECT count(*) FILTER (target_next_day_direction IS NULL) + count(*) FILTER (target_next_day_direction IS NULL AND volume > 200) FROM pf_rows)
    WHEN 'invalid_close' THEN (SELECT count(*) FILTER (close IS NULL) + count(*) FILTER (close IS NULL AND volume > 200) FROM pf_rows)
    WHEN 'non_finite_feature' THEN (SELECT count(*) + count(*) FILTER (volume > 200) FROM pf_rows WHERE ret_1d IS NULL OR ma_20 IS NULL OR macd_signal IS NULL)
    ELSE 0 END AS violations
FROM (SELECT unnest(['row_count', 'non_finite_feature', 'empty_key', 'invalid_close', 'invalid_volume', 'non_binary_label', 'duplicate_key']) AS rule)
UNION ALL SELECT 'extractions', 'row_count', count(*) FROM extractions
UNION ALL SELECT 'extractions', 'empty_article_id', count(*) FILTER (k % 113 = 0) FROM extractions
UNION ALL SELECT 'extractions', 'unsupported_sentiment_label', count(*) FILTER (k % 103 = 0) FROM extractions
UNION ALL SELECT 'extractions', 'unsupported_event_type', count(*) FILTER (k % 109 = 0) FROM extractions
UNION ALL SELECT 'extractions', 'invalid_confidence_score', count(*) FILTER (k % 97 = 0) FROM extractions
UNION ALL SELECT 'extractions', 'out_of_range_sentiment_score', count(*) FILTER (k % 89 = 0) FROM extractions
UNION ALL SELECT 'extractions', 'invalid_warning_flag', count(*) FILTER (k % 101 = 0) FROM extractions""")
def observed_contracts(spark, sf):
    """Damaged training rows and articles pass through a write once; the rules are counted on the way."""
    damaged = PQ.rows(spark, sf).withColumn(
        "volume", F.when(F.col("volume") > 200, -F.col("volume")).otherwise(F.col("volume")))
    doubled = C.with_copies(damaged.unionByName(damaged.where("volume < 0")), ["date", *KEYS])
    rules = G.training_rules(("date", *KEYS), ("ret_1d", "ma_20", "macd_signal")) | {"duplicate_key": C.duplicate_rule()}
    training, seen = C.observed(doubled, rules)
    training.write.format("noop").mode("overwrite").save()
    norm, checks = N.extraction_rules(NQ._dirty(spark, sf))
    articles, counted = C.observed(norm, checks)
    articles.write.format("noop").mode("overwrite").save()
    shown = {k: v for k, v in counted.get.items() if k in ("row_count", *_EXTRACTION_RULES)}
    return C.as_rows(damaged, seen.get, "training").unionByName(C.as_rows(damaged, shown, "extractions"))
