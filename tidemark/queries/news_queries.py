"""News feature stage: timing, weights, aggregates, grid, rolling, carry-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import news_features as N
from tidemark.queries import inputs as I
from tidemark.queries.inputs import r
from tidemark.queries.oracle import case_map, cte, in_list, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, NewsSettings

S = NewsSettings()
KEY = ("ticker", "exchange", "date", "prediction_mode")


def enriched(spark, sf):
    return N.enrich_articles(I.extractions(spark, sf), I.calendar(spark), S, I.MARKET)


def features(spark, sf, settings=S):
    return N.build_news_features(I.extractions(spark, sf), I.calendar(spark), settings, I.MARKET)


def spark_news(columns) -> list:
    return [F.col(c) if c in N.COUNT_COLUMNS else r(c).alias(c) for c in columns]


def sql_news(columns) -> str:
    return ", ".join(c if c in N.COUNT_COLUMNS else f"{rnd(c)} AS {c}" for c in columns)


cte("art_local", """
SELECT *, published_at_utc + INTERVAL 330 MINUTE AS published_at_market FROM extractions""")
cte("art_timed", """
SELECT a.*, CASE WHEN NOT c.is_session THEN 'non_trading'
                 WHEN strftime(published_at_market, '%H:%M:%S') < '09:15:00' THEN 'pre_market'
                 WHEN strftime(published_at_market, '%H:%M:%S') < '15:30:00' THEN 'intraday' ELSE 'after_close' END AS market_phase,
       c.is_session, c.date AS local_date, c.next_session, c.second_session AS after_close_target_date
FROM art_local a LEFT JOIN cal c ON c.date = CAST(published_at_market AS DATE)""")
cte("art_weighted", f"""
SELECT *, CASE WHEN is_session AND market_phase IN ('pre_market', 'intraday') THEN local_date ELSE next_session END AS market_date,
       CASE WHEN is_session AND market_phase = 'pre_market' THEN local_date ELSE next_session END AS pre_market_target_date,
       CAST(CASE extraction_mode WHEN 'full_article' THEN 1.0 WHEN 'headline_plus_snippet' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS quality_weight,
       CAST({case_map(V.SOURCE_WEIGHTS, 'provider', '0.85')} AS DOUBLE) AS source_quality_weight,
       CASE WHEN event_type IN ({in_list(V.SECTOR_EVENTS)}) THEN 'sector'
            WHEN event_type IN ({in_list(V.MACRO_EVENTS)}) THEN 'macro' ELSE 'company' END AS channel
FROM art_timed""")
cte("art", "SELECT *, quality_weight * source_quality_weight * relevance_score * confidence_score AS article_weight FROM art_weighted")
cte("art_mode", """
SELECT *, 'pre_market' AS prediction_mode, pre_market_target_date AS date FROM art
UNION ALL SELECT *, 'after_close' AS prediction_mode, after_close_target_date AS date FROM art""")


def _wmean(v: str, w: str) -> str:
    return f"CASE WHEN sum({w}) > 0 THEN sum(({v}) * ({w})) / sum({w}) ELSE 0 END"


_bias = {b: f"count(*) FILTER (directional_bias = '{b}')" for b in V.BIASES}
_agg = {
    "news_article_count": "count(*)",
    "news_sentiment_dispersion_1d": "CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_pop(sentiment_score) END",
    "news_directional_agreement_rate": f"greatest({', '.join(_bias.values())}) / count(*)",
    "news_avg_sentiment": "avg(sentiment_score)",
    "news_max_severity": "max(event_severity)",
    "news_avg_relevance": "avg(relevance_score)",
    "news_avg_confidence": "avg(confidence_score)",
    "news_bullish_article_count": _bias["bullish"],
    "news_bearish_article_count": _bias["bearish"],
    "news_neutral_article_count": _bias["neutral"],
    "news_full_article_count": "count(*) FILTER (extraction_mode = 'full_article')",
    "news_headline_plus_snippet_count": "count(*) FILTER (extraction_mode = 'headline_plus_snippet')",
    "news_headline_only_count": "count(*) FILTER (extraction_mode = 'headline_only')",
    "news_warning_article_count": "count(*) FILTER (warning_flag)",
    "news_fallback_article_ratio": "count(*) FILTER (extraction_mode <> 'full_article') / count(*)",
    "news_avg_content_quality_score": "avg(content_quality_score)",
    "news_avg_source_quality_score": "avg(source_quality_weight)",
    "news_weighted_sentiment_score": _wmean("sentiment_score", "article_weight"),
    "news_weighted_relevance_score": _wmean("relevance_score", "quality_weight"),
    "news_weighted_confidence_score": _wmean("confidence_score", "quality_weight"),
    "news_weighted_source_quality_score": _wmean("source_quality_weight", "article_weight"),
    "news_weighted_bullish_score": _wmean("CASE WHEN directional_bias = 'bullish' THEN 1 ELSE 0 END", "article_weight"),
    "news_weighted_bearish_score": _wmean("CASE WHEN directional_bias = 'bearish' THEN 1 ELSE 0 END", "article_weight"),
}
for _c in V.CHANNELS:
    _f = f"FILTER (channel = '{_c}')"
    _agg |= {
        f"news_{_c}_article_count": f"count(*) {_f}",
        f"news_{_c}_article_share": f"count(*) {_f} / count(*)",
        f"news_{_c}_avg_sentiment": f"coalesce(avg(sentiment_score) {_f}, 0)",
        f"news_{_c}_weighted_sentiment_score":
            f"CASE WHEN sum(article_weight) {_f} > 0 THEN sum(sentiment_score * article_weight) {_f} / sum(article_weight) {_f} ELSE 0 END",
        f"news_{_c}_max_severity": f"coalesce(max(event_severity) {_f}, 0)",
    }
for _e in V.EVENT_TYPES:
    _agg[f"news_event_count_{_e}"] = f"count(*) FILTER (event_type = '{_e}')"
AGG_COLUMNS = tuple(_agg)
cte("news_agg", f"""
SELECT ticker, exchange, date, prediction_mode, {', '.join(f'{v} AS {k}' for k, v in _agg.items())}
FROM art_mode GROUP BY ticker, exchange, date, prediction_mode""")
cte("news_span", "SELECT ticker, exchange, min(date) AS a, max(date) AS b FROM news_agg GROUP BY ticker, exchange")
_zero = ", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in AGG_COLUMNS)
cte("news_grid", f"""
SELECT s.ticker, s.exchange, c.date, m.prediction_mode, {_zero},
       CAST(CASE WHEN g.date IS NULL THEN 1 ELSE 0 END AS BIGINT) AS zero_flag,
       CAST(coalesce(g.news_fallback_article_ratio, 0) > 0.5 AS BIGINT) AS is_fallback_heavy
FROM news_span s JOIN cal c ON c.is_session AND c.date BETWEEN s.a AND s.b
CROSS JOIN (VALUES ('pre_market'), ('after_close')) m(prediction_mode)
LEFT JOIN news_agg g ON g.ticker = s.ticker AND g.date = c.date AND g.prediction_mode = m.prediction_mode""")
_WM = "PARTITION BY ticker, exchange, prediction_mode ORDER BY date"
_events = " + ".join(f"news_event_count_{e}" for e in V.EVENT_TYPES)


def _ema(span: int) -> str:
    return (f"list_reduce(list(news_weighted_sentiment_score) OVER ({_WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"lambda acc, x: acc + (2.0::DOUBLE / {span + 1}) * (x - acc))")


_roll = ", ".join(
    f"CAST(sum(news_article_count) OVER ({_WM} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) AS news_volume_{k}d, "
    f"CAST(sum({_events}) OVER ({_WM} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) AS news_event_count_{k}d"
    for k in (1, 3, 5))
cte("news_rolled", f"""
SELECT *, {_roll}, news_weighted_sentiment_score AS news_sentiment_1d, {_ema(3)} AS news_sentiment_3d, {_ema(5)} AS news_sentiment_5d,
       row_number() OVER ({_WM}) AS rn FROM news_grid""")
cte("news_source", f"""
SELECT *, max(CASE WHEN zero_flag = 0 THEN rn END) OVER ({_WM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS src
FROM news_rolled""")
# Decay by joining each zero row to the last row with news of its own mode.
_decayed = set(N.DECAYED_COLUMNS)
_cols = ", ".join(
    f"CASE WHEN z.carried = 1 THEN f.{c} * pow(0.7::DOUBLE, z.rn - z.src) ELSE z.{c} END AS {c}" if c in _decayed else f"z.{c}"
    for c in (*AGG_COLUMNS, *N.ROLLING_COLUMNS))
cte("news_features", f"""
SELECT z.ticker, z.exchange, z.date, z.prediction_mode, {_cols},
       CASE WHEN z.carried = 1 THEN 0 ELSE z.zero_flag END AS news_zero_flag, z.carried AS news_carried_flag,
       CAST(CASE WHEN z.carried = 1 OR z.zero_flag = 0 THEN 1 ELSE 0 END AS BIGINT) AS has_news_signal,
       z.carried AS carried_forward_signal, z.is_fallback_heavy AS degraded_news_context,
       1 - z.zero_flag AS has_fresh_news, z.carried AS is_carried_forward, z.is_fallback_heavy,
       CASE WHEN z.is_fallback_heavy = 1 THEN 'fallback_heavy' WHEN z.zero_flag = 0 THEN 'fresh_news'
            WHEN z.carried = 1 THEN 'carried_forward_only' ELSE 'zero_news' END AS news_signal_state
FROM (SELECT *, CAST(zero_flag = 1 AND src IS NOT NULL AS BIGINT) AS carried FROM news_source) z
LEFT JOIN news_rolled f ON f.ticker = z.ticker AND f.exchange = z.exchange AND f.prediction_mode = z.prediction_mode AND f.rn = z.src""")


@query("news_article_times", "X14", """
SELECT article_id, ticker, published_at_market, market_phase, market_date, pre_market_target_date, after_close_target_date FROM art""")
def news_article_times(spark, sf):
    return N.article_times(I.extractions(spark, sf), I.calendar(spark), I.MARKET).select(
        "article_id", "ticker", I.ntz("published_at_market").alias("published_at_market"), "market_phase", "market_date",
        "pre_market_target_date", "after_close_target_date")


@query("news_article_weights", "X15", f"""
SELECT article_id, quality_weight, source_quality_weight, {rnd('article_weight')} AS article_weight, channel FROM art""")
def news_article_weights(spark, sf):
    return N.article_weights(I.extractions(spark, sf), S).select(
        "article_id", "quality_weight", "source_quality_weight", r("article_weight").alias("article_weight"), "channel")


@query("news_session_aggregates", "A1 A2 A3 A4 A5 A6", f"""
SELECT ticker, exchange, date, prediction_mode, {sql_news(AGG_COLUMNS)} FROM news_agg""")
def news_session_aggregates(spark, sf):
    return N.aggregate_articles(enriched(spark, sf), S).select(*KEY, *spark_news(AGG_COLUMNS))


@query("news_row_lineage", "A7", """
SELECT ticker, exchange, date, prediction_mode, published_at_market, article_id FROM art_mode""")
def news_row_lineage(spark, sf):
    return N.row_lineage(enriched(spark, sf)).select(
        *KEY, I.ntz("published_at_market").alias("published_at_market"), "article_id")


@query("news_dense_grid", "J7", """
SELECT ticker, exchange, date, prediction_mode, news_article_count, zero_flag AS news_zero_flag FROM news_grid""")
def news_dense_grid(spark, sf):
    grouped = N.aggregate_articles(enriched(spark, sf), S)
    return N.dense_grid(grouped, I.calendar(spark)).select(*KEY, "news_article_count", "news_zero_flag")


@query("news_rolling", "W16 W17", f"""
SELECT ticker, exchange, date, prediction_mode, {sql_news(N.ROLLING_COLUMNS)} FROM news_rolled""")
def news_rolling(spark, sf):
    grouped = N.aggregate_articles(enriched(spark, sf), S)
    return N.rolling_news(N.dense_grid(grouped, I.calendar(spark))).select(*KEY, *spark_news(N.ROLLING_COLUMNS))


@query("news_carry_forward", "W18 X16", f"""
SELECT ticker, exchange, date, prediction_mode, news_signal_state, news_zero_flag, news_carried_flag,
       {sql_news(('news_avg_sentiment', 'news_max_severity', 'news_weighted_sentiment_score', 'news_avg_confidence'))} FROM news_features""")
def news_carry_forward(spark, sf):
    return features(spark, sf).select(*KEY, N.STATE, "news_zero_flag", "news_carried_flag", *spark_news(
        ("news_avg_sentiment", "news_max_severity", "news_weighted_sentiment_score", "news_avg_confidence")))


@query("news_features", "A1 A2 A3 A4 A5 A6 J7 W16 W17 W18 X14 X15 X16", f"""
SELECT ticker, exchange, date, prediction_mode, news_signal_state, {sql_news(N.NEWS_COLUMNS)} FROM news_features""")
def news_features(spark, sf):
    return features(spark, sf).select(*KEY, N.STATE, *spark_news(N.NEWS_COLUMNS))


def _dirty(spark, sf):
    """Scored articles with defects on fixed key residues, repeated ids included."""
    k = F.col("k")
    base = I.extractions(spark, sf).withColumns({
        "article_id": F.when(k % 113 == 0, "").when(k % 107 == 0, "dup").otherwise(F.col("article_id")),
        "sentiment_label": F.when(k % 103 == 0, "mixed").otherwise(F.initcap("sentiment_label")),
        "event_type": F.when(k % 109 == 0, "rumour").otherwise(F.regexp_replace("event_type", "_", " ")),
        "confidence_score": F.when(k % 97 == 0, "high").otherwise(F.col("confidence_score").cast("string")),
        "sentiment_score": F.when(k % 89 == 0, 1.5).otherwise(F.col("sentiment_score")),
        "warning_flag": F.when(k % 101 == 0, "maybe").when(F.col("warning_flag"), "Yes").otherwise("0"),
    })
    return base


_rules_zero = ("unsupported_directional_bias", "unsupported_extraction_mode", "invalid_content_quality_score",
               "out_of_range_content_quality_score", "invalid_relevance_score", "out_of_range_relevance_score",
               "invalid_sentiment_score", "invalid_event_severity", "out_of_range_event_severity",
               "out_of_range_confidence_score")
_n = "SELECT '{rule}' AS rule, count(*) FILTER ({cond}) AS violations FROM extractions"


@query("extraction_contract", "F4", " UNION ALL ".join(
    [_n.format(rule=rule, cond="false") for rule in _rules_zero] + [
        _n.format(rule="empty_article_id", cond="k % 113 = 0"),
        _n.format(rule="unsupported_sentiment_label", cond="k % 103 = 0"),
        _n.format(rule="unsupported_event_type", cond="k % 109 = 0"),
        _n.format(rule="invalid_confidence_score", cond="k % 97 = 0"),
        _n.format(rule="out_of_range_sentiment_score", cond="k % 89 = 0"),
        _n.format(rule="invalid_warning_flag", cond="k % 101 = 0"),
        """SELECT 'duplicate_article_id' AS rule, count(*) - count(DISTINCT CASE WHEN k % 113 = 0 THEN '' WHEN k % 107 = 0 THEN 'dup'
           ELSE article_id END) AS violations FROM extractions"""]))
def extraction_contract(spark, sf):
    return N.extraction_contract(_dirty(spark, sf))


_rule_names = (["empty_identity", "unsupported_mode", "unsupported_state", "duplicate_identity"]
               + [f"invalid_{c}" for c in (*N.COUNT_COLUMNS, *N.FLOAT_COLUMNS)])


@query("news_feature_contract", "F5", f"""
SELECT u.rule, CASE u.rule WHEN 'unsupported_mode' THEN (SELECT count(*) FROM news_agg WHERE prediction_mode = 'after_close')
  WHEN 'invalid_news_avg_sentiment' THEN (SELECT count(*) FROM news_agg WHERE news_avg_sentiment > 0.5)
  WHEN 'invalid_news_article_count' THEN (SELECT count(*) FROM news_agg WHERE news_article_count = 2)
  ELSE 0 END AS violations
FROM (SELECT unnest([{in_list(_rule_names)}]) AS rule) u""")
def news_feature_contract(spark, sf):
    """The contract on the sessions with news, with three kinds of damage."""
    rows = features(spark, sf).where("has_fresh_news = 1").withColumns({
        "prediction_mode": F.when(F.col("prediction_mode") == "after_close", "evening").otherwise(F.col("prediction_mode")),
        "news_article_count": F.when(F.col("news_article_count") == 2, 1.5).otherwise(F.col("news_article_count")),
        "news_avg_sentiment": F.when(F.col("news_avg_sentiment") > 0.5, 7.0).otherwise(F.col("news_avg_sentiment")),
    })
    return N.news_feature_contract(rows)


@query("news_feature_summary", "A10", """
SELECT ticker, exchange, count(*) AS output_row_count, count(*) FILTER (news_article_count = 0) AS zero_news_row_count,
       count(*) FILTER (news_article_count > 0) AS nonzero_news_row_count, CAST(sum(news_carried_flag) AS BIGINT) AS carried_row_count,
       min(date) AS coverage_start, max(date) AS coverage_end,
       count(*) FILTER (prediction_mode = 'pre_market') AS pre_market_row_count,
       count(*) FILTER (prediction_mode = 'after_close') AS after_close_row_count,
       count(*) FILTER (news_signal_state = 'fresh_news') AS fresh_news_state_count,
       count(*) FILTER (news_signal_state = 'carried_forward_only') AS carried_forward_only_state_count,
       count(*) FILTER (news_signal_state = 'zero_news') AS zero_news_state_count,
       count(*) FILTER (news_signal_state = 'fallback_heavy') AS fallback_heavy_state_count
FROM news_features GROUP BY ticker, exchange""")
def news_feature_summary(spark, sf):
    return N.news_feature_summary(features(spark, sf))
