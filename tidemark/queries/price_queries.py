"""Price feature stage: indicators, lags, labels, warm-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import price_features as P
from tidemark.operators.bars import align_to_sessions
from tidemark.queries import inputs as I
from tidemark.queries.inputs import r, rounded
from tidemark.queries.oracle import cte, rnd, rounded as sqlr
from tidemark.queries.registry import query
from tidemark.settings import KEYS, PriceSettings

S = PriceSettings()
BASE = S.base_columns
# Levels in price units carry fewer exact decimals than ratios.
LEVELS = ("ma_5", "ma_10", "ma_20", "macd", "macd_signal", "atr_14")


def _digits(column: str) -> int:
    root = column.rsplit("_lag", 1)[0]
    return 4 if root in LEVELS or root.startswith(("rsi", "stoch")) else 6


def spark_features(columns) -> list:
    return [r(c, _digits(c)).alias(c) for c in columns]


def sql_features(columns) -> str:
    return ", ".join(f"{rnd(c, _digits(c))} AS {c}" for c in columns)


def aligned(spark, sf):
    return align_to_sessions(I.bars(spark, sf), I.calendar(spark))


def rows(spark, sf):
    return P.price_feature_rows(aligned(spark, sf), I.calendar(spark), S)


def guard(fn: str, counted: str, k: int) -> str:
    w = f"(PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({counted}) OVER {w} = {k} THEN {fn} OVER {w} END"


W = "(PARTITION BY ticker, exchange ORDER BY date)"
UP = "(PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def fold(column: str, alpha: str, minimum: int) -> str:
    """The average as a literal left fold over the history of the row."""
    history = f"list({column}) FILTER ({column} IS NOT NULL) OVER {UP}"
    return (f"CASE WHEN count({column}) OVER {UP} >= {minimum} THEN "
            f"list_reduce({history}, lambda acc, x: acc + ({alpha}) * (x - acc)) END")


cte("pf1", f"""
SELECT *, lag(close) OVER {W} AS prev, lag(volume) OVER {W} AS prev_volume,
       close / lag(close, 1) OVER {W} - 1 AS ret_1d, close / lag(close, 3) OVER {W} - 1 AS ret_3d,
       close / lag(close, 5) OVER {W} - 1 AS ret_5d,
       {guard('avg(close)', 'close', 5)} AS ma_5, {guard('avg(close)', 'close', 10)} AS ma_10,
       {guard('avg(close)', 'close', 20)} AS ma_20,
       {guard('avg(volume)', 'volume', 20)} AS volume_ma,
       close / ({guard('max(close)', 'close', 252)}) AS price_vs_52w_high,
       close / ({guard('min(close)', 'close', 252)}) AS price_vs_52w_low,
       {guard('stddev_pop(close)', 'close', 20)} AS band_std,
       {guard('min(low)', 'low', 14)} AS low14, {guard('max(high)', 'high', 14)} AS high14,
       greatest(close - lag(close) OVER {W}, 0) + 0 * (close - lag(close) OVER {W}) AS gain,
       greatest(lag(close) OVER {W} - close, 0) + 0 * (close - lag(close) OVER {W}) AS loss,
       coalesce(sign(close - lag(close) OVER {W}), 0) * volume AS signed_volume,
       CAST(sum(market_data_gap_flag) OVER (PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS market_data_gap_count_5d
FROM aligned""")
cte("pf2", f"""
SELECT *, {guard('stddev_pop(ret_1d)', 'ret_1d', 5)} AS volatility_5d,
       {guard('stddev_pop(ret_1d)', 'ret_1d', 10)} AS volatility_10d,
       CASE WHEN prev_volume = 0 THEN 1.0 ELSE volume / prev_volume END - 1 AS volume_change_1d,
       CASE WHEN volume_ma = 0 THEN 1.0 ELSE volume / volume_ma END AS volume_ma_ratio,
       CASE WHEN abs(ma_20) > 1e-12 THEN 4 * band_std / ma_20 END AS bb_width,
       coalesce(CASE WHEN abs(4 * band_std) > 1e-12 THEN greatest(0, least(1, (close - (ma_20 - 2 * band_std)) / (4 * band_std))) END, 0.5) AS bb_position,
       greatest(high - low, abs(high - prev), abs(low - prev)) AS true_range,
       sum(signed_volume) OVER {UP} AS obv,
       coalesce(CASE WHEN high14 <> low14 THEN (close - low14) / (high14 - low14) * 100 END, 50) AS stoch_k,
       CAST(isodow(date) - 1 AS DOUBLE) AS day_of_week,
       {fold('close', '2.0::DOUBLE / 13', 12)} AS fast, {fold('close', '2.0::DOUBLE / 27', 26)} AS slow,
       {fold('gain', '1.0::DOUBLE / 14', 14)} AS avg_gain, {fold('loss', '1.0::DOUBLE / 14', 14)} AS avg_loss
FROM pf1""")
cte("pf3", f"""
SELECT *, {guard('avg(true_range)', 'true_range', 14)} AS atr_14, fast - slow AS macd,
       CASE WHEN obv_mean = 0 THEN 1.0 ELSE obv / obv_mean END AS obv_ratio,
       avg(stoch_k) OVER (PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS stoch_d,
       CASE WHEN avg_gain = 0 AND avg_loss = 0 THEN 50 WHEN avg_loss = 0 AND avg_gain > 0 THEN 100
            WHEN avg_gain = 0 AND avg_loss > 0 THEN 0 ELSE 100 - 100 / (1 + avg_gain / avg_loss) END AS rsi_14
FROM (SELECT *, avg(obv) OVER (PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS obv_mean FROM pf2)""")
cte("pf_base", f"SELECT *, {fold('macd', '2.0::DOUBLE / 10', 9)} AS macd_signal FROM pf3")
_lags = ", ".join(f"lag({c}, {k}) OVER {W} AS {c}_lag{k}" for k in S.lags for c in BASE)
_ready = " AND ".join(f"{c} IS NOT NULL" for c in S.feature_columns if c not in ("stoch_k", "bb_position"))
cte("pf_lagged", f"""
SELECT p.ticker, p.exchange, p.date, p.close, p.volume, p.market_data_gap_flag, p.market_data_gap_count_5d,
       {', '.join('p.' + c for c in BASE)}, {_lags},
       CASE WHEN lead(p.close) OVER {W} IS NOT NULL THEN CAST(lead(p.close) OVER {W} > p.close AS INTEGER) END AS target_next_day_direction
FROM pf_base p""")
cte("pf_rows", f"""
SELECT p.*, c.next_session AS target_date, (close IS NOT NULL AND {_ready}) AS ready
FROM pf_lagged p JOIN cal c ON c.date = p.date""")
cte("pf_marked", """
SELECT *, min(CASE WHEN ready THEN date END) OVER (PARTITION BY ticker, exchange) AS first_ready,
       max(date) OVER (PARTITION BY ticker, exchange) AS last_date FROM pf_rows""")
cte("price_features", "SELECT * FROM pf_marked WHERE date >= first_ready AND target_next_day_direction IS NOT NULL")


@query("price_returns", "W1 W2 W3 W4", f"""
SELECT ticker, date, {sql_features(BASE[:10])} FROM pf2""")
def price_returns(spark, sf):
    return P.technical_features(aligned(spark, sf), S).select("ticker", "date", *spark_features(BASE[:10]))


@query("price_macd_rsi", "W5 W7", f"""
SELECT ticker, date, {sql_features(('macd', 'macd_signal', 'rsi_14'))} FROM pf_base""")
def price_macd_rsi(spark, sf):
    return P.technical_features(aligned(spark, sf), S).select(
        "ticker", "date", *spark_features(("macd", "macd_signal", "rsi_14")))


@query("price_ranges", "W6 W8 W9 W10 W11", f"""
SELECT ticker, date, {sql_features(('price_vs_52w_high', 'price_vs_52w_low', 'bb_width', 'bb_position', 'atr_14', 'obv_ratio', 'stoch_k', 'stoch_d'))}
FROM pf3""")
def price_ranges(spark, sf):
    return P.technical_features(aligned(spark, sf), S).select("ticker", "date", *spark_features(
        ("price_vs_52w_high", "price_vs_52w_low", "bb_width", "bb_position", "atr_14", "obv_ratio", "stoch_k", "stoch_d")))


@query("price_gap_counts", "W12 X27", """
SELECT ticker, date, market_data_gap_flag, market_data_gap_count_5d, day_of_week FROM pf2""")
def price_gap_counts(spark, sf):
    return P.technical_features(aligned(spark, sf), S).select(
        "ticker", "date", "market_data_gap_flag", "market_data_gap_count_5d", "day_of_week")


@query("price_labels", "W14", """
SELECT ticker, date, close, target_date, target_next_day_direction FROM pf_rows""")
def price_labels(spark, sf):
    return P.with_label(aligned(spark, sf), I.calendar(spark)).select(
        "ticker", "date", "close", "target_date", P.LABEL)


@query("price_features", "W1 W2 W3 W4 W5 W6 W7 W8 W9 W10 W11 W12 W13 W14 F9 F10", f"""
SELECT ticker, exchange, date, target_date, close, volume, market_data_gap_flag, market_data_gap_count_5d,
       {sql_features(S.feature_columns)}, target_next_day_direction FROM price_features""")
def price_features(spark, sf):
    out = P.build_price_features(aligned(spark, sf), I.calendar(spark), S)
    return out.select(*KEYS, "date", "target_date", "close", "volume", *P.GAP_COLUMNS,
                      *spark_features(S.feature_columns), P.LABEL)


@query("price_readiness", "F9 F10", """
SELECT ticker, date, ready, first_ready, coalesce(date < first_ready, true) AS is_warmup,
       coalesce(date > first_ready AND NOT ready, false) AS is_hole,
       target_next_day_direction IS NULL AND date = last_date AS is_unlabelled_tail,
       target_next_day_direction IS NULL AND date < last_date AS is_label_hole FROM pf_marked""")
def price_readiness(spark, sf):
    return P.readiness(rows(spark, sf), S).select(
        "ticker", "date", "ready", "first_ready", "is_warmup", "is_hole", "is_unlabelled_tail", "is_label_hole")


@query("price_feature_summary", "A9", """
SELECT ticker, exchange, count(*) AS input_row_count,
       count(*) FILTER (date >= first_ready AND target_next_day_direction IS NOT NULL) AS output_row_count,
       count(*) FILTER (coalesce(date < first_ready, true)) AS warmup_rows_dropped,
       count(*) FILTER (date >= first_ready AND target_next_day_direction IS NULL AND date = last_date) AS label_rows_dropped,
       count(*) FILTER (date > first_ready AND NOT ready) AS hole_count,
       count(*) FILTER (date >= first_ready AND target_next_day_direction IS NULL AND date < last_date) AS label_hole_count,
       CAST(sum(market_data_gap_flag) AS BIGINT) AS gap_filled_row_count,
       max(market_data_gap_count_5d) FILTER (date >= first_ready AND target_next_day_direction IS NOT NULL) AS max_gap_count_5d,
       min(date) FILTER (date >= first_ready AND target_next_day_direction IS NOT NULL) AS coverage_start,
       max(date) FILTER (date >= first_ready AND target_next_day_direction IS NOT NULL) AS coverage_end
FROM pf_marked GROUP BY ticker, exchange""")
def price_feature_summary(spark, sf):
    return P.price_feature_summary(rows(spark, sf), S)
