"""Prediction windows: explicit, default, dual, slots, snapping, as-of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import merge as G
from tidemark.operators import news_features as N
from tidemark.operators import windows as W
from tidemark.operators.news_cutoff import news_rows_at
from tidemark.queries import inputs as I
from tidemark.queries import log_inputs as L
from tidemark.queries import news_queries as NQ
from tidemark.queries import price_queries as PQ
from tidemark.queries.inputs import ntz, r
from tidemark.queries.oracle import cte, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, MODES, PilotSettings

S = PilotSettings()


def requests(spark, sf):
    e = F.col("event_id")
    return L.events(spark, sf).select(
        "event_id", F.lit("NSE").alias("exchange"), F.col("at").alias("timestamp_utc"),
        F.when(e % 10 == 9, "midday").when(e % 2 == 0, "pre_market").otherwise("after_close").alias("prediction_mode"))


cte("win", """
SELECT e.event_id, e.run_ts, e.run_ts + INTERVAL 330 MINUTE AS local_ts, strftime(e.run_ts + INTERVAL 330 MINUTE, '%H:%M:%S.%f') AS clock, c.*,
  CASE WHEN event_id % 10 = 9 THEN 'midday' WHEN event_id % 2 = 0 THEN 'pre_market' ELSE 'after_close' END AS mode
FROM log_events e JOIN cal c ON c.date = e.day""")
cte("win_explicit", """
SELECT *, CASE WHEN mode = 'midday' THEN 'unsupported_prediction_mode' WHEN mode = 'pre_market' AND is_session AND clock >= '09:15:00' THEN 'pre_market_after_open'
  WHEN mode = 'after_close' AND is_session AND clock < '15:30:00' THEN 'after_close_before_close'
  WHEN mode = 'after_close' AND clock < '15:30:00' THEN 'after_close_before_close_non_trading' END AS window_error,
  CASE WHEN mode = 'pre_market' THEN on_or_after WHEN is_session THEN date ELSE previous_session END AS session FROM win""")


@query("explicit_windows", "T3", """
SELECT event_id, mode AS prediction_mode, window_error, CASE WHEN window_error IS NULL THEN session END AS market_session_date,
  CASE WHEN window_error IS NULL THEN CASE WHEN mode = 'pre_market' THEN previous_session ELSE session END END AS historical_cutoff_date,
  CASE WHEN window_error IS NULL THEN CASE WHEN mode = 'pre_market' THEN session ELSE next_session END END AS prediction_date FROM win_explicit""")
def explicit_windows(spark, sf):
    return W.explicit_window(requests(spark, sf), I.calendar(spark), I.MARKET).select(
        "event_id", "prediction_mode", "window_error", *W.WINDOW)


@query("default_windows", "T4", """
SELECT event_id, CASE WHEN closed THEN 'after_close' ELSE 'pre_market' END AS prediction_mode, session AS market_session_date,
  CASE WHEN closed THEN session ELSE previous_session END AS historical_cutoff_date, CASE WHEN closed THEN next_session ELSE session END AS prediction_date,
  CASE WHEN is_session AND (closed OR clock < '09:15:00') THEN 'natural' ELSE 'snapped' END AS resolution_kind,
  CASE WHEN NOT is_session AND closed THEN 'non_trading_day_after_close' WHEN NOT is_session THEN 'non_trading_day' WHEN clock < '09:15:00' THEN 'before_open'
       WHEN closed THEN 'after_close' ELSE 'during_session' END AS resolution_reason,
  CAST(session AS TIMESTAMP) + CASE WHEN closed THEN INTERVAL 975 MINUTE ELSE INTERVAL 485 MINUTE END - INTERVAL 330 MINUTE AS window_timestamp_utc
FROM (SELECT *, clock >= '15:30:00' AS closed, CASE WHEN is_session THEN date WHEN clock >= '15:30:00' THEN previous_session ELSE on_or_after END AS session FROM win)""")
def default_windows(spark, sf):
    out = W.default_window(requests(spark, sf).drop("prediction_mode"), I.calendar(spark), S, I.MARKET)
    return out.select("event_id", "prediction_mode", *W.WINDOW, "resolution_kind", "resolution_reason",
                      ntz("window_timestamp_utc").alias("window_timestamp_utc"))


@query("dual_windows", "T5", """
SELECT event_id, 'after_close' AS prediction_mode, session AS market_session_date, session AS historical_cutoff_date,
  (SELECT min(c.date) FROM cal c WHERE c.is_session AND c.date > session) AS prediction_date
FROM (SELECT *, CASE WHEN is_session AND clock >= '15:30:00' THEN date ELSE previous_session END AS session FROM win)
UNION ALL
SELECT event_id, 'pre_market', session, (SELECT max(c.date) FROM cal c WHERE c.is_session AND c.date < session), session
FROM (SELECT *, (SELECT min(c.date) FROM cal c WHERE c.is_session AND CAST(c.date AS TIMESTAMP) + INTERVAL 485 MINUTE > local_ts) AS session FROM win)""")
def dual_windows(spark, sf):
    return W.dual_windows(requests(spark, sf).drop("prediction_mode"), I.calendar(spark), S, I.MARKET).select(
        "event_id", "prediction_mode", *W.WINDOW)


def plans(spark, sf):
    """One plan per instrument: the two weeks from its first log day."""
    return L.log(spark, sf).groupBy(*KEYS).agg(F.min("market_session_date").alias("start_date")).withColumn(
        "end_date", F.date_add("start_date", 13))


cte("week_slots", """
SELECT p.ticker, p.exchange, c.date AS market_session_date, m.prediction_mode, c.date || '_' || m.prediction_mode AS slot_id,
  CASE WHEN m.prediction_mode = 'pre_market' THEN c.date ELSE c.next_session END AS prediction_date,
  CAST(c.date AS TIMESTAMP) + CASE WHEN m.prediction_mode = 'pre_market' THEN INTERVAL 155 MINUTE ELSE INTERVAL 645 MINUTE END AS scheduled_timestamp_utc
FROM (SELECT ticker, exchange, min(market_session_date) AS a FROM plog GROUP BY ticker, exchange) p
JOIN cal c ON c.is_session AND c.date BETWEEN p.a AND p.a + 13 CROSS JOIN (VALUES ('pre_market'), ('after_close')) m(prediction_mode)""")


@query("week_slots", "T6", "SELECT * FROM week_slots")
def week_slots(spark, sf):
    out = W.week_slots(plans(spark, sf), I.calendar(spark), S, I.MARKET)
    return out.select(*KEYS, "market_session_date", "prediction_mode", "slot_id", "prediction_date",
                      ntz("scheduled_timestamp_utc").alias("scheduled_timestamp_utc"))


def statuses(spark, sf):
    """Runs of even-numbered attempts stand for executed slots."""
    rows = L.log(spark, sf).where(F.substring_index("pilot_entry_id", "|", -1).cast("long") % 4 < 2)
    return rows.select(*KEYS, "market_session_date", "prediction_mode", "status",
                       F.struct("pilot_timestamp_utc", "pilot_entry_id").alias("executed_at_utc"))


SLOT = [*KEYS, "market_session_date", "prediction_mode"]


@query("due_slots", "T7", """
SELECT s.ticker, s.slot_id FROM week_slots s WHERE s.scheduled_timestamp_utc <= TIMESTAMP '2001-10-10 12:00:00'
AND NOT EXISTS (SELECT 1 FROM plog l WHERE l.event_id % 4 < 2 AND l.ticker = s.ticker AND l.market_session_date = s.market_session_date AND l.prediction_mode = s.prediction_mode)""")
def due_slots(spark, sf):
    slots = W.week_slots(plans(spark, sf), I.calendar(spark), S, I.MARKET)
    now = F.lit("2001-10-10 12:00:00").cast("timestamp")
    return W.due_slots(slots, statuses(spark, sf), now, SLOT).select("ticker", "slot_id")


cte("slot_status", """
SELECT s.ticker, s.exchange, CASE WHEN l.status IS NULL THEN 'pending' WHEN l.status IN ('success', 'abstain') THEN 'completed'
  WHEN l.status = 'partial_failure' THEN 'partial_failure' ELSE 'failure' END AS st
FROM week_slots s LEFT JOIN (SELECT ticker, market_session_date, prediction_mode, status FROM plog WHERE event_id % 4 < 2
  QUALIFY row_number() OVER (PARTITION BY ticker, market_session_date, prediction_mode ORDER BY pilot_timestamp_utc DESC NULLS LAST, pilot_entry_id DESC) = 1) l
ON l.ticker = s.ticker AND l.market_session_date = s.market_session_date AND l.prediction_mode = s.prediction_mode""")
cte("week_status", """
SELECT ticker, exchange, count(*) AS slot_count, count(*) FILTER (st = 'completed') AS completed_slot_count, count(*) FILTER (st = 'partial_failure') AS partial_failure_slot_count,
  count(*) FILTER (st = 'failure') AS failure_slot_count, count(*) FILTER (st = 'pending') AS pending_slot_count FROM slot_status GROUP BY ticker, exchange""")


def week_state(spark, sf):
    slots = W.week_slots(plans(spark, sf), I.calendar(spark), S, I.MARKET)
    return W.week_status(slots, statuses(spark, sf), SLOT, list(KEYS))


@query("week_status", "A16", "SELECT * FROM week_status")
def week_status(spark, sf):
    return week_state(spark, sf)


def bar_windows(spark, sf):
    """One window per order: instrument of its customer, cutoff around its date."""
    a = I.extractions(spark, sf)
    cal = I.calendar(spark).select("exchange", F.col("date").alias("d"), "on_or_after", "previous_session", "second_session")
    rows = a.withColumn("d", F.to_date("published_at_utc")).join(F.broadcast(cal), ["exchange", "d"])
    pre = F.col("k") % 2 == 0
    return rows.select(
        "article_id", *KEYS, F.when(pre, "pre_market").otherwise("after_close").alias("prediction_mode"),
        F.col("on_or_after").alias("market_session_date"),
        F.when(pre, F.col("previous_session")).otherwise(F.col("on_or_after")).alias("historical_cutoff_date"),
        F.when(pre, F.col("on_or_after")).otherwise(F.col("second_session")).alias("prediction_date"),
        F.col("published_at_utc").alias("news_cutoff_utc"))


cte("bar_windows", """
SELECT e.article_id, e.ticker, e.exchange, e.k, e.published_at_utc, CASE WHEN e.k % 2 = 0 THEN 'pre_market' ELSE 'after_close' END AS prediction_mode, c.on_or_after AS session,
  CASE WHEN e.k % 2 = 0 THEN c.previous_session ELSE c.on_or_after END AS cutoff, CASE WHEN e.k % 2 = 0 THEN c.on_or_after ELSE c.second_session END AS pdate
FROM extractions e JOIN cal c ON c.date = CAST(e.published_at_utc AS DATE)""")
cte("bar_reach", "SELECT b.ticker, b.date, c.on_or_before AS reach FROM bars b JOIN cal c ON c.date = b.date")
cte("win_latest", """
SELECT w.*, r.reach AS latest FROM bar_windows w ASOF LEFT JOIN bar_reach r ON r.ticker = w.ticker AND r.date <= w.cutoff""")


@query("bar_snapping", "T8", """
SELECT article_id, l.prediction_mode, latest AS latest_bar_date, coalesce(latest < cutoff AND l.prediction_mode = 'after_close', false) AS window_snapped,
  CASE WHEN latest IS NULL THEN 'no_market_data' WHEN latest < cutoff AND l.prediction_mode = 'pre_market' THEN 'historical_cutoff_mismatch' END AS window_error,
  CASE WHEN latest < cutoff AND l.prediction_mode = 'after_close' THEN 'historical_cutoff_snapped_to_latest_bar' ELSE '' END AS window_warnings,
  CASE WHEN latest < cutoff AND l.prediction_mode = 'after_close' THEN latest ELSE session END AS market_session_date,
  CASE WHEN latest < cutoff AND l.prediction_mode = 'after_close' THEN latest ELSE cutoff END AS historical_cutoff_date,
  CASE WHEN latest < cutoff AND l.prediction_mode = 'after_close' THEN c.next_session ELSE pdate END AS prediction_date
FROM win_latest l LEFT JOIN cal c ON c.date = l.latest""")
def bar_snapping(spark, sf):
    out = W.snap_to_latest_bar(bar_windows(spark, sf), I.bars(spark, sf), I.calendar(spark), S, I.MARKET)
    return out.select("article_id", "prediction_mode", "latest_bar_date", "window_snapped", "window_error",
                      F.concat_ws(",", "window_warnings").alias("window_warnings"), *W.WINDOW)


@query("cutoff_filters", "F13", """
SELECT 'bars' AS source, b.ticker, count(*) AS n FROM bars b JOIN (SELECT ticker, max(cutoff) AS c FROM bar_windows WHERE cutoff < DATE '1999-06-30' GROUP BY ticker) w USING (ticker)
WHERE b.date <= w.c GROUP BY b.ticker
UNION ALL
SELECT 'news', e.ticker, count(*) FROM extractions e JOIN (SELECT ticker, max(published_at_utc) AS c FROM bar_windows WHERE cutoff < DATE '1999-06-30' GROUP BY ticker) w USING (ticker)
WHERE e.published_at_utc < w.c AND e.published_at_utc >= w.c - INTERVAL 90 DAY GROUP BY e.ticker""")
def cutoff_filters(spark, sf):
    wins = bar_windows(spark, sf).where("historical_cutoff_date < DATE '1999-06-30'")
    bars = W.bars_before_cutoff(I.bars(spark, sf), wins).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    news = W.news_before_cutoff(I.extractions(spark, sf), wins, 90).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return bars.withColumn("source", F.lit("bars")).unionByName(news.withColumn("source", F.lit("news")))


_asof_cols = ("close", "ret_5d", "rsi_14", "macd_signal_lag2")


@query("as_of_features", "T9", f"""
SELECT w.article_id, p.date AS historical_date, {', '.join(f'{rnd("p." + c, 4)} AS {c}' for c in _asof_cols)},
  CASE WHEN p.date IS NULL THEN 'no_feature_row' WHEN w.pdate <= p.date THEN 'prediction_date_not_after_history' END AS feature_error
FROM bar_windows w ASOF LEFT JOIN (SELECT * FROM pf_marked WHERE date >= first_ready) p ON p.ticker = w.ticker AND p.date <= w.cutoff""")
def as_of_features(spark, sf):
    from tidemark.operators.price_features import feature_ready

    rows = feature_ready(PQ.rows(spark, sf))
    out = W.as_of_features(bar_windows(spark, sf), rows, list(_asof_cols))
    return out.select("article_id", "historical_date", *[r(c, 4).alias(c) for c in _asof_cols], "feature_error")


_lag_cols = ("news_avg_sentiment", "news_article_count", "news_sentiment_3d")
cte("nf_lagged", f"""
SELECT ticker, date, prediction_mode, {', '.join(f'{c} AS {c}_lag1, coalesce(lag({c}) OVER (PARTITION BY ticker, prediction_mode ORDER BY date), 0) AS {c}_lag2' for c in _lag_cols)} FROM news_features""")


@query("live_news_lags", "T10", f"""
SELECT w.article_id, {', '.join(f'{rnd(f"coalesce(n.{c}_lag{k}, 0)")} AS {c}_lag{k}' for k in (1, 2) for c in _lag_cols)}
FROM bar_windows w ASOF LEFT JOIN nf_lagged n ON n.ticker = w.ticker AND n.prediction_mode = w.prediction_mode AND n.date < w.pdate""")
def live_news_lags(spark, sf):
    out = W.live_news_lags(bar_windows(spark, sf), NQ.features(spark, sf), list(_lag_cols), (1, 2))
    return out.select("article_id", *[r(f"{c}_lag{k}").alias(f"{c}_lag{k}") for k in (1, 2) for c in _lag_cols])


@query("live_news_rows", "J13", f"""
SELECT w.article_id, n.date IS NULL AS synthetic, coalesce(n.news_signal_state, 'zero_news') AS news_signal_state, {rnd('coalesce(n.news_avg_sentiment, 0)')} AS news_avg_sentiment,
  CAST(coalesce(n.news_article_count, 0) AS DOUBLE) AS news_article_count
FROM bar_windows w LEFT JOIN news_features n ON n.ticker = w.ticker AND n.prediction_mode = w.prediction_mode AND n.date = w.pdate""")
def live_news_rows(spark, sf):
    joined = G.join_news(bar_windows(spark, sf), NQ.features(spark, sf))
    return joined.select("article_id", F.col("news_missing").alias("synthetic"), N.STATE,
                         r("news_avg_sentiment").alias("news_avg_sentiment"), "news_article_count")


# Point-in-time news: each window's own articles, joined one by one; averages in closed form.
cte("cut_art", """
SELECT w.article_id AS wid, w.prediction_mode AS wmode, a.prediction_mode AS amode, c.session_index AS s, a.* EXCLUDE (article_id, prediction_mode)
FROM bar_windows w JOIN art_mode a ON a.ticker = w.ticker AND a.published_at_utc < w.published_at_utc AND a.published_at_utc >= w.published_at_utc - INTERVAL 90 DAY
JOIN cal c ON c.date = a.date AND c.is_session""")
cte("cut_span", "SELECT wid, min(s) AS f, max(s) AS l FROM cut_art GROUP BY wid")
cte("cut_agg", f"""
SELECT wid, s, {', '.join(f'{v} AS {k}' for k, v in NQ._agg.items())} FROM cut_art WHERE amode = wmode GROUP BY wid, s""")
cte("cut_target", """
SELECT w.article_id AS wid, k.slot, p.f, p.l, CASE WHEN k.slot = 0 THEN c.session_index ELSE least(c.session_index - 1, p.l) - (k.slot - 1) END AS t
FROM bar_windows w JOIN cal c ON c.date = w.pdate AND c.is_session JOIN cut_span p ON p.wid = w.article_id, (VALUES (0), (1), (2)) k(slot)""")
_cut_events = " + ".join(f"g.news_event_count_{e}" for e in V.EVENT_TYPES)


def _closed(span: int) -> str:
    a, q = 2 / (span + 1), 1 - 2 / (span + 1)
    return (f"coalesce(sum(CASE WHEN g.s = x.f THEN 1.0::DOUBLE ELSE {a!r}::DOUBLE END * pow({q!r}::DOUBLE, x.t - g.s) "
            "* g.news_weighted_sentiment_score), 0)")


cte("cut_rolled", f"""
SELECT x.wid, x.slot, x.t, x.t BETWEEN x.f AND x.l AS here, max(g.s) AS src,
  {', '.join(f"CAST(coalesce(sum(g.news_article_count) FILTER (g.s > x.t - {k}), 0) AS DOUBLE) AS news_volume_{k}d, CAST(coalesce(sum({_cut_events}) FILTER (g.s > x.t - {k}), 0) AS DOUBLE) AS news_event_count_{k}d" for k in (1, 3, 5))},
  coalesce(sum(g.news_weighted_sentiment_score) FILTER (g.s = x.t), 0) AS news_sentiment_1d, {_closed(3)} AS news_sentiment_3d, {_closed(5)} AS news_sentiment_5d
FROM cut_target x LEFT JOIN cut_agg g ON g.wid = x.wid AND g.s <= x.t GROUP BY ALL""")
_cut_values = ", ".join(
    f"CASE WHEN r.here AND r.src IS NOT NULL THEN g.{c} * pow(0.7::DOUBLE, r.t - r.src) ELSE 0 END AS {c}" if c in N.DECAYED_COLUMNS
    else f"CASE WHEN r.here AND r.src = r.t THEN CAST(g.{c} AS DOUBLE) ELSE 0 END AS {c}" for c in NQ.AGG_COLUMNS)
_cut_rolling = ", ".join(f"CASE WHEN r.here THEN r.{c} ELSE 0 END AS {c}" for c in N.ROLLING_COLUMNS)
_flag = "CAST(coalesce({}, false) AS INTEGER)::DOUBLE AS {}".format
_heavy = "r.here AND r.src = r.t AND g.news_fallback_article_ratio > 0.5"
cte("cut_rows", f"""
SELECT r.wid, r.slot, r.here, {_cut_values}, {_cut_rolling},
  {_flag('NOT (r.here AND r.src IS NOT NULL)', 'news_zero_flag')}, {_flag('r.here AND r.src < r.t', 'news_carried_flag')},
  {_flag('r.here AND r.src IS NOT NULL', 'has_news_signal')}, {_flag('r.here AND r.src < r.t', 'carried_forward_signal')},
  {_flag(_heavy, 'degraded_news_context')}, {_flag('r.here AND r.src = r.t', 'has_fresh_news')},
  {_flag('r.here AND r.src < r.t', 'is_carried_forward')}, {_flag(_heavy, 'is_fallback_heavy')},
  CASE WHEN {_heavy} THEN 'fallback_heavy' WHEN r.here AND r.src = r.t THEN 'fresh_news'
       WHEN r.here AND r.src < r.t THEN 'carried_forward_only' ELSE 'zero_news' END AS news_signal_state
FROM cut_rolled r LEFT JOIN cut_agg g ON g.wid = r.wid AND g.s = r.src""")


@query("news_at_cutoff", "F13 L8 T10 J13", f"""
SELECT w.article_id, NOT coalesce(a.here, false) AS synthetic, coalesce(a.news_signal_state, 'zero_news') AS news_signal_state,
  {', '.join(f"{rnd(f'coalesce(a.{c}, {1 if c == 'news_zero_flag' else 0})')} AS {c}" for c in N.NEWS_COLUMNS)},
  {', '.join(f"{rnd(f'CASE WHEN x{k}.here THEN x{k}.{c} ELSE 0 END')} AS {c}_lag{k}" for k in (1, 2) for c in _lag_cols)}
FROM bar_windows w LEFT JOIN cut_rows a ON a.wid = w.article_id AND a.slot = 0
LEFT JOIN cut_rows x1 ON x1.wid = w.article_id AND x1.slot = 1 LEFT JOIN cut_rows x2 ON x2.wid = w.article_id AND x2.slot = 2""")
def news_at_cutoff(spark, sf):
    """Every window's 72 news columns and lags, from the articles of the 90 days before its own cutoff."""
    out = news_rows_at(bar_windows(spark, sf), I.extractions(spark, sf), I.calendar(spark), NQ.S, I.MARKET, 90, (1, 2), _lag_cols)
    return out.select("article_id", F.col("news_missing").alias("synthetic"), N.STATE, *[r(c).alias(c) for c in (
        *N.NEWS_COLUMNS, *[f"{c}_lag{k}" for k in (1, 2) for c in _lag_cols])])
