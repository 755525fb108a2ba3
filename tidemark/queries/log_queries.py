"""Prediction log: reruns, outcomes, notes, lookups, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import news_features as N
from tidemark.operators import prediction_log as P
from tidemark.operators import review as R
from tidemark.queries import evaluation_queries as EQ
from tidemark.queries import inputs as I
from tidemark.queries import log_inputs as L
from tidemark.queries import news_queries as NQ
from tidemark.queries import window_queries as WQ
from tidemark.queries.inputs import ntz, r
from tidemark.queries.oracle import cte, in_list, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, MODES, IngestSettings, PriceSettings
from tidemark.sources import prediction_log as PL
from tidemark.sources import tables

NOW = "2001-11-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("log_append", "S9 X22", """
SELECT prediction_mode, ticker, count(*) AS row_count, count(pilot_entry_id) AS id_count, count(prediction_key) AS key_count, 0::BIGINT AS note_count
FROM (SELECT prediction_mode, ticker, pilot_entry_id, prediction_key FROM plog UNION ALL
      SELECT prediction_mode, ticker, pilot_entry_id, prediction_key FROM plog WHERE status = 'failure') GROUP BY ALL""")
def log_append(spark, sf):
    """Rows with only some of the columns are appended under the fixed layout."""
    log = L.log(spark, sf)
    short = log.where("status = 'failure'").select("pilot_entry_id", "prediction_key", "prediction_mode", "ticker", F.lit(1).alias("unknown_column"))
    return PL.append_rows(log, short).groupBy("prediction_mode", "ticker").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("pilot_entry_id").alias("id_count"),
        F.count("prediction_key").alias("key_count"), F.count("market_shock_note").alias("note_count"))


@query("instrument_log", "S10", """
SELECT pilot_entry_id, prediction_mode, status, prediction_date FROM plog WHERE ticker = 'N7'""")
def instrument_log(spark, sf):
    return PL.instrument_log(L.log(spark, sf), "n7", "nse").select("pilot_entry_id", "prediction_mode", "status", "prediction_date")


@query("latest_session_rows", "W20", """
SELECT pilot_entry_id, ticker, prediction_mode, market_session_date, status FROM plog_latest""")
def latest_session_rows(spark, sf):
    return P.latest_rows(L.log(spark, sf)).select("pilot_entry_id", "ticker", "prediction_mode", "market_session_date", "status")


@query("latest_mode_rows", "W21", """
SELECT ticker, prediction_mode, pilot_entry_id FROM plog QUALIFY row_number() OVER (PARTITION BY ticker, exchange, prediction_mode
  ORDER BY pilot_timestamp_utc DESC NULLS LAST, prediction_date DESC NULLS LAST, pilot_entry_id DESC) = 1""")
def latest_mode_rows(spark, sf):
    return P.latest_per_mode(L.log(spark, sf)).select("ticker", "prediction_mode", "pilot_entry_id")


cte("unique_days", """
SELECT * FROM plog QUALIFY row_number() OVER (PARTITION BY ticker, exchange, prediction_date
  ORDER BY CASE prediction_mode WHEN 'pre_market' THEN 0 ELSE 1 END, pilot_timestamp_utc DESC NULLS LAST, pilot_entry_id DESC) = 1""")


@query("unique_day_history", "W21", """
SELECT ticker, prediction_date, prediction_mode, pilot_entry_id FROM unique_days
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) <= 10""")
def unique_day_history(spark, sf):
    return P.recent_history(L.log(spark, sf), 10).select("ticker", "prediction_date", "prediction_mode", "pilot_entry_id")


cte("attempts", """
SELECT *, CAST(row_number() OVER (PARTITION BY prediction_key ORDER BY pilot_timestamp_utc NULLS FIRST, pilot_entry_id) AS INTEGER) AS attempt FROM plog""")


@query("attempt_numbers", "W22", "SELECT pilot_entry_id, prediction_key, attempt AS prediction_attempt_number FROM attempts")
def attempt_numbers(spark, sf):
    return P.rebuild_attempts(L.log(spark, sf)).select("pilot_entry_id", "prediction_key", "prediction_attempt_number")


@query("next_attempt", "W22", """
SELECT prediction_key, CAST(count(*) + 1 AS INTEGER) AS prediction_attempt_number FROM plog GROUP BY prediction_key
UNION ALL SELECT DISTINCT prediction_key || '-new', 1 FROM plog WHERE status = 'failure'""")
def next_attempt(spark, sf):
    log = L.log(spark, sf)
    fresh = log.where("status = 'failure'").select(F.concat("prediction_key", F.lit("-new")).alias("prediction_key"))
    return P.next_attempts(log, log.select("prediction_key").unionByName(fresh).distinct())


@query("prior_outcomes", "W23", """
WITH kept AS (SELECT l.* FROM plog l JOIN cal c ON c.date = l.prediction_date AND c.is_session),
last AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY ticker, prediction_mode, prediction_date ORDER BY pilot_timestamp_utc DESC NULLS FIRST, pilot_entry_id DESC) = 1)
SELECT l.pilot_entry_id, p.prediction_date AS prior_prediction_date, p.actual_outcome_status AS prior_status, p.baseline_correct AS prior_baseline_correct
FROM plog l ASOF LEFT JOIN last p ON p.ticker = l.ticker AND p.prediction_mode = l.prediction_mode AND p.prediction_date < l.prediction_date""")
def prior_outcomes(spark, sf):
    log = L.log(spark, sf)
    out = P.prior_outcome(log, log, I.calendar(spark), ["actual_outcome_status", "baseline_correct"])
    return out.select("pilot_entry_id", "prior_prediction_date", F.col("prior_actual_outcome_status").alias("prior_status"), "prior_baseline_correct")


@query("outcome_lookup", "J10", """
SELECT l.pilot_entry_id, a.close AS historical_close, b.close AS prediction_close FROM plog l
LEFT JOIN bars a ON a.ticker = l.ticker AND a.date = l.historical_date LEFT JOIN bars b ON b.ticker = l.ticker AND b.date = l.prediction_date""")
def outcome_lookup(spark, sf):
    return P.outcomes(L.log(spark, sf), I.bars(spark, sf)).select("pilot_entry_id", "historical_close", "prediction_close")


def _backfill_sql(due: str) -> str:
    return f"""
SELECT pilot_entry_id, CASE WHEN win THEN 'backfilled' WHEN lost THEN 'market_data_unavailable' ELSE actual_outcome_status END AS actual_outcome_status,
  CASE WHEN win THEN pc END AS actual_prediction_close, CASE WHEN win THEN CAST(pc > hc AS INTEGER) ELSE actual_next_day_direction END AS actual_next_day_direction,
  CASE WHEN win THEN NULL WHEN lost THEN CASE WHEN historical_date IS NULL THEN 'missing_historical_date' ELSE 'prediction_window_market_data_unavailable' END ELSE actual_backfill_error END AS actual_backfill_error,
  CASE WHEN win AND b_dir IS NOT NULL THEN b_dir = CAST(pc > hc AS INTEGER) ELSE baseline_correct END AS baseline_correct,
  CASE WHEN win AND n_dir IS NOT NULL THEN n_dir = CAST(pc > hc AS INTEGER) ELSE enhanced_correct END AS enhanced_correct, CAST(NULL AS BOOLEAN) AS blended_correct
FROM (SELECT l.*, a.close AS hc, b.close AS pc, coalesce(({due}) AND coalesce(actual_outcome_status <> 'backfilled', true), false) AND historical_date IS NOT NULL AND a.close IS NOT NULL AND b.close IS NOT NULL AS win,
  coalesce(({due}) AND coalesce(actual_outcome_status <> 'backfilled', true), false) AND NOT (historical_date IS NOT NULL AND a.close IS NOT NULL AND b.close IS NOT NULL) AS lost
  FROM plog l LEFT JOIN bars a ON a.ticker = l.ticker AND a.date = l.historical_date LEFT JOIN bars b ON b.ticker = l.ticker AND b.date = l.prediction_date)"""


_OUT = ("pilot_entry_id", "actual_outcome_status", "actual_prediction_close", "actual_next_day_direction",
        "actual_backfill_error", "baseline_correct", "enhanced_correct", "blended_correct")


@query("outcome_backfill", "L1 J10", _backfill_sql("true"))
def outcome_backfill(spark, sf):
    return P.backfill(L.log(spark, sf), I.bars(spark, sf), now()).select(*_OUT)


cte("eligible_days", """
SELECT DISTINCT ticker, prediction_date FROM plog WHERE prediction_date < DATE '2001-10-20' AND prediction_date <= DATE '2001-10-18'
AND coalesce(actual_outcome_status, 'pending') <> 'backfilled'""")
cte("eligible_top", "SELECT * FROM eligible_days QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) <= 5")


@query("pending_dates", "K6", "SELECT ticker, prediction_date FROM eligible_top")
def pending_dates(spark, sf):
    day = [F.lit(d).cast("date") for d in ("2001-10-20", "2001-10-18")]
    return P.eligible_dates(L.log(spark, sf), *day, 5).select("ticker", "prediction_date")


@query("pending_sweep", "L2 K6", _backfill_sql("(l.ticker, l.prediction_date) IN (SELECT ticker, prediction_date FROM eligible_top)"))
def pending_sweep(spark, sf):
    day = [F.lit(d).cast("date") for d in ("2001-10-20", "2001-10-18")]
    return P.backfill_pending(L.log(spark, sf), I.bars(spark, sf), now(), *day, 5).select(*_OUT)


cte("session_pending", """
SELECT DISTINCT ticker, prediction_mode, prediction_date FROM plog WHERE market_session_date BETWEEN DATE '2001-10-08' AND DATE '2001-10-19'
AND coalesce(actual_outcome_status <> 'backfilled', true) AND prediction_date <= DATE '2001-10-18'""")


@query("session_sweep", "L2", _backfill_sql(
    "(l.ticker, l.prediction_mode, l.prediction_date) IN (SELECT ticker, prediction_mode, prediction_date FROM session_pending)"))
def session_sweep(spark, sf):
    return P.backfill_sessions(
        L.log(spark, sf), I.bars(spark, sf), now(), "2001-10-08", "2001-10-19", F.lit("2001-10-18").cast("date")).select(*_OUT)


@query("unresolved_reasons", "A18", """
SELECT ticker, exchange, actual_backfill_error AS reason, count(*) AS row_count, actual_backfill_error = 'missing_historical_date' AS permanent
FROM plog WHERE actual_outcome_status = 'market_data_unavailable' GROUP BY ALL""")
def unresolved_reasons(spark, sf):
    return P.unresolved_counts(L.log(spark, sf))


@query("log_annotations", "L3", """
WITH last AS (SELECT pilot_entry_id AS target, ticker, prediction_mode, prediction_date FROM plog
  QUALIFY row_number() OVER (PARTITION BY ticker, prediction_mode, prediction_date ORDER BY pilot_timestamp_utc DESC NULLS FIRST, pilot_entry_id DESC) = 1)
SELECT l.pilot_entry_id, CASE WHEN t.target IS NOT NULL AND day(l.prediction_date) % 2 = 0 THEN 'reviewed ' || l.prediction_date ELSE l.news_quality_note END AS news_quality_note,
  CASE WHEN t.target IS NOT NULL THEN 'calm' END AS market_shock_note, l.source_outage_note, CASE WHEN t.target IS NOT NULL THEN TIMESTAMP '2001-11-15' END AS updated_at
FROM plog l LEFT JOIN last t ON t.target = l.pilot_entry_id AND dayofmonth(t.prediction_date) % 3 = 0""")
def log_annotations(spark, sf):
    log = L.log(spark, sf)
    day = F.dayofmonth("prediction_date")
    notes = log.where(day % 3 == 0).select(*P.MODE_KEYS, "prediction_date").distinct().withColumns({
        "news_quality_note": F.when(day % 2 == 0, F.concat(F.lit("reviewed "), F.col("prediction_date").cast("string"))),
        "market_shock_note": F.lit("calm"), "source_outage_note": F.lit(None).cast("string")})
    return P.annotate(log, notes, now()).select(
        "pilot_entry_id", "news_quality_note", "market_shock_note", "source_outage_note",
        ntz("manual_notes_updated_at_utc").alias("updated_at"))


@query("linked_news", "J11 K2", """
WITH ids AS (SELECT pilot_entry_id, CAST((event_id + i) % 1500 AS VARCHAR) AS article_id FROM plog, generate_series(0, 3) g(i))
SELECT pilot_entry_id, e.article_id, e.relevance_score, e.sentiment_label, CAST(row_number() OVER (PARTITION BY pilot_entry_id ORDER BY e.relevance_score DESC, e.article_id) AS INTEGER) AS position
FROM ids JOIN extractions e USING (article_id) QUALIFY position <= 3""")
def linked_news(spark, sf):
    out = P.linked_news(L.log(spark, sf), I.extractions(spark, sf).select("article_id", "relevance_score", "sentiment_label"))
    return out.select("pilot_entry_id", "article_id", "relevance_score", "sentiment_label", "position")


@query("lineage_news", "J11 A7", """
SELECT pilot_entry_id, a.article_id, a.relevance_score, CAST(row_number() OVER (PARTITION BY pilot_entry_id ORDER BY a.relevance_score DESC, a.article_id) AS INTEGER) AS position
FROM plog l JOIN art_mode a ON a.ticker = l.ticker AND a.prediction_mode = l.prediction_mode AND a.date = l.prediction_date + (-1500) QUALIFY position <= 3""")
def lineage_news(spark, sf):
    """Log rows of late 2001 against the articles of 1,500 days earlier."""
    rows = L.log(spark, sf).withColumn("prediction_date", F.date_sub("prediction_date", 1500))
    out = P.linked_from_lineage(rows, N.row_lineage(NQ.enriched(spark, sf)), I.extractions(spark, sf).select("article_id", "relevance_score"))
    return out.select("pilot_entry_id", "article_id", "relevance_score", "position")


@query("recent_runs", "K7", """
SELECT pilot_entry_id, ticker, prediction_date, status FROM plog WHERE prediction_mode = 'pre_market'
ORDER BY pilot_timestamp_utc DESC NULLS LAST, prediction_date DESC NULLS LAST, pilot_entry_id DESC LIMIT 25""")
def recent_runs(spark, sf):
    return P.recent_runs(L.log(spark, sf), 25, mode="pre_market").select("pilot_entry_id", "ticker", "prediction_date", "status")


cte("drivers", """
SELECT article_id AS pilot_entry_id, unnest([{'f': 'sentiment', 'v': sentiment_score}, {'f': 'relevance', 'v': relevance_score - 0.7}, {'f': 'confidence', 'v': 0.72 - confidence_score},
  {'f': 'severity', 'v': event_severity / 10 - 0.05}]) AS x FROM extractions""")


@query("top_drivers", "K3 X23", f"""
WITH s AS (SELECT pilot_entry_id, x.f AS feature, x.v AS impact, CASE WHEN x.v > 0 THEN 'positive' ELSE 'negative' END AS side FROM drivers WHERE x.v <> 0)
SELECT pilot_entry_id, side, feature, {rnd('impact')} AS impact, CASE WHEN abs(impact) >= 0.08 THEN 'strong' WHEN abs(impact) >= 0.04 THEN 'moderate' ELSE 'light' END AS strength,
  CAST(row_number() OVER (PARTITION BY pilot_entry_id, side ORDER BY abs(impact) DESC, feature) AS INTEGER) AS position FROM s QUALIFY position <= 2""")
def top_drivers(spark, sf):
    rows = I.extractions(spark, sf).select(F.col("article_id").alias("pilot_entry_id"), F.create_map(
        F.lit("sentiment"), F.col("sentiment_score"), F.lit("relevance"), F.col("relevance_score") - 0.7,
        F.lit("confidence"), F.lit(0.72) - F.col("confidence_score"), F.lit("severity"), F.col("event_severity") / 10 - 0.05).alias("m"))
    return P.top_drivers(rows, "m", 2).withColumn("impact", r("impact"))


_names = {"macd": "Trend momentum of the close", "volume_ma_ratio": "Volume against its average"}
_prefixes = {"ret_": "Return over past sessions", "news_event_count_": "Articles of one event type", "news_": "News signal", "ma_": "Moving average"}


@query("feature_descriptions", "X23", f"""
WITH f AS (SELECT DISTINCT unnest([split_part(lower(text), ' ', 1), 'news_' || source, 'macd', 'ret_' || (doc_id % 9), 'news_event_count_' || lang]) AS feature FROM documents)
SELECT feature, CASE {' '.join(f"WHEN feature = '{k}' THEN '{v}'" for k, v in _names.items())} {' '.join(f"WHEN starts_with(feature, '{k}') THEN '{v}'" for k, v in _prefixes.items())}
  ELSE 'Derived feature from ' || array_to_string(list_slice(list_filter(regexp_split_to_array(feature, '[^a-z0-9A-Z]+'), lambda t: t <> ''), 1, 6), ' ') || '.' END AS description FROM f""")
def feature_descriptions(spark, sf):
    docs = I.table(spark, sf, "documents")
    names = docs.select(F.explode(F.array(
        F.substring_index(F.lower("text"), " ", 1), F.concat(F.lit("news_"), "source"), F.lit("macd"),
        F.concat(F.lit("ret_"), (F.col("doc_id") % 9).cast("string")), F.concat(F.lit("news_event_count_"), "lang"))).alias("feature")).distinct()
    return P.describe_features(names, _names, _prefixes)


@query("top_event_counts", "K4", f"""
SELECT ticker, date, prediction_mode, array_to_string(list_transform(list_sort(list_filter([{', '.join(f"row(-news_event_count_{e}, '{e}')" for e in V.EVENT_TYPES)}], lambda p: p[1] < 0)),
  lambda p: p[2] || ':' || CAST(-p[1] AS VARCHAR)), ',') AS events FROM news_agg""")
def top_event_counts(spark, sf):
    rows = N.aggregate_articles(NQ.enriched(spark, sf))
    counts = P.event_counts({e: f"news_event_count_{e}" for e in V.EVENT_TYPES})
    return rows.select("ticker", "date", "prediction_mode", F.array_join(F.transform(
        counts, lambda p: F.concat(p["event"], F.lit(":"), p["n"].cast("string"))), ",").alias("events"))


@query("log_keys", "X22", """
SELECT pilot_entry_id, prediction_key, CASE WHEN b_dir IS NULL OR n_dir IS NULL THEN 'unavailable' WHEN b_dir = n_dir THEN 'agree' ELSE 'disagree' END AS agreement FROM plog""")
def log_keys(spark, sf):
    return L.log(spark, sf).select("pilot_entry_id", "prediction_key", P.model_agreement(
        F.col("baseline_predicted_next_day_direction"), F.col("enhanced_predicted_next_day_direction")).alias("agreement"))


@query("display_fields", "X29", """
SELECT pilot_entry_id, x AS blended_probability, n AS enhanced_probability, b AS baseline_probability,
  CASE WHEN x_dir IS NULL THEN '-' WHEN x_dir = 1 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN coalesce(enhanced_correct, baseline_correct) IS NULL THEN 'pending' WHEN coalesce(enhanced_correct, baseline_correct) THEN 'correct' ELSE 'incorrect' END AS correctness,
  CASE WHEN actual_outcome_status = 'backfilled' AND actual_next_day_direction IS NOT NULL THEN CASE WHEN actual_next_day_direction = 1 THEN 'up' ELSE 'down' END
       ELSE coalesce(actual_outcome_status, '-') END AS outcome FROM plog""")
def display_fields(spark, sf):
    return L.log(spark, sf).select(
        "pilot_entry_id", *[P.shown_probability(m).alias(f"{m}_probability") for m in ("blended", "enhanced", "baseline")],
        P.direction_label(F.col("blended_predicted_next_day_direction")).alias("direction"),
        P.correctness_label().alias("correctness"), P.outcome_label().alias("outcome"))


_providers = IngestSettings().provider_priority


@query("stage_warnings", "X28", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'stage5:marketaux_failed' WHEN 1 THEN 'stage5:nse_rss_failed,stage5:slow' WHEN 2 THEN '' ELSE 'stage5:' || event_type END AS stage5,
  CASE event_id % 4 WHEN 0 THEN 'stage6:marketaux request failed: 500' WHEN 1 THEN 'stage6:nse_rss_failed,stage6:slow' WHEN 2 THEN '' ELSE 'stage6:' || event_type END AS stage6 FROM events""")
def stage_warnings(spark, sf):
    e = F.col("event_id")
    codes = (
        F.when(e % 4 == 0, F.array(F.lit("marketaux request failed: 500"))).when(e % 4 == 1, F.array(F.lit("nse_rss_failed"), F.lit(" slow ")))
        .when(e % 4 == 2, F.array(F.lit("  "))).otherwise(F.array("event_type")))
    return I.table(spark, sf, "events").select(
        "event_id", F.concat_ws(",", P.stage_warnings(codes, "stage5", _providers)).alias("stage5"),
        F.concat_ws(",", P.stage_warnings(codes, "stage6")).alias("stage6"))


@query("value_coercion", "X25", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE NULL END AS b,
  CASE WHEN event_id % 8 IN (3, 4, 6) THEN CASE event_id % 8 WHEN 3 THEN value WHEN 4 THEN 12.75::DOUBLE ELSE NULL END WHEN event_id % 8 = 2 THEN 1.0::DOUBLE END AS d,
  CASE event_id % 8 WHEN 3 THEN CAST(trunc(value) AS BIGINT) WHEN 4 THEN 12::BIGINT WHEN 2 THEN 1::BIGINT END AS i FROM events""")
def value_coercion(spark, sf):
    from tidemark.functions.scalars import to_bool, to_float, to_int

    k = F.col("event_id") % 8
    raw = (
        F.when(k == 0, " TRUE ").when(k == 1, "no").when(k == 2, "1").when(k == 3, F.col("value").cast("string"))
        .when(k == 4, " 12.75").when(k == 5, "abc").when(k == 6, "NaN"))
    return I.table(spark, sf, "events").select(
        "event_id", to_bool(raw).alias("b"), to_float(raw).alias("d"), to_int(raw).alias("i"))


# ---- review ---------------------------------------------------------------------

cte("review_pairs", f"""
SELECT i.ticker, i.exchange, c.date AS market_session_date, m.prediction_mode FROM (SELECT DISTINCT ticker, exchange FROM plog) i
JOIN cal c ON c.is_session AND c.date BETWEEN DATE '{L.START}' AND DATE '{L.END}' CROSS JOIN (VALUES ('pre_market'), ('after_close')) m(prediction_mode)""")
cte("review_rows", """
SELECT p.ticker, p.exchange, p.market_session_date, p.prediction_mode, l.* EXCLUDE (ticker, exchange, market_session_date, prediction_mode),
  l.pilot_entry_id IS NULL AS is_missing, w.raw_n
FROM review_pairs p LEFT JOIN plog_latest l ON l.ticker = p.ticker AND l.market_session_date = p.market_session_date AND l.prediction_mode = p.prediction_mode
LEFT JOIN (SELECT ticker, prediction_mode, market_session_date, count(*) AS raw_n FROM plog GROUP BY ALL) w
  ON w.ticker = p.ticker AND w.market_session_date = p.market_session_date AND w.prediction_mode = p.prediction_mode""")
cte("review_notes", """
SELECT *, CASE WHEN is_missing THEN 'missing_expected_run' ELSE concat_ws(';', CASE WHEN status = 'abstain' THEN 'abstain' END,
  CASE WHEN status IN ('partial_failure', 'failure') THEN status || ':' || failure_stage END, CASE WHEN fallback_heavy_flag THEN 'fallback_heavy' END,
  CASE WHEN degraded THEN 'degraded_news' END, CASE WHEN runtime_warning_flag THEN 'runtime_warning' END, CASE WHEN news_article_count = 0 THEN 'zero_news' END,
  'quality_grade:' || data_quality_grade, CASE WHEN selected_action = 'abstain' THEN 'abstain_reasons:low_conviction_margin,zero_news' END,
  'news_quality_note:' || news_quality_note, 'source_outage_note:' || source_outage_note,
  CASE actual_outcome_status WHEN 'pending' THEN 'actual_pending' WHEN 'market_data_unavailable' THEN 'actual_market_data_unavailable' END) END AS notes FROM review_rows""")


def pairs(spark, sf):
    return R.expected_pairs(L.log(spark, sf), I.calendar(spark), L.START, L.END)


@query("expected_pairs", "J12", "SELECT * FROM review_pairs")
def expected_pairs(spark, sf):
    return pairs(spark, sf)


@query("missing_pairs", "J12", "SELECT ticker, exchange, market_session_date, prediction_mode FROM review_rows WHERE is_missing")
def missing_pairs(spark, sf):
    return R.missing_pairs(L.log(spark, sf), pairs(spark, sf))


@query("daily_grid", "L4 J12 X24 F12", """
SELECT ticker, exchange, market_session_date, prediction_mode, CASE WHEN is_missing THEN 'missing' ELSE status END AS status, pilot_entry_id,
  CASE WHEN is_missing THEN 'missing' ELSE coalesce(actual_outcome_status, 'pending') END AS actual_outcome_status, notes, is_missing FROM review_notes""")
def daily_grid(spark, sf):
    out = R.daily_grid(L.log(spark, sf), pairs(spark, sf))
    return out.select(*KEYS, "market_session_date", "prediction_mode", "status", "pilot_entry_id", "actual_outcome_status",
                      F.array_join("notes", ";").alias("notes"), "is_missing")


@query("degraded_rows", "F12", "SELECT pilot_entry_id, degraded FROM plog")
def degraded_rows(spark, sf):
    return L.log(spark, sf).select("pilot_entry_id", R.degraded_news().alias("degraded"))


cte("review_summary", """
SELECT ticker, exchange, prediction_mode, count(*) AS expected_pair_count, count(pilot_entry_id) AS selected_row_count, CAST(coalesce(sum(raw_n), 0) AS BIGINT) AS observed_raw_row_count,
  count(*) FILTER (status = 'success') AS success_row_count, count(*) FILTER (status = 'abstain') AS abstain_row_count, count(*) FILTER (status = 'partial_failure') AS partial_failure_count,
  count(*) FILTER (status = 'failure') AS failure_row_count, count(*) FILTER (actual_outcome_status = 'backfilled') AS backfilled_row_count,
  count(*) FILTER (NOT is_missing AND coalesce(actual_outcome_status, 'pending') = 'pending') AS pending_actual_row_count,
  count(*) FILTER (actual_outcome_status = 'market_data_unavailable') AS market_data_unavailable_row_count, count(*) FILTER (disagreement_flag) AS disagreement_count,
  avg(CAST(disagreement_flag AS INTEGER)) AS disagreement_rate, count(*) FILTER (fallback_heavy_flag) AS fallback_heavy_count, count(*) FILTER (degraded) AS degraded_news_row_count,
  count(*) FILTER (news_article_count = 0) AS zero_news_count, count(*) FILTER (news_quality_note IS NOT NULL OR source_outage_note IS NOT NULL) AS manual_note_row_count,
  count(source_outage_note) AS source_outage_note_count, avg(CAST(baseline_correct AS INTEGER)) AS baseline_accuracy, avg(CAST(enhanced_correct AS INTEGER)) AS enhanced_accuracy,
  count(total_duration_seconds) AS duration_row_count, avg(total_duration_seconds) AS average_total_duration_seconds, max(total_duration_seconds) AS max_total_duration_seconds,
  avg(stage5_duration_seconds) AS average_stage5_duration_seconds, avg(stage6_duration_seconds) AS average_stage6_duration_seconds,
  CAST(coalesce(sum(k % 4), 0) AS BIGINT) AS stage5_provider_request_retry_count_sum, CAST(coalesce(sum(k % 2), 0) AS BIGINT) AS stage5_article_fetch_retry_count_sum,
  CAST(coalesce(sum(k % 7), 0) AS BIGINT) AS stage6_retry_count_sum, count(*) FILTER (runtime_warning_flag) AS runtime_warning_count
FROM review_rows GROUP BY GROUPING SETS ((ticker, exchange, prediction_mode), (ticker, exchange))""")
cte("review_status", """
SELECT *, greatest(observed_raw_row_count - selected_row_count, 0) AS rerun_row_count, expected_pair_count - selected_row_count AS missing_pair_count,
  CASE WHEN selected_row_count = 0 THEN 'unavailable' WHEN selected_row_count < expected_pair_count THEN 'partial' ELSE 'complete' END AS coverage_status FROM review_summary""")
_sum_int = ("expected_pair_count", "selected_row_count", "observed_raw_row_count", "success_row_count", "abstain_row_count", "partial_failure_count",
            "failure_row_count", "backfilled_row_count", "pending_actual_row_count", "market_data_unavailable_row_count", "disagreement_count",
            "fallback_heavy_count", "degraded_news_row_count", "zero_news_count", "manual_note_row_count", "source_outage_note_count",
            "duration_row_count", "stage5_provider_request_retry_count_sum", "stage5_article_fetch_retry_count_sum", "stage6_retry_count_sum",
            "runtime_warning_count", "rerun_row_count", "missing_pair_count")
_sum_dbl = ("disagreement_rate", "baseline_accuracy", "enhanced_accuracy", "average_total_duration_seconds", "max_total_duration_seconds",
            "average_stage5_duration_seconds", "average_stage6_duration_seconds")


@query("log_summary", "A14 A15", f"""
SELECT ticker, exchange, prediction_mode, coverage_status, {', '.join(_sum_int)}, {', '.join(f'{rnd(c)} AS {c}' for c in _sum_dbl)} FROM review_status""")
def log_summary(spark, sf):
    out = R.log_summary(L.log(spark, sf), pairs(spark, sf))
    return out.select(*KEYS, "prediction_mode", "coverage_status", *_sum_int, *[r(c).alias(c) for c in _sum_dbl])


def _issue(c: str, text: str) -> str:
    return f"CASE WHEN s.{c} > 0 THEN s.{c} || '{text}' END"


@query("operational_issues", "L5 A15 A16", f"""
SELECT s.ticker, s.exchange, s.coverage_status, concat_ws('; ', CASE WHEN s.coverage_status = 'unavailable' THEN 'no log rows in the review window' WHEN s.missing_pair_count > 0 THEN s.missing_pair_count || ' expected mode-day pairs are missing' END,
  {_issue('partial_failure_count', ' rows failed in part')}, {_issue('failure_row_count', ' rows failed')}, {_issue('abstain_row_count', ' rows abstained')},
  {_issue('pending_actual_row_count', ' rows wait for their outcome')}, {_issue('market_data_unavailable_row_count', ' rows have no market data for their outcome')},
  {_issue('source_outage_note_count', ' rows carry source outage notes')}, {_issue('fallback_heavy_count', ' rows were fallback-heavy')}, {_issue('degraded_news_row_count', ' rows had degraded news')},
  CASE WHEN s.stage5_provider_request_retry_count_sum > 0 OR s.stage5_article_fetch_retry_count_sum > 0 THEN s.stage5_provider_request_retry_count_sum || ' provider retries and ' || s.stage5_article_fetch_retry_count_sum || ' article retries' END,
  {_issue('stage6_retry_count_sum', ' scoring retries')}, {_issue('runtime_warning_count', ' rows ran longer than the warning threshold')},
  CASE WHEN w.pending_slot_count > 0 THEN w.pending_slot_count || ' planned slots are pending' END,
  CASE WHEN w.failure_slot_count > 0 OR w.partial_failure_slot_count > 0 THEN w.partial_failure_slot_count || ' planned slots failed in part and ' || w.failure_slot_count || ' failed' END) AS issues,
  s.average_total_duration_seconds IS NOT NULL AS has_run_times
FROM review_status s LEFT JOIN week_status w USING (ticker, exchange) WHERE s.prediction_mode IS NULL""")
def operational_issues(spark, sf):
    summary = R.log_summary(L.log(spark, sf), pairs(spark, sf))
    out = R.operational_issues(summary, WQ.week_state(spark, sf))
    timing = F.filter("issues", lambda i: i.startswith("run time averaged"))
    return out.select(*KEYS, "coverage_status", F.array_join(F.filter(
        "issues", lambda i: ~i.startswith("run time averaged")), "; ").alias("issues"), (F.size(timing) > 0).alias("has_run_times"))


@query("claim_checks", "L7", """
SELECT ticker, exchange, coverage_status, expected_pair_count, selected_row_count AS available_pair_count, true AS offline_claims_are_backed, selected_row_count > 0 AS log_claims_are_backed,
  coverage_status = 'complete' AS operational_reliability_supported, CASE coverage_status WHEN 'unavailable' THEN 'no_log_rows' WHEN 'partial' THEN 'incomplete_window' ELSE 'complete_window' END AS reliability_note
FROM review_status WHERE prediction_mode IS NULL""")
def claim_checks(spark, sf):
    return R.claim_checks(R.log_summary(L.log(spark, sf), pairs(spark, sf)))


@query("variant_snapshot", "L6", f"""
SELECT prediction_mode, model_variant, max(row_count) FILTER (subset_name = 'all_rows') AS all_rows_count, max(accuracy) FILTER (subset_name = 'all_rows') AS all_rows_accuracy,
  max(row_count) FILTER (subset_name = 'fresh_news_rows') AS fresh_rows_count, max(brier_score) FILTER (subset_name = 'fresh_news_rows') AS fresh_rows_brier,
  max(roc_auc) FILTER (subset_name = 'quality_grade_c_or_worse_rows') AS low_quality_auc FROM ev_table GROUP BY prediction_mode, model_variant""")
def variant_snapshot(spark, sf):
    from tidemark.operators import evaluation as EV
    from tidemark.operators import metrics as M

    out = R.variant_snapshot(EV.metric_table(EQ.full_frame(spark, sf), MODES), M.METRIC_ORDER)
    return out.select(
        "prediction_mode", "model_variant", F.col("all_rows.row_count").alias("all_rows_count"), r("all_rows.accuracy").alias("all_rows_accuracy"),
        F.col("fresh_news_rows.row_count").alias("fresh_rows_count"), r("fresh_news_rows.brier_score").alias("fresh_rows_brier"),
        r("quality_grade_c_or_worse_rows.roc_auc").alias("low_quality_auc"))


@query("table_lineage", "L9", """
SELECT * FROM (VALUES ('bars', true, ''), ('extractions', false, 'content'), ('calendar', false, 'formula_version'), ('events', false, 'feature_columns')) t(table_name, aligned, differences)""")
def table_lineage(spark, sf):
    """Fingerprints of whole tables, compared with versions that differ in one respect."""
    bars, news = I.bars(spark, sf), I.extractions(spark, sf)
    cal, events = I.calendar(spark), I.table(spark, sf, "events")

    def prints(b, e, c, v, version):
        out = R.table_fingerprint(b, "5", "bars")
        for df, ver, name in ((e, "4", "extractions"), (c, version, "calendar"), (v, "1", "events")):
            out = out.unionByName(R.table_fingerprint(df, ver, name))
        return out

    saved = prints(bars.repartition(7), news, cal, events.drop("props"), "0")
    changed = news.withColumn("relevance_score", F.when(F.col("k") == 7, 0.99).otherwise(F.col("relevance_score")))
    current = prints(bars, changed, cal, events, "1")
    out = R.lineage_check(saved, current)
    # A changed column list also changes the content; the first difference names the cause.
    return out.select("table_name", "aligned", F.when(F.size("differences") > 0, F.get("differences", F.lit(0))).otherwise("").alias("differences"))


@query("log_sink_round_trip", "S9 L1 J10", _backfill_sql("true"))
def log_sink_round_trip(spark, sf):
    """The log in files: two runs appended, one of them again and one cut short, outcomes filled in twice, read back."""
    from uuid import uuid4

    path = f"{tables.shared_folder(spark)}/log-{uuid4().hex[:12]}"
    log, day = L.log(spark, sf), F.dayofyear("prediction_date")
    early, late = log.where(F.coalesce(day % 2 == 0, F.lit(True))), log.where(day % 2 == 1)
    PL.append_run(early, path, "run-1")
    PL.append_run(early, path, "run-1")
    PL.write_append(late.where(day % 3 == 0), path)  # run-2 died after a part of its rows
    PL.append_run(late, path, "run-2")
    for _ in range(2):
        PL.rewrite_run(spark, path, "outcomes-1", lambda rows: P.backfill(rows, I.bars(spark, sf), now()))
    return PL.read_log(spark, path).select(*_OUT)


@query("stage_versions", "S8 L9", """
SELECT ticker AS part, 'content' AS reason FROM (SELECT ticker, count(*) FILTER (date < DATE '1998-06-01' AND volume > 60) AS n FROM bars GROUP BY ticker) WHERE n > 0""")
def stage_versions(spark, sf):
    """Bars stored as a version; after a change only the instruments it touches are stale."""
    from uuid import uuid4

    path = f"{tables.shared_folder(spark)}/bars-{uuid4().hex[:12]}"
    bars = I.bars(spark, sf)
    tables.write_version(bars, path, "bars", "5", "ticker")
    changed = bars.withColumn("volume", F.when(
        (F.col("date") < F.lit("1998-06-01").cast("date")) & (F.col("volume") > 60), F.col("volume") + 1).otherwise(F.col("volume")))
    return tables.stale_parts(spark, path, changed)
