"""A prediction log derived from the events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.queries import inputs as I
from tidemark.queries.oracle import cte
from tidemark.sources import prediction_log as L

GRADES = ("A", "B", "C", "D", "E", "F")
START, END = "2001-09-27", "2001-11-02"


def events(spark, sf) -> DataFrame:
    return I.table(spark, sf, "events").withColumn(
        "at", F.col("ts") - F.make_dt_interval(F.lit(I.EVENT_SHIFT_DAYS)))


def log(spark, sf) -> DataFrame:
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.round(F.col("value") * 100).cast("long")
    cal = I.calendar(spark).select(
        "exchange", F.col("date").alias("day"), "on_or_after", "on_or_before", "previous_session", "next_session")
    rows = events(spark, sf).withColumns({
        "exchange": F.lit("NSE"), "ticker": F.concat(F.lit("N"), (F.col("user_id") % 25).cast("string")),
        "prediction_mode": F.when(e % 2 == 0, "pre_market").otherwise("after_close"),
        "day": F.to_date(F.from_utc_timestamp("at", I.MARKET.timezone)), "k": k, "v": v,
        "status": F.when(F.col("event_type") == "view", "abstain").when(F.col("event_type") == "purchase", "partial_failure")
        .when(F.col("event_type") == "error", "failure").otherwise("success"),
    }).join(F.broadcast(cal), ["exchange", "day"])
    k, v, status = F.col("k"), F.col("v"), F.col("status")
    pre = F.col("prediction_mode") == "pre_market"
    rows = rows.withColumns({
        "market_session_date": F.when(pre, F.col("on_or_after")).otherwise(F.col("on_or_before")),
        "prediction_date": F.when(pre, F.col("on_or_after")).otherwise(F.col("next_session")),
        "historical_cutoff_date": F.when(pre, F.col("previous_session")).otherwise(F.col("on_or_before")),
        "b": F.when(status != "failure", (v % 100) / 100.0),
        "n": F.when(status.isin("success", "abstain"), ((k * 37) % 100) / 100.0),
        "actual_outcome_status": F.when(e % 3 == 0, "backfilled").when(e % 7 == 0, "market_data_unavailable")
        .when(e % 5 == 0, None).otherwise("pending"),
    })
    b, n, done = F.col("b"), F.col("n"), F.col("actual_outcome_status") == "backfilled"
    x = (b + n) / 2.0
    rows = rows.withColumns({
        "prediction_key": L.prediction_key(F.col("ticker"), F.col("exchange"), F.col("prediction_mode"), F.col("prediction_date")),
        "pilot_timestamp_utc": F.when(e % 41 != 0, F.col("at")),
        "historical_date": F.when(e % 53 != 0, F.col("historical_cutoff_date")),
        "baseline_predicted_next_day_direction": (b >= 0.5).cast("int"),
        "enhanced_predicted_next_day_direction": (n >= 0.5).cast("int"),
        "blended_predicted_next_day_direction": (x >= 0.5).cast("int"),
        "baseline_predicted_probability_up": b, "enhanced_raw_predicted_probability_up": n,
        "blended_calibrated_predicted_probability_up": x,
        "selected_action": F.when(status == "abstain", "abstain").when(status == "success", F.when(x >= 0.5, "up").otherwise("down")),
        "abstain_reason_codes_json": F.when(status == "abstain", F.array(F.lit("low_conviction_margin"), F.lit("zero_news"))),
        "disagreement_flag": (b >= 0.5) != (n >= 0.5),
        "news_article_count": F.when(status != "failure", k % 5),
        "fallback_heavy_flag": k % 7 == 0,
        "warning_codes_json": F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(F.lit("zero_news_available")))
        .when(k % 6 == 2, F.array(F.lit("stage5:degraded_source_google_only"), F.lit("other")))
        .when(k % 6 == 3, F.array(F.lit("stage6:recovery_exhausted_present"))).when(k % 6 == 4, F.array(F.lit("runtime_warning"))),
        "data_quality_grade": I.pick(GRADES, k % 6),
        "failure_stage": F.when(status == "failure", "stage2").when(status == "partial_failure", "enhanced"),
        "total_duration_seconds": F.when(e % 47 != 0, F.col("value")),
        "stage5_duration_seconds": F.when(e % 3 != 0, F.col("value") / 2), "stage6_duration_seconds": F.col("value") / 4,
        "stage5_provider_request_count": k % 3, "stage5_provider_request_retry_count": k % 4,
        "stage5_article_fetch_attempt_count": k % 5, "stage5_article_fetch_retry_count": k % 2,
        "stage6_provider_request_count": k % 6, "stage6_retry_count": k % 7,
        "runtime_warning_flag": F.col("value") > 120,
        "actual_backfill_error": F.when(F.col("actual_outcome_status") == "market_data_unavailable",
                                        F.when(e % 2 == 0, "missing_historical_date").otherwise("prediction_window_market_data_unavailable")),
        "actual_next_day_direction": F.when(done, k % 2),
        "baseline_correct": F.when(done, (b >= 0.5).cast("int") == k % 2),
        "enhanced_correct": F.when(done, (n >= 0.5).cast("int") == k % 2),
        "news_quality_note": F.when(e % 59 == 0, F.concat(F.lit("note "), e.cast("string"))),
        "source_outage_note": F.when(e % 61 == 0, "outage"),
        "linked_article_ids_json": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((e + i) % 1500).cast("string")),
    })
    return L.conform(rows.withColumn("pilot_entry_id", L.entry_id(F.col("prediction_key"), e.cast("string"))))


cte("log_events", """
SELECT event_id, user_id, event_type, value, ts - to_days(8127) AS run_ts, CAST(ts - to_days(8127) + INTERVAL 330 MINUTE AS DATE) AS day,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(round(value * 100) AS BIGINT) AS v FROM events""")
cte("log_placed", """
SELECT e.*, 'NSE' AS exchange, 'N' || (user_id % 25) AS ticker, CASE WHEN event_id % 2 = 0 THEN 'pre_market' ELSE 'after_close' END AS prediction_mode,
  CASE event_type WHEN 'view' THEN 'abstain' WHEN 'purchase' THEN 'partial_failure' WHEN 'error' THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN event_id % 2 = 0 THEN c.on_or_after ELSE c.on_or_before END AS market_session_date,
  CASE WHEN event_id % 2 = 0 THEN c.on_or_after ELSE c.next_session END AS prediction_date,
  CASE WHEN event_id % 2 = 0 THEN c.previous_session ELSE c.on_or_before END AS historical_cutoff_date,
  CASE WHEN event_id % 3 = 0 THEN 'backfilled' WHEN event_id % 7 = 0 THEN 'market_data_unavailable' WHEN event_id % 5 = 0 THEN NULL ELSE 'pending' END AS actual_outcome_status
FROM log_events e JOIN cal c ON c.date = e.day""")
cte("log_probs", """
SELECT *, CASE WHEN status <> 'failure' THEN (v % 100) / 100.0::DOUBLE END AS b,
  CASE WHEN status IN ('success', 'abstain') THEN ((k * 37) % 100) / 100.0::DOUBLE END AS n,
  ticker || '|' || exchange || '|' || prediction_mode || '|' || prediction_date AS prediction_key FROM log_placed""")
cte("plog", """
SELECT *, prediction_key || '|' || event_id AS pilot_entry_id, CASE WHEN event_id % 41 <> 0 THEN run_ts END AS pilot_timestamp_utc,
  CASE WHEN event_id % 53 <> 0 THEN historical_cutoff_date END AS historical_date,
  CAST(b >= 0.5 AS INTEGER) AS b_dir, CAST(n >= 0.5 AS INTEGER) AS n_dir, (b + n) / 2 AS x, CAST((b + n) / 2 >= 0.5 AS INTEGER) AS x_dir,
  CASE status WHEN 'abstain' THEN 'abstain' WHEN 'success' THEN CASE WHEN (b + n) / 2 >= 0.5 THEN 'up' ELSE 'down' END END AS selected_action,
  (b >= 0.5) <> (n >= 0.5) AS disagreement_flag, CASE WHEN status <> 'failure' THEN k % 5 END AS news_article_count, k % 7 = 0 AS fallback_heavy_flag,
  CASE k % 6 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END OR k % 7 = 0 AS degraded,
  (['A', 'B', 'C', 'D', 'E', 'F'])[1 + k % 6] AS data_quality_grade,
  CASE status WHEN 'failure' THEN 'stage2' WHEN 'partial_failure' THEN 'enhanced' END AS failure_stage,
  CASE WHEN event_id % 47 <> 0 THEN value END AS total_duration_seconds, CASE WHEN event_id % 3 <> 0 THEN value / 2 END AS stage5_duration_seconds,
  value / 4 AS stage6_duration_seconds, value > 120 AS runtime_warning_flag,
  CASE WHEN actual_outcome_status = 'market_data_unavailable' THEN CASE WHEN event_id % 2 = 0 THEN 'missing_historical_date' ELSE 'prediction_window_market_data_unavailable' END END AS actual_backfill_error,
  CASE WHEN actual_outcome_status = 'backfilled' THEN k % 2 END AS actual_next_day_direction,
  CASE WHEN actual_outcome_status = 'backfilled' THEN CAST(b >= 0.5 AS INTEGER) = k % 2 END AS baseline_correct,
  CASE WHEN actual_outcome_status = 'backfilled' THEN CAST(n >= 0.5 AS INTEGER) = k % 2 END AS enhanced_correct,
  CASE WHEN event_id % 59 = 0 THEN 'note ' || event_id END AS news_quality_note, CASE WHEN event_id % 61 = 0 THEN 'outage' END AS source_outage_note
FROM log_probs""")
cte("plog_latest", """
SELECT * FROM plog QUALIFY row_number() OVER (PARTITION BY ticker, exchange, prediction_mode, market_session_date
  ORDER BY pilot_timestamp_utc DESC NULLS FIRST, pilot_entry_id DESC) = 1""")
