"""Append-only prediction log: fixed layout, append, read by instrument."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import COPIES, duplicate_rule, with_copies

_S, _I, _D, _B, _DT, _TS = "string", "int", "double", "boolean", "date", "timestamp"
_PROBABILITIES = ("raw_predicted_probability_up", "calibrated_predicted_probability_up", "predicted_probability_up")

# Columns of the log in table order, with their types.
LOG_COLUMNS: tuple[tuple[str, str], ...] = (
    ("pilot_entry_id", _S), ("prediction_key", _S), ("prediction_attempt_number", _I), ("ticker", _S),
    ("exchange", _S), ("prediction_mode", _S), ("pilot_run_id", _S), ("pilot_timestamp_utc", _TS),
    ("pilot_timestamp_market", _TS), ("market_session_date", _DT), ("historical_cutoff_date", _DT),
    ("news_cutoff_timestamp_utc", _TS), ("historical_date", _DT), ("historical_market_gap_flag", _I),
    ("historical_market_gap_count_5d", _I), ("prediction_date", _DT),
    *((f"{m}_{c}", _I if c == "predicted_next_day_direction" else _D)
      for m in ("baseline", "enhanced", "blended") for c in ("predicted_next_day_direction", *_PROBABILITIES)),
    ("selected_action", _S), ("abstain_flag", _B), ("selective_probability_margin", _D),
    ("selective_required_margin", _D), ("abstain_reason_codes_json", "array<string>"), ("news_context_weight", _D),
    ("disagreement_flag", _B), ("news_article_count", _I), ("news_warning_article_count", _I),
    ("news_fallback_article_ratio", _D), ("news_avg_confidence", _D), ("news_volume_3d", _D),
    ("news_sentiment_3d", _D), ("news_sentiment_dispersion_1d", _D), ("news_directional_agreement_rate", _D),
    ("has_fresh_news", _I), ("is_carried_forward", _I), ("is_fallback_heavy", _I), ("news_signal_state", _S),
    ("fallback_heavy_flag", _B), ("news_feature_synthetic_flag", _B), ("linked_article_ids_json", "array<string>"),
    ("top_event_counts_json", "map<string,int>"), ("warning_codes_json", "array<string>"), ("status", _S),
    ("failure_stage", _S), ("failure_message", _S), ("total_duration_seconds", _D), ("runtime_warning_flag", _B),
    ("runtime_warning_message", _S), ("data_quality_score", _D), ("data_quality_grade", _S),
    ("data_quality_reasons_json", "array<string>"), ("data_quality_components_json", "map<string,double>"),
    ("pilot_snapshot_path", _S), ("stage2_cleaned_path", _S), ("stage2_metadata_path", _S), ("stage2_run_id", _S),
    ("stage2_duration_seconds", _D), ("stage5_processed_news_path", _S), ("stage5_metadata_path", _S),
    ("stage5_run_id", _S), ("stage5_duration_seconds", _D), ("stage5_provider_request_count", _I),
    ("stage5_provider_request_retry_count", _I), ("stage5_article_fetch_attempt_count", _I),
    ("stage5_article_fetch_retry_count", _I), ("stage6_extraction_path", _S), ("stage6_metadata_path", _S),
    ("stage6_failure_log_path", _S), ("stage6_run_id", _S), ("stage6_duration_seconds", _D),
    ("stage6_provider_request_count", _I), ("stage6_retry_count", _I), ("stage7_feature_path", _S),
    ("stage7_metadata_path", _S), ("stage7_raw_snapshot_path", _S), ("stage7_run_id", _S),
    ("stage7_duration_seconds", _D), ("baseline_model_path", _S), ("baseline_model_metadata_path", _S),
    ("baseline_model_run_id", _S), ("baseline_duration_seconds", _D), ("enhanced_model_path", _S),
    ("enhanced_model_metadata_path", _S), ("enhanced_model_run_id", _S), ("enhanced_duration_seconds", _D),
    ("enhanced_feature_contributions_json", "map<string,double>"),
    ("recent_news_summaries_json", "array<string>"), ("actual_historical_close", _D),
    ("actual_prediction_close", _D), ("actual_next_day_direction", _I), ("actual_outcome_status", _S),
    ("actual_outcome_backfilled_at_utc", _TS), ("actual_backfill_error", _S), ("baseline_correct", _B),
    ("enhanced_correct", _B), ("blended_correct", _B), ("news_quality_note", _S), ("market_shock_note", _S),
    ("source_outage_note", _S), ("manual_notes_updated_at_utc", _TS),
)
LOG_DDL = ", ".join(f"{n} {t}" for n, t in LOG_COLUMNS)


def conform(rows: DataFrame) -> DataFrame:
    """Exactly the log columns, in order; absent ones are null and unknown ones are dropped."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in LOG_COLUMNS])


def append_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    return conform(log).unionByName(conform(rows))


def write_append(rows: DataFrame, path: str) -> None:
    """Append to the stored log, one folder per mode and prediction month."""
    conform(rows).withColumn("prediction_month", F.date_format("prediction_date", "yyyy-MM")).write.mode(
        "append").partitionBy("prediction_mode", "prediction_month").parquet(path)


def _dated(rows: DataFrame) -> DataFrame:
    return conform(rows).withColumn("prediction_month", F.date_format("prediction_date", "yyyy-MM"))


def _stored(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What is stored, or nothing where the folder does not exist yet."""
    try:
        return read()
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in (absent.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, kind) of the runs whose rows are surely in the log."""
    return _stored(spark, lambda: spark.read.schema("run_id string, kind string").json(f"{path}/_runs"), "run_id string, kind string")


def _is_committed(spark: SparkSession, path: str, run_id: str, kind: str) -> bool:
    return committed_runs(spark, path).where((F.col("run_id") == run_id) & (F.col("kind") == kind)).limit(1).count() > 0


def _commit(spark: SparkSession, path: str, run_id: str, kind: str) -> None:
    spark.createDataFrame([(run_id, kind)], "run_id string, kind string").coalesce(1).write.mode("append").json(f"{path}/_runs")


def append_run(rows: DataFrame, path: str, run_id: str) -> bool:
    """Append a run's rows once, however often it is tried; False if the run was there already.

    The manifest of runs is written after the rows. A run that died between the two is told by its
    entry ids: rows whose id is in the log already, in the months they touch, are left out. One id
    that occurs twice within the rows is one row. Rows without an id have the manifest alone.
    """
    spark = rows.sparkSession
    if _is_committed(spark, path, run_id, "append"):
        return False
    new = _dated(rows)
    schema = f"{LOG_DDL}, prediction_month string"
    have = _stored(spark, lambda: spark.read.schema(schema).parquet(path), schema).select(
        "prediction_mode", "prediction_month", "pilot_entry_id")
    touched = new.select("prediction_mode", "prediction_month").distinct()
    same_folder = (touched["prediction_mode"].eqNullSafe(have["prediction_mode"])
                   & touched["prediction_month"].eqNullSafe(have["prediction_month"]))
    known = have.join(touched, same_folder, "left_semi").select("pilot_entry_id")
    # Known ids leave first: the rank of a copy then needs no shuffle of the wide rows beside the join's, and rows
    # without an id take part in neither.
    fresh = new.where("pilot_entry_id IS NOT NULL").join(known, "pilot_entry_id", "left_anti")
    once = with_copies(fresh, ["pilot_entry_id"]).where(~duplicate_rule()).drop(COPIES)
    once.unionByName(new.where("pilot_entry_id IS NULL")).write.mode("append").partitionBy(
        "prediction_mode", "prediction_month").parquet(path)
    _commit(spark, path, run_id, "append")
    return True


def rewrite_run(spark: SparkSession, path: str, run_id: str, update: Callable[[DataFrame], DataFrame],
                touched: Column | None = None) -> bool:
    """Replace the log's folders that hold rows of `touched` by update(their rows), once per run; False if it was done.

    The updated rows are staged whole before any folder is replaced, and the folders are replaced by one
    dynamic overwrite, so a run that died is simply run again. Folders without touched rows keep their files.
    """
    if _is_committed(spark, path, run_id, "rewrite"):
        return False
    stored = spark.read.schema(f"{LOG_DDL}, prediction_month string").parquet(path)
    folders = stored.where(touched if touched is not None else F.lit(True)).select(
        F.col("prediction_mode").alias("_mode"), F.col("prediction_month").alias("_month")).distinct()
    inside = stored.join(folders, stored["prediction_mode"].eqNullSafe(folders["_mode"])
                         & stored["prediction_month"].eqNullSafe(folders["_month"]), "left_semi")
    staged = f"{path}/_staging/{run_id}-{uuid4().hex[:8]}"
    _dated(update(conform(inside))).write.parquet(staged)
    done = spark.read.schema(f"{LOG_DDL}, prediction_month string").parquet(staged)
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "prediction_mode", "prediction_month").parquet(path)
    _commit(spark, path, run_id, "rewrite")
    return True


def read_log(spark, path: str) -> DataFrame:
    return conform(spark.read.schema(f"{LOG_DDL}, prediction_month string").parquet(path))


def rewrite_months(updated: DataFrame, path: str) -> None:
    """Replace the mode and month folders present in `updated`, leaving the others alone.

    `updated` must not be read lazily from the same folders; write it to a staging table
    first and pass that table.
    """
    conform(updated).withColumn("prediction_month", F.date_format("prediction_date", "yyyy-MM")).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "prediction_mode", "prediction_month").parquet(path)


def instrument_log(log: DataFrame, ticker: str, exchange: str) -> DataFrame:
    """Rows of both modes of one instrument."""
    return log.where((F.upper("ticker") == ticker.upper()) & (F.upper("exchange") == exchange.upper()))


def prediction_key(ticker: Column, exchange: Column, mode: Column, day: Column) -> Column:
    return F.concat_ws("|", F.upper(F.trim(ticker)), F.upper(F.trim(exchange)), mode, day.cast("string"))


def entry_id(key: Column, run_id: Column) -> Column:
    return F.concat_ws("|", key, run_id)
