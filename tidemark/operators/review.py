"""Coverage review of the log: daily grid, notes, summaries, issues, claims, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prediction_log import BACKFILLED, MODE_KEYS, PENDING, UNAVAILABLE, latest_rows
from tidemark.functions.scalars import clean_text
from tidemark.settings import KEYS, MODES

# Warning codes and prefixes that mark degraded news.
DEGRADED_PREFIXES = ("stage5:degraded_source_", "stage6:recovery_exhausted", "stage6:recovery_skipped")
DEGRADED_CODES = ("zero_news_available", "zero_news_row_synthesized", "stage5:no_articles_found")
STATUSES = ("success", "abstain", "partial_failure", "failure")


def degraded_news() -> Column:
    """Fallback-heavy rows and rows whose warnings name degraded news."""
    def bad(code: Column) -> Column:
        return reduce(lambda a, b: a | b, [code.startswith(p) for p in DEGRADED_PREFIXES]) | code.isin(*DEGRADED_CODES)
    return F.coalesce(F.col("fallback_heavy_flag"), F.lit(False)) | F.coalesce(
        F.exists("warning_codes_json", bad), F.lit(False))


def row_notes() -> Column:
    """Compact review notes of one log row, in reporting order."""
    status = F.coalesce(clean_text(F.col("status")), F.lit("unknown"))
    stage = clean_text(F.col("failure_stage"))
    failed = status.isin("partial_failure", "failure")
    reasons = F.slice(F.coalesce("abstain_reason_codes_json", F.array().cast("array<string>")), 1, 3)
    attempt = F.col("prediction_attempt_number")
    return F.array_compact(F.array(
        F.when(status == "abstain", "abstain"),
        F.when(failed, F.concat_ws(":", status, stage)),
        F.when(F.col("fallback_heavy_flag"), "fallback_heavy"),
        F.when(degraded_news(), "degraded_news"),
        F.when(F.col("runtime_warning_flag"), "runtime_warning"),
        F.when(F.col("news_article_count") == 0, "zero_news"),
        F.when(clean_text(F.col("data_quality_grade")).isNotNull(), F.concat(F.lit("quality_grade:"), F.col("data_quality_grade"))),
        F.when((F.col("selected_action") == "abstain") & (F.size(reasons) > 0),
               F.concat(F.lit("abstain_reasons:"), F.array_join(reasons, ","))),
        F.when(attempt > 1, F.concat(F.lit("rerun_attempt_"), attempt.cast("string"))),
        *[F.when(clean_text(F.col(n)).isNotNull(), F.concat(F.lit(f"{n}:"), clean_text(F.col(n))))
          for n in ("news_quality_note", "market_shock_note", "source_outage_note")],
        F.when(F.col("actual_outcome_status") == PENDING, "actual_pending")
        .when(F.col("actual_outcome_status") == UNAVAILABLE, "actual_market_data_unavailable"),
    ))


def expected_pairs(instruments: DataFrame, calendar: DataFrame, start: str, end: str,
                   modes: tuple[str, ...] = MODES) -> DataFrame:
    """Every (instrument, session, mode) of the review window."""
    sessions = calendar.where("is_session").select("exchange", F.col("date").alias("market_session_date"))
    days = instruments.select(*KEYS).distinct().withColumn("market_session_date", F.explode(
        F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return days.join(F.broadcast(sessions), ["exchange", "market_session_date"]).withColumn(
        "prediction_mode", F.explode(F.array(*[F.lit(m) for m in modes])))


def daily_grid(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Latest log row of every expected pair; pairs without one are `missing`."""
    keys = [*KEYS, "market_session_date", "prediction_mode"]
    rows = latest_rows(log).withColumn("_hit", F.lit(True))
    out = pairs.join(rows, keys, "left")
    missing = F.col("_hit").isNull()
    noted = out.withColumn("notes", F.when(missing, F.array(F.lit("missing_expected_run"))).otherwise(row_notes()))
    return noted.withColumns({
        "status": F.when(missing, "missing").otherwise(F.coalesce(clean_text(F.col("status")), F.lit("unknown"))),
        "actual_outcome_status": F.when(missing, "missing").otherwise(
            F.coalesce(clean_text(F.col("actual_outcome_status")), F.lit(PENDING))),
        "is_missing": missing,
    }).drop("_hit")


def missing_pairs(log: DataFrame, pairs: DataFrame) -> DataFrame:
    keys = [*KEYS, "market_session_date", "prediction_mode"]
    return pairs.join(log.select(*keys).distinct(), keys, "left_anti")


def log_summary(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per instrument and mode, and overall per instrument (`prediction_mode` null).

    Latest rows are expanded into the two levels by a rollup, so averages of the overall
    row are weighted by their observations.
    """
    keys = [*KEYS, "market_session_date", "prediction_mode"]
    inside = log.join(pairs.select(*keys), keys, "left_semi")
    raw = inside.groupBy(*MODE_KEYS, "market_session_date").agg(F.count(F.lit(1)).alias("_raw"))
    rows = latest_rows(inside).join(raw, [*MODE_KEYS, "market_session_date"])
    full = pairs.join(rows.withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    status = F.coalesce(clean_text(F.col("status")), F.lit("unknown"))
    actual = F.coalesce(clean_text(F.col("actual_outcome_status")), F.lit(PENDING))
    noted = reduce(lambda a, b: a | b, [clean_text(F.col(n)).isNotNull() for n in
                                        ("news_quality_note", "market_shock_note", "source_outage_note")])

    def n(cond: Column, name: str) -> Column:
        return F.count_if(hit & F.coalesce(cond, F.lit(False))).alias(name)

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_sum")

    out = full.rollup(*KEYS, "prediction_mode").agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("expected_pair_count"),
        F.count_if(hit).alias("selected_row_count"),
        F.coalesce(F.sum("_raw"), F.lit(0)).alias("observed_raw_row_count"),
        n(status == "success", "success_row_count"), n(status == "abstain", "abstain_row_count"),
        n(status == "partial_failure", "partial_failure_count"), n(status == "failure", "failure_row_count"),
        n(actual == BACKFILLED, "backfilled_row_count"),
        n(~actual.isin(BACKFILLED, UNAVAILABLE), "pending_actual_row_count"),
        n(actual == UNAVAILABLE, "market_data_unavailable_row_count"),
        n(F.col("disagreement_flag"), "disagreement_count"),
        F.avg(F.when(hit, F.col("disagreement_flag").cast("int"))).alias("disagreement_rate"),
        n(F.col("fallback_heavy_flag"), "fallback_heavy_count"), n(degraded_news(), "degraded_news_row_count"),
        n(F.col("news_article_count") == 0, "zero_news_count"), n(noted, "manual_note_row_count"),
        n(clean_text(F.col("source_outage_note")).isNotNull(), "source_outage_note_count"),
        F.avg(F.when(hit, F.col("baseline_correct").cast("int"))).alias("baseline_accuracy"),
        F.avg(F.when(hit, F.col("enhanced_correct").cast("int"))).alias("enhanced_accuracy"),
        F.count(F.when(hit, F.col("total_duration_seconds"))).alias("duration_row_count"),
        F.avg(F.when(hit, F.col("total_duration_seconds"))).alias("average_total_duration_seconds"),
        F.max(F.when(hit, F.col("total_duration_seconds"))).alias("max_total_duration_seconds"),
        F.avg(F.when(hit, F.col("stage5_duration_seconds"))).alias("average_stage5_duration_seconds"),
        F.avg(F.when(hit, F.col("stage6_duration_seconds"))).alias("average_stage6_duration_seconds"),
        *[total(c) for c in (
            "stage5_provider_request_count", "stage5_provider_request_retry_count", "stage5_article_fetch_attempt_count",
            "stage5_article_fetch_retry_count", "stage6_provider_request_count", "stage6_retry_count")],
        n(F.col("runtime_warning_flag"), "runtime_warning_count"),
    ).where("_g <= 1").drop("_g")
    chosen, wanted = F.col("selected_row_count"), F.col("expected_pair_count")
    return out.withColumns({
        "rerun_row_count": F.greatest(F.col("observed_raw_row_count") - chosen, F.lit(0)),
        "missing_pair_count": wanted - chosen,
        "coverage_status": F.when(chosen == 0, "unavailable").when(chosen < wanted, "partial").otherwise("complete"),
    })


def _count_issue(column: str, text: str) -> Column:
    return F.when(F.col(column) > 0, F.format_string(text, F.col(column)))


def operational_issues(overall: DataFrame, week: DataFrame | None = None) -> DataFrame:
    """Ordered list of issues per instrument from the overall summary and the week-plan status."""
    base = overall.where("prediction_mode is null")
    slots = ("pending_slot_count", "failure_slot_count", "partial_failure_slot_count")
    if week is not None:
        base = base.join(week.select(*KEYS, *slots), list(KEYS), "left")
    else:
        base = base.withColumns({c: F.lit(None).cast("long") for c in slots})
    retries = (F.col("stage5_provider_request_retry_count_sum") > 0) | (F.col("stage5_article_fetch_retry_count_sum") > 0)
    issues = F.array_compact(F.array(
        F.when(F.col("coverage_status") == "unavailable", "no log rows in the review window")
        .when(F.col("missing_pair_count") > 0, F.format_string("%d expected mode-day pairs are missing", "missing_pair_count")),
        _count_issue("partial_failure_count", "%d rows failed in part"),
        _count_issue("failure_row_count", "%d rows failed"),
        _count_issue("abstain_row_count", "%d rows abstained"),
        _count_issue("pending_actual_row_count", "%d rows wait for their outcome"),
        _count_issue("market_data_unavailable_row_count", "%d rows have no market data for their outcome"),
        _count_issue("source_outage_note_count", "%d rows carry source outage notes"),
        _count_issue("fallback_heavy_count", "%d rows were fallback-heavy"),
        _count_issue("degraded_news_row_count", "%d rows had degraded news"),
        F.when(retries, F.format_string(
            "%d provider retries and %d article retries", "stage5_provider_request_retry_count_sum",
            "stage5_article_fetch_retry_count_sum")),
        _count_issue("stage6_retry_count_sum", "%d scoring retries"),
        F.when(F.col("average_total_duration_seconds").isNotNull(), F.format_string(
            "run time averaged %.3fs, slowest %.3fs", "average_total_duration_seconds", "max_total_duration_seconds")),
        _count_issue("runtime_warning_count", "%d rows ran longer than the warning threshold"),
        _count_issue("pending_slot_count", "%d planned slots are pending"),
        F.when((F.col("failure_slot_count") > 0) | (F.col("partial_failure_slot_count") > 0), F.format_string(
            "%d planned slots failed in part and %d failed", "partial_failure_slot_count", "failure_slot_count")),
    ))
    return base.select(*KEYS, "coverage_status", issues.alias("issues"))


def claim_checks(overall: DataFrame) -> DataFrame:
    """Which claims the coverage supports, per instrument."""
    status = F.col("coverage_status")
    return overall.where("prediction_mode is null").select(
        *KEYS, "coverage_status", "expected_pair_count", F.col("selected_row_count").alias("available_pair_count"),
        F.lit(True).alias("offline_claims_are_backed"),
        (F.col("selected_row_count") > 0).alias("log_claims_are_backed"),
        (status == "complete").alias("operational_reliability_supported"),
        F.when(status == "unavailable", "no_log_rows").when(status == "partial", "incomplete_window")
        .otherwise("complete_window").alias("reliability_note"))


def variant_snapshot(table: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """One row per mode and variant with the metrics of each subset as a struct column."""
    # Subsets shown in the review.
    shown = ("all_rows", "news_heavy_rows", "zero_news_rows", "fresh_news_rows", "carried_forward_rows",
             "fallback_heavy_rows", "abstain_eliminated_rows", "high_confidence_rows",
             "quality_grade_a_or_b_rows", "quality_grade_c_or_worse_rows")
    values = F.struct("row_count", *metrics, "abstained_row_count", "selective_coverage")
    return table.groupBy("prediction_mode", "model_variant").agg(*[
        F.max(F.when(F.col("subset_name") == s, values)).alias(s) for s in shown])


def table_fingerprint(table: DataFrame, formula_version: str, name: str) -> DataFrame:
    """One row that identifies a table version: row count, schema and an order-free content hash.

    The hash sums 64-bit row hashes as decimals, which no number of rows overflows, so it needs one pass and no sort.
    """
    columns = sorted(table.columns)
    return table.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(28,0)")), F.lit(0)).alias("content_hash")).select(
        F.lit(name).alias("table_name"), F.lit(formula_version).alias("formula_version"),
        F.lit(",".join(columns)).alias("columns"), "row_count", "content_hash")


def lineage_check(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Compare saved and current fingerprints; any difference means the dependents are stale."""
    a = saved.select("table_name", *[F.col(c).alias(f"saved_{c}") for c in ("formula_version", "columns", "row_count", "content_hash")])
    out = current.join(a, "table_name", "full")
    reasons = F.array_compact(F.array(
        F.when(F.col("saved_formula_version").isNull(), "not_saved"),
        F.when(F.col("formula_version").isNull(), "not_built"),
        F.when(F.col("saved_formula_version") != F.col("formula_version"), "formula_version"),
        F.when(F.col("saved_columns") != F.col("columns"), "feature_columns"),
        F.when((F.col("saved_row_count") != F.col("row_count")) | (F.col("saved_content_hash") != F.col("content_hash")), "content"),
    ))
    return out.select("table_name", (F.size(reasons) == 0).alias("aligned"), reasons.alias("differences"))
