"""Log operators: reruns, attempts, outcomes, pending sweep, notes, lookups, display fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_text
from tidemark.operators.asof import as_of
from tidemark.operators.running import positions, time_levels
from tidemark.settings import KEYS

BACKFILLED, PENDING, UNAVAILABLE = "backfilled", "pending", "market_data_unavailable"
MODE_KEYS = (*KEYS, "prediction_mode")


def _recency() -> Column:
    """Sort value of a rerun: a missing timestamp counts as the latest, then the entry id."""
    return F.struct(F.col("pilot_timestamp_utc").isNull().alias("n"), F.col("pilot_timestamp_utc").alias("t"),
                    F.col("pilot_entry_id").alias("e"))


def latest_rows(log: DataFrame, by: tuple[str, ...] = (*MODE_KEYS, "market_session_date")) -> DataFrame:
    """Latest rerun per session and mode, by an aggregate that keeps one row per task and key."""
    rest = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), _recency()).alias("r")).select(*by, "r.*").select(*log.columns)


def latest_per_mode(log: DataFrame) -> DataFrame:
    """Latest row per instrument and mode by timestamp, prediction date and id; nulls are oldest."""
    rest = [c for c in log.columns if c not in MODE_KEYS]
    order = F.struct("pilot_timestamp_utc", "prediction_date", "pilot_entry_id")
    return log.groupBy(*MODE_KEYS).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*MODE_KEYS, "r.*").select(*log.columns)


def unique_day_history(log: DataFrame) -> DataFrame:
    """One row per instrument and prediction date, pre-market before after-close, then the newest."""
    by = (*KEYS, "prediction_date")
    rest = [c for c in log.columns if c not in by]
    priority = F.when(F.col("prediction_mode") == "pre_market", 2).when(F.col("prediction_mode") == "after_close", 1).otherwise(0)
    order = F.struct(priority.alias("p"), "pilot_timestamp_utc", "pilot_entry_id")
    return log.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "r.*").select(*log.columns)


def recent_history(log: DataFrame, limit: int) -> DataFrame:
    """Newest `limit` days of the history per instrument."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("prediction_date").desc())
    return unique_day_history(log).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def next_attempts(log: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Attempt number of a new run per prediction key: highest so far (or the row count) plus one."""
    known = log.groupBy("prediction_key").agg(
        F.max("prediction_attempt_number").alias("_max"), F.count(F.lit(1)).alias("_n"))
    return new_keys.join(known, "prediction_key", "left").withColumn(
        "prediction_attempt_number", (F.coalesce("_max", "_n", F.lit(0)) + 1).cast("int")).drop("_max", "_n")


def rebuild_attempts(log: DataFrame) -> DataFrame:
    """Number the runs of every prediction key by timestamp and id, however many there are."""
    order = [F.col("pilot_timestamp_utc"), F.col("pilot_entry_id")]
    out = positions(log.drop("prediction_attempt_number"), ["prediction_key"], order,
                    time_levels(F.coalesce("pilot_timestamp_utc", F.lit("1970-01-01").cast("timestamp"))),
                    "prediction_attempt_number")
    return out.withColumn("prediction_attempt_number", F.col("prediction_attempt_number").cast("int")).select(*log.columns)


def prior_outcome(rows: DataFrame, log: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Latest earlier log row whose prediction date is a session, per instrument and mode."""
    sessions = calendar.where("is_session").select("exchange", F.col("date").alias("prediction_date"))
    kept = log.join(F.broadcast(sessions), ["exchange", "prediction_date"], "left_semi")
    last = latest_rows(kept, (*MODE_KEYS, "prediction_date")).select(
        *MODE_KEYS, F.col("prediction_date").alias("prior_prediction_date"),
        *[F.col(c).alias(f"prior_{c}") for c in columns])
    return as_of(rows, last, list(MODE_KEYS), "prediction_date", "prior_prediction_date",
                 ["prior_prediction_date", *[f"prior_{c}" for c in columns]], strict=True)


def closes(bars: DataFrame) -> DataFrame:
    """Last close per instrument and date."""
    order = "source_row_number" if "source_row_number" in bars.columns else "date"
    return bars.groupBy(*KEYS, "date").agg(F.max_by("close", order).alias("close"))


def outcomes(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Historical and prediction closes of each log row.

    The closes are looked up once per pair of dates that an instrument's rows have, so the wide
    log rows meet one table by one equi-join; the adaptive join may split a hot pair on the log side.
    """
    side = closes(bars)
    a = side.select(*KEYS, F.col("date").alias("historical_date"), F.col("close").alias("historical_close"))
    b = side.select(*KEYS, F.col("date").alias("prediction_date"), F.col("close").alias("prediction_close"))
    pair = [*KEYS, "historical_date", "prediction_date"]
    pairs = log.select(*pair).distinct().join(a, [*KEYS, "historical_date"], "left").join(
        b, [*KEYS, "prediction_date"], "left").withColumnsRenamed({c: f"_{c}" for c in pair})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair])
    return log.join(pairs, same, "left").drop(*[f"_{c}" for c in pair])


def backfill(log: DataFrame, bars: DataFrame, now: Column, due: Column | None = None,
             fill_blended: bool = False) -> DataFrame:
    """Fill outcomes of rows that are due and not yet backfilled; other rows are unchanged.

    The blended verdict is left null unless `fill_blended`, as in the original log.
    """
    open_row = F.coalesce(F.col("actual_outcome_status") != BACKFILLED, F.lit(True))
    target = open_row & (due if due is not None else F.lit(True))
    found = outcomes(log, bars).withColumn("_target", F.coalesce(target, F.lit(False)))
    has = F.col("historical_date").isNotNull() & F.col("historical_close").isNotNull() & F.col("prediction_close").isNotNull()
    win, lost = F.col("_target") & has, F.col("_target") & ~has
    direction = (F.col("prediction_close") > F.col("historical_close")).cast("int")
    error = F.when(F.col("historical_date").isNull(), "missing_historical_date").otherwise(
        "prediction_window_market_data_unavailable")

    def put(name: str, value: Column) -> Column:
        return F.when(win, value).otherwise(F.col(name))

    def verdict(model: str) -> Column:
        guess = F.col(f"{model}_predicted_next_day_direction")
        return F.when(win & guess.isNotNull(), guess == direction).otherwise(F.col(f"{model}_correct"))

    models = ("baseline", "enhanced", "blended") if fill_blended else ("baseline", "enhanced")
    return found.withColumns({
        "actual_historical_close": put("actual_historical_close", F.col("historical_close")),
        "actual_prediction_close": put("actual_prediction_close", F.col("prediction_close")),
        "actual_next_day_direction": put("actual_next_day_direction", direction),
        "actual_outcome_backfilled_at_utc": put("actual_outcome_backfilled_at_utc", now),
        "actual_outcome_status": F.when(win, BACKFILLED).when(lost, UNAVAILABLE).otherwise(F.col("actual_outcome_status")),
        "actual_backfill_error": F.when(win, F.lit(None)).when(lost, error).otherwise(F.col("actual_backfill_error")),
        **{f"{m}_correct": verdict(m) for m in models},
    }).drop("_target", "historical_close", "prediction_close").select(*log.columns)


def unresolved_counts(log: DataFrame) -> DataFrame:
    """Unresolved rows per reason; a missing historical date is permanent, the rest is actionable."""
    return log.where(F.col("actual_outcome_status") == UNAVAILABLE).groupBy(
        *KEYS, F.col("actual_backfill_error").alias("reason")).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "permanent", F.col("reason") == "missing_historical_date")


def eligible_dates(log: DataFrame, current: Column, as_of_date: Column, limit: int | None = None) -> DataFrame:
    """Prediction dates with pending rows before the current one, newest first, per instrument."""
    status = F.coalesce(clean_text(F.col("actual_outcome_status")), F.lit(PENDING))
    days = log.where(
        F.col("prediction_date").isNotNull() & (F.col("prediction_date") < current)
        & (F.col("prediction_date") <= as_of_date) & (status != BACKFILLED)).select(*KEYS, "prediction_date").distinct()
    if limit is None or limit <= 0:
        return days
    w = Window.partitionBy(*KEYS).orderBy(F.col("prediction_date").desc())
    return days.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def backfill_pending(log: DataFrame, bars: DataFrame, now: Column, current: Column, as_of_date: Column,
                     limit: int | None = None) -> DataFrame:
    """Backfill the rows of the eligible dates."""
    days = eligible_dates(log, current, as_of_date, limit).withColumn("_due", F.lit(True))
    marked = log.join(days, [*KEYS, "prediction_date"], "left")
    return backfill(marked, bars, now, F.coalesce(F.col("_due"), F.lit(False))).select(*log.columns)


def backfill_sessions(log: DataFrame, bars: DataFrame, now: Column, start, end, as_of_date: Column) -> DataFrame:
    """Backfill the dates that have a pending row in a session window, across all their rows."""
    pending = log.where(
        F.col("market_session_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & F.coalesce(F.col("actual_outcome_status") != BACKFILLED, F.lit(True))
        & (F.col("prediction_date") <= as_of_date))
    days = pending.select(*MODE_KEYS, "prediction_date").distinct().withColumn("_due", F.lit(True))
    marked = log.join(days, [*MODE_KEYS, "prediction_date"], "left")
    return backfill(marked, bars, now, F.coalesce(F.col("_due"), F.lit(False))).select(*log.columns)


NOTES = ("news_quality_note", "market_shock_note", "source_outage_note")


def annotate(log: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """Write non-null notes to the latest row of each (instrument, mode, prediction date)."""
    by = (*MODE_KEYS, "prediction_date")
    target = latest_rows(log, by).select("pilot_entry_id", *by)
    todo = notes.select(*by, *[F.col(n).alias(f"_{n}") for n in NOTES]).join(target, list(by)).select(
        "pilot_entry_id", F.lit(True).alias("_hit"), *[f"_{n}" for n in NOTES])
    out = log.join(todo, "pilot_entry_id", "left")
    return out.withColumns({
        **{n: F.coalesce(f"_{n}", n) for n in NOTES},
        "manual_notes_updated_at_utc": F.when(F.col("_hit"), now).otherwise(F.col("manual_notes_updated_at_utc")),
    }).select(*log.columns)


def linked_news(rows: DataFrame, extractions: DataFrame, limit: int = 3) -> DataFrame:
    """Most relevant scored articles of each log row, from its `linked_article_ids_json`."""
    ids = rows.select("pilot_entry_id", F.explode("linked_article_ids_json").alias("article_id"))
    w = Window.partitionBy("pilot_entry_id").orderBy(F.col("relevance_score").desc(), F.col("article_id"))
    return ids.join(extractions, "article_id").withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def linked_from_lineage(rows: DataFrame, lineage: DataFrame, extractions: DataFrame, limit: int = 3) -> DataFrame:
    """The same from the long lineage table.

    The best articles are picked once per session and mode, before the log rows join, so
    reruns of a busy session do not multiply its articles.
    """
    keys = [*MODE_KEYS, "prediction_date"]
    facts = extractions.drop(*[c for c in keys if c in extractions.columns])
    ranked = lineage.withColumnRenamed("date", "prediction_date").select(*keys, "article_id").join(facts, "article_id")
    w = Window.partitionBy(*keys).orderBy(F.col("relevance_score").desc(), F.col("article_id"))
    best = ranked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
    return rows.select("pilot_entry_id", *keys).join(best, keys)


def recent_runs(log: DataFrame, limit: int, mode: str | None = None, day: str | None = None, key: str | None = None) -> DataFrame:
    """Newest log rows that match the given mode, prediction date or key."""
    out = log
    if mode is not None:
        out = out.where(F.col("prediction_mode") == mode)
    if day is not None:
        out = out.where(F.col("prediction_date") == F.lit(day).cast("date"))
    if key is not None:
        out = out.where(F.col("prediction_key") == key)
    return out.orderBy(
        F.col("pilot_timestamp_utc").desc_nulls_last(), F.col("prediction_date").desc_nulls_last(),
        F.col("pilot_entry_id").desc()).limit(limit)


def model_agreement(baseline: Column, enhanced: Column) -> Column:
    return F.when(baseline.isNull() | enhanced.isNull(), "unavailable").when(baseline == enhanced, "agree").otherwise("disagree")


def direction_label(direction: Column) -> Column:
    return F.when(direction.isNull(), "-").when(direction == 1, "up").otherwise("down")


def correctness_label() -> Column:
    verdict = F.coalesce("blended_correct", "enhanced_correct", "baseline_correct")
    return F.when(verdict.isNull(), "pending").when(verdict, "correct").otherwise("incorrect")


def outcome_label() -> Column:
    known = (F.col("actual_outcome_status") == BACKFILLED) & F.col("actual_next_day_direction").isNotNull()
    return F.when(known, direction_label(F.col("actual_next_day_direction"))).otherwise(
        F.coalesce(clean_text(F.col("actual_outcome_status")), F.lit("-")))


def shown_probability(model: str) -> Column:
    return F.coalesce(
        f"{model}_calibrated_predicted_probability_up", f"{model}_raw_predicted_probability_up",
        f"{model}_predicted_probability_up")


def impact_strength(impact: Column) -> Column:
    """Fixed cut-offs of the impact label."""
    return F.when(F.abs(impact) >= 0.08, "strong").when(F.abs(impact) >= 0.04, "moderate").otherwise("light")


def top_drivers(rows: DataFrame, contributions: str, limit: int) -> DataFrame:
    """Strongest positive and negative contributions of each row, from its map column."""
    long = rows.select("pilot_entry_id", F.explode(contributions).alias("feature", "impact")).where("impact <> 0")
    sided = long.withColumn("side", F.when(F.col("impact") > 0, "positive").otherwise("negative"))
    w = Window.partitionBy("pilot_entry_id", "side").orderBy(F.abs("impact").desc(), F.col("feature"))
    return sided.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).withColumn(
        "strength", impact_strength(F.col("impact")))


def describe_features(features: DataFrame, names: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """Description by exact name, else by the first matching prefix, else from the name's tokens.

    Both maps are small fixed vocabularies.
    """
    feature = F.col("feature")
    tokens = F.array_join(F.slice(F.filter(F.split(F.lower("feature"), r"[_\W]+"), lambda t: t != ""), 1, 6), " ")
    text = F.concat(F.lit("Derived feature from "), tokens, F.lit("."))
    for prefix, description in reversed(prefixes.items()):
        text = F.when(feature.startswith(prefix), description).otherwise(text)
    for name, description in names.items():
        text = F.when(feature == name, description).otherwise(text)
    return features.withColumn("description", text)


def event_counts(columns: dict[str, str]) -> Column:
    """Non-zero event counts as an array of (event, count), largest first, then by name."""
    pairs = F.array(*[F.struct((-F.col(c)).cast("int").alias("minus"), F.lit(e).alias("event")) for e, c in columns.items()])
    kept = F.array_sort(F.filter(pairs, lambda p: p["minus"] < 0))
    return F.transform(kept, lambda p: F.struct(p["event"].alias("event"), (-p["minus"]).alias("n")))


def stage_warnings(codes: Column, prefix: str, providers: tuple[str, ...] = ()) -> Column:
    """Warning codes under a stage prefix; verbose provider failures shrink to `<provider>_failed`."""
    kept = F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: c != "")

    def compact(c: Column) -> Column:
        out = c
        for p in providers:
            low = F.lower(c)
            out = F.when((low == f"{p}_failed") | low.startswith(f"{p} request failed:"), f"{p}_failed").otherwise(out)
        return F.concat(F.lit(f"{prefix}:"), out)

    return F.transform(kept, compact)
