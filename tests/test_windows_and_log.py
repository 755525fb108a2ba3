import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import BAR_SCHEMA, rows
from tidemark.operators import prediction_log as P
from tidemark.operators import review as R
from tidemark.operators import windows as W
from tidemark.operators.asof import as_of
from tidemark.sources import prediction_log as PL

IST = dt.timedelta(hours=5, minutes=30)


def ask(spark, *local, **extra):
    made = [(i, "NSE", dt.datetime.fromisoformat(t) - IST) for i, t in enumerate(local)]
    df = spark.createDataFrame(made, "i int, exchange string, timestamp_utc timestamp")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


D = dt.date


@pytest.mark.parametrize("at, mode, session, cutoff, predicted, kind", [
    ("2026-03-14 10:00", "pre_market", D(2026, 3, 16), D(2026, 3, 13), D(2026, 3, 16), "snapped"),
    ("2026-03-10 08:05", "pre_market", D(2026, 3, 10), D(2026, 3, 9), D(2026, 3, 10), "natural"),
    ("2026-03-10 11:00", "pre_market", D(2026, 3, 10), D(2026, 3, 9), D(2026, 3, 10), "snapped"),
    ("2026-03-10 16:15", "after_close", D(2026, 3, 10), D(2026, 3, 10), D(2026, 3, 12), "natural"),
    ("2026-03-11 16:15", "after_close", D(2026, 3, 10), D(2026, 3, 10), D(2026, 3, 12), "snapped"),
    ("2026-03-14 18:00", "after_close", D(2026, 3, 13), D(2026, 3, 13), D(2026, 3, 16), "snapped"),
    ("2026-03-10 15:30", "after_close", D(2026, 3, 10), D(2026, 3, 10), D(2026, 3, 12), "natural"),
])
def test_default_window(spark, calendar, at, mode, session, cutoff, predicted, kind):
    r = rows(W.default_window(ask(spark, at), calendar))[0]
    assert (r["prediction_mode"], r["market_session_date"], r["historical_cutoff_date"], r["prediction_date"], r["resolution_kind"]) == (
        mode, session, cutoff, predicted, kind)
    clock = dt.time(8, 5) if mode == "pre_market" else dt.time(16, 15)
    assert r["window_timestamp_utc"] == dt.datetime.combine(session, clock) - IST


@pytest.mark.parametrize("at, after, pre", [
    ("2026-03-10 11:00", D(2026, 3, 9), D(2026, 3, 12)),
    ("2026-03-10 16:15", D(2026, 3, 10), D(2026, 3, 12)),
    ("2026-03-10 08:04", D(2026, 3, 9), D(2026, 3, 10)),
    ("2026-03-10 08:05", D(2026, 3, 9), D(2026, 3, 12)),
])
def test_dual_windows(spark, calendar, at, after, pre):
    got = {r["prediction_mode"]: r for r in rows(W.dual_windows(ask(spark, at), calendar))}
    assert got["after_close"]["market_session_date"] == after and got["pre_market"]["market_session_date"] == pre
    assert got["pre_market"]["historical_cutoff_date"] < pre


def test_explicit_window_errors(spark, calendar):
    times = ("2026-03-10 10:00", "2026-03-14 10:00")
    pre = [r["window_error"] for r in rows(W.explicit_window(ask(spark, *times, prediction_mode="pre_market"), calendar), "i")]
    after = [r["window_error"] for r in rows(W.explicit_window(ask(spark, *times, prediction_mode="after_close"), calendar), "i")]
    odd = [r["window_error"] for r in rows(W.explicit_window(ask(spark, *times, prediction_mode="noon"), calendar), "i")]
    assert pre == ["pre_market_after_open", None]
    assert after == ["after_close_before_close", "after_close_before_close_non_trading"]
    assert odd == ["unsupported_prediction_mode"] * 2


def test_snap_to_latest_bar(spark, calendar):
    bars = spark.createDataFrame([("X", "NSE", D(2026, 3, d), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (6, 9)], BAR_SCHEMA)
    made = [(m, "X", "NSE", D(2026, 3, 10), D(2026, 3, 10), D(2026, 3, 12)) for m in ("pre_market", "after_close")]
    made.append(("after_close", "Y", "NSE", D(2026, 3, 10), D(2026, 3, 10), D(2026, 3, 12)))
    wins = spark.createDataFrame(made, "prediction_mode string, ticker string, exchange string, market_session_date date, historical_cutoff_date date, prediction_date date")
    got = {(r["ticker"], r["prediction_mode"]): r for r in rows(W.snap_to_latest_bar(wins, bars, calendar))}
    snapped = got["X", "after_close"]
    assert snapped["market_session_date"] == snapped["historical_cutoff_date"] == D(2026, 3, 9)
    assert snapped["prediction_date"] == D(2026, 3, 10) and snapped["window_warnings"] == ["historical_cutoff_snapped_to_latest_bar"]
    assert got["X", "pre_market"]["window_error"] == "historical_cutoff_mismatch"
    assert got["Y", "after_close"]["window_error"] == "no_market_data"


def test_as_of_is_inclusive_unless_strict(spark):
    facts = spark.createDataFrame([("a", D(2026, 1, 5), 1), ("a", D(2026, 1, 7), 2)], "k string, d date, v int")
    asked = spark.createDataFrame([("a", D(2026, 1, d)) for d in (4, 5, 6, 7, 7)] + [("b", D(2026, 1, 7))], "k string, at date")
    got = [r["v"] for r in rows(as_of(asked, facts, ["k"], "at", "d", ["v"]), "k", "at")]
    strict = [r["v"] for r in rows(as_of(asked, facts, ["k"], "at", "d", ["v"], strict=True), "k", "at")]
    assert got == [None, 1, 1, 2, 2, None] and strict == [None, None, 1, 1, 1, None]


def log(spark, *entries):
    base = dict(ticker="X", exchange="NSE", prediction_mode="pre_market", status="success", market_session_date=D(2026, 3, 10),
                historical_date=D(2026, 3, 10), prediction_date=D(2026, 3, 12), pilot_timestamp_utc=dt.datetime(2026, 3, 10, 3),
                baseline_predicted_next_day_direction=1, enhanced_predicted_next_day_direction=0, actual_outcome_status="pending")
    kinds = dict(PL.LOG_COLUMNS)
    made = [{**base, **e, "pilot_entry_id": e.get("pilot_entry_id", f"e{i}")} for i, e in enumerate(entries)]
    names = sorted({k for m in made for k in m})
    df = spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], ", ".join(f"{n} {kinds[n]}" for n in names))
    return PL.conform(df)


BARS = [("X", "NSE", D(2026, 3, 10), 1.0, 1.0, 1.0, 120.0, 1.0), ("X", "NSE", D(2026, 3, 12), 1.0, 1.0, 1.0, 125.0, 1.0)]
NOW = dt.datetime(2026, 3, 20)


def test_outcome_backfill(spark):
    bars = spark.createDataFrame(BARS, BAR_SCHEMA)
    rows_in = log(spark, {}, {"historical_date": None}, {"prediction_date": D(2026, 3, 13)},
                  {"actual_outcome_status": "backfilled", "actual_next_day_direction": 0}, {"actual_outcome_status": None})
    out = rows(P.backfill(rows_in, bars, F.lit(NOW)), "pilot_entry_id")
    assert (out[0]["actual_next_day_direction"], out[0]["actual_outcome_status"]) == (1, "backfilled")
    assert (out[0]["baseline_correct"], out[0]["enhanced_correct"], out[0]["blended_correct"]) == (True, False, None)
    assert (out[1]["actual_outcome_status"], out[1]["actual_backfill_error"]) == ("market_data_unavailable", "missing_historical_date")
    assert out[2]["actual_backfill_error"] == "prediction_window_market_data_unavailable"
    assert out[3]["actual_next_day_direction"] == 0 and out[4]["actual_outcome_status"] == "backfilled"


def test_missing_timestamp_is_the_latest_rerun(spark):
    rows_in = log(spark, {"pilot_timestamp_utc": None, "pilot_entry_id": "a"}, {"pilot_entry_id": "z"},
                  {"pilot_timestamp_utc": dt.datetime(2026, 3, 10, 9), "pilot_entry_id": "m"})
    assert [r["pilot_entry_id"] for r in rows(P.latest_rows(rows_in))] == ["a"]
    assert [r["pilot_entry_id"] for r in rows(P.latest_per_mode(rows_in))] == ["m"]


def test_history_prefers_pre_market(spark):
    rows_in = log(spark, {"prediction_mode": "after_close", "pilot_timestamp_utc": dt.datetime(2026, 3, 11)}, {})
    assert [r["prediction_mode"] for r in rows(P.unique_day_history(rows_in))] == ["pre_market"]


def test_attempts(spark):
    rows_in = log(spark, {"prediction_key": "k", "prediction_attempt_number": 4}, {"prediction_key": "k"}, {"prediction_key": "n"})
    keys = spark.createDataFrame([("k",), ("n",), ("new",)], "prediction_key string")
    got = {r["prediction_key"]: r["prediction_attempt_number"] for r in rows(P.next_attempts(rows_in, keys))}
    assert got == {"k": 5, "n": 2, "new": 1}


def test_annotation_touches_latest_row_only(spark):
    rows_in = log(spark, {"news_quality_note": "old"}, {"pilot_timestamp_utc": dt.datetime(2026, 3, 10, 9), "news_quality_note": "old"})
    notes = spark.createDataFrame([("X", "NSE", "pre_market", D(2026, 3, 12), None, "shock", None)],
                                  "ticker string, exchange string, prediction_mode string, prediction_date date, news_quality_note string, market_shock_note string, source_outage_note string")
    out = rows(P.annotate(rows_in, notes, F.lit(NOW)), "pilot_entry_id")
    assert [r["market_shock_note"] for r in out] == [None, "shock"]
    assert [r["news_quality_note"] for r in out] == ["old", "old"]
    assert [r["manual_notes_updated_at_utc"] for r in out] == [None, NOW]


def test_log_store_append_read_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "log")
    PL.write_append(log(spark, {"warning_codes_json": ["a"]}), path)
    PL.write_append(log(spark, {"pilot_entry_id": "late", "prediction_date": D(2026, 4, 2)}), path)
    both = PL.read_log(spark, path)
    assert both.columns == [n for n, _ in PL.LOG_COLUMNS] and both.count() == 2
    staged = str(tmp_path / "staged")
    both.where("pilot_entry_id = 'late'").withColumn("status", F.lit("abstain")).write.parquet(staged)
    PL.rewrite_months(spark.read.parquet(staged), path)
    assert {r["pilot_entry_id"]: r["status"] for r in rows(PL.read_log(spark, path))} == {"e0": "success", "late": "abstain"}


def test_review_coverage(spark, calendar):
    rows_in = log(spark, {"status": "failure", "failure_stage": "stage2", "total_duration_seconds": 2.0},
                  {"prediction_mode": "after_close", "status": "abstain", "selected_action": "abstain", "total_duration_seconds": 4.0,
                   "abstain_reason_codes_json": ["a", "b", "c", "d"], "news_article_count": 0, "prediction_attempt_number": 2,
                   "warning_codes_json": ["stage5:degraded_source_x"], "data_quality_grade": "C"})
    pairs = R.expected_pairs(rows_in, calendar, "2026-03-10", "2026-03-12")
    grid = rows(R.daily_grid(rows_in, pairs), "market_session_date", F.col("prediction_mode").desc())
    assert [(str(r["market_session_date"]), r["prediction_mode"], r["status"]) for r in grid] == [
        ("2026-03-10", "pre_market", "failure"), ("2026-03-10", "after_close", "abstain"),
        ("2026-03-12", "pre_market", "missing"), ("2026-03-12", "after_close", "missing")]
    assert grid[0]["notes"] == ["failure:stage2", "actual_pending"]
    assert grid[1]["notes"] == ["abstain", "degraded_news", "zero_news", "quality_grade:C", "abstain_reasons:a,b,c", "rerun_attempt_2", "actual_pending"]
    assert grid[2]["notes"] == ["missing_expected_run"]
    summary = R.log_summary(rows_in, pairs)
    total = rows(summary.where("prediction_mode is null"))[0]
    assert (total["coverage_status"], total["expected_pair_count"], total["missing_pair_count"]) == ("partial", 4, 2)
    assert total["average_total_duration_seconds"] == 3.0 and total["failure_row_count"] == 1
    issues = rows(R.operational_issues(summary))[0]["issues"]
    assert issues[0] == "2 expected mode-day pairs are missing" and "run time averaged 3.000s, slowest 4.000s" in issues
    claim = rows(R.claim_checks(summary))[0]
    assert claim["log_claims_are_backed"] and not claim["operational_reliability_supported"]


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) s")
    a, b = (rows(R.table_fingerprint(d, "1", "t"))[0] for d in (df, df.orderBy(F.col("id").desc()).repartition(7)))
    assert a == b
    changed = R.table_fingerprint(df.withColumn("s", F.when(F.col("id") == 5, "x").otherwise(F.col("s"))), "1", "t")
    check = rows(R.lineage_check(R.table_fingerprint(df, "1", "t"), changed))[0]
    assert not check["aligned"] and check["differences"] == ["content"]
