"""Sinks that survive a retry: the prediction log by run, stage tables by version."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import prediction_log as PL
from tidemark.sources import tables as T

ROW = "pilot_entry_id string, prediction_mode string, prediction_date date, status string"


def log_rows(spark, ids, month=1):
    return spark.createDataFrame(
        [(i, "pre_market" if k % 2 else "after_close", dt.date(2026, month, 5 + k), "success") for k, i in enumerate(ids)], ROW)


def ids(spark, path):
    return sorted(r["pilot_entry_id"] or "" for r in PL.read_log(spark, path).collect())


def test_a_run_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert PL.append_run(log_rows(spark, ["a", "b", "b", None]), path, "r1")
    assert not PL.append_run(log_rows(spark, ["a", "b", "c"]), path, "r1")
    assert ids(spark, path) == ["", "a", "b"]
    PL.write_append(log_rows(spark, ["c"]), path)  # a run that died before its manifest line
    assert PL.append_run(log_rows(spark, ["c", "d"]), path, "r2")
    assert ids(spark, path) == ["", "a", "b", "c", "d"]
    assert PL.append_run(log_rows(spark, []), path, "r3")
    assert {r["run_id"] for r in PL.committed_runs(spark, path).collect()} == {"r1", "r2", "r3"}


def test_rewrite_replaces_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "log")
    PL.append_run(log_rows(spark, ["a", "b"], 1).unionByName(log_rows(spark, ["x", "y"], 2)), path, "r1")
    other = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("prediction_month=2026-02/*.parquet")}

    def mark(rows):
        return rows.withColumn("status", F.concat("status", F.lit("!")))

    january = F.col("prediction_month") == "2026-01"
    assert PL.rewrite_run(spark, path, "w1", mark, january) and not PL.rewrite_run(spark, path, "w1", mark, january)
    got = {r["pilot_entry_id"]: r["status"] for r in PL.read_log(spark, path).collect()}
    assert got == {"a": "success!", "b": "success!", "x": "success", "y": "success"}
    assert other == {str(p): p.stat().st_mtime_ns for p in (tmp_path / "log").rglob("prediction_month=2026-02/*.parquet")}


def test_a_rewrite_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    PL.append_run(log_rows(spark, ["a", "b"]), path, "r1")
    with pytest.raises(Exception, match="halt"):
        PL.rewrite_run(spark, path, "w1", lambda rows: rows.withColumn("status", F.raise_error(F.lit("halt")).cast("string")))
    assert ids(spark, path) == ["a", "b"]
    assert PL.rewrite_run(spark, path, "w1", lambda rows: rows)
    assert ids(spark, path) == ["a", "b"]


BARS = "ticker string, exchange string, date date, close double"


def bars(spark, close=1.0, tickers="AB"):
    return spark.createDataFrame([(t, "NSE", dt.date(2026, 1, d), close) for t in tickers for d in (5, 6)], BARS)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "bars")
    with pytest.raises(ValueError, match="no finished version"):
        T.read_version(spark, path, BARS)
    first = T.write_version(bars(spark), path, "bars", "5", "ticker")
    with pytest.raises(Exception, match="halt"):  # dies while it writes: the old version stays in use
        T.write_version(bars(spark).withColumn("close", F.raise_error(F.lit("halt")).cast("double")), path, "bars", "5", "ticker")
    assert T.current_version(spark, path)["version"] == first
    assert T.read_version(spark, path, BARS, "5").agg(F.sum("close")).collect()[0][0] == 4
    second = T.write_version(bars(spark, 2.0), path, "bars", "6", "ticker")
    assert T.current_version(spark, path)["version"] == second
    assert T.read_version(spark, path, BARS).agg(F.sum("close")).collect()[0][0] == 8
    assert T.read_version(spark, path, BARS, version=first).agg(F.sum("close")).collect()[0][0] == 4
    with pytest.raises(ValueError, match="formula 6"):
        T.read_version(spark, path, BARS, "5")


def test_stale_parts(spark, tmp_path):
    path = str(tmp_path / "bars")
    T.write_version(bars(spark, tickers="ABC"), path, "bars", "5", "ticker")
    assert T.stale_parts(spark, path, bars(spark, tickers="CBA")).count() == 0
    now = bars(spark, tickers="A").unionByName(bars(spark, 3.0, "B")).unionByName(bars(spark, 1.0, "D"))
    assert {r["part"]: r["reason"] for r in T.stale_parts(spark, path, now).collect()} == {"B": "content", "C": "gone", "D": "new"}
