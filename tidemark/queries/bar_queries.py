"""Bar stage: sources, quarantine, dedupe, gap fill, calendar, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.calendar import session_phase
from tidemark.queries import inputs as I
from tidemark.queries.registry import query
from tidemark.settings import KEYS, PilotSettings

PRICES = ("open", "high", "low", "close")
PRIORITY = ("nse_bhavcopy", "upstox", "yfinance")


@query("trading_calendar", "S11 T1", """
SELECT exchange, date, is_session, session_index, on_or_before, previous_session, on_or_after, next_session, second_session
FROM cal""")
def trading_calendar(spark, sf):
    return I.calendar(spark)


@query("calendar_of_bars", "T1 S11", """
SELECT b.ticker, b.date, c.is_session, c.on_or_after, c.next_session, c.previous_session, c.on_or_before
FROM bars b JOIN cal c USING (exchange, date)""")
def calendar_of_bars(spark, sf):
    cal = I.calendar(spark).select(
        "exchange", "date", "is_session", "on_or_after", "next_session", "previous_session", "on_or_before")
    return I.bars(spark, sf).select("ticker", "exchange", "date").join(F.broadcast(cal), ["exchange", "date"]).drop("exchange")


@query("daily_bars", "S1", f"""
SELECT ticker, exchange, date, open, high, low, close, volume FROM bars""")
def daily_bars(spark, sf):
    return I.bars(spark, sf).select(*KEYS, "date", *PRICES, "volume")


_BASIC = """
SELECT *, try_cast(date_text AS DATE) AS date,
       list_filter([CASE WHEN try_cast(date_text AS DATE) IS NULL THEN 'invalid_date' END,
                    CASE WHEN open IS NULL THEN 'invalid_open' END,
                    CASE WHEN high IS NULL THEN 'invalid_high' END,
                    CASE WHEN low IS NULL THEN 'invalid_low' END,
                    CASE WHEN close IS NULL THEN 'invalid_close' END,
                    CASE WHEN volume IS NULL OR volume < 0 THEN 'invalid_volume' END], lambda x: x IS NOT NULL) AS basic
FROM raw_bars"""
I.cte("judged", f"""
SELECT *, CASE WHEN len(basic) > 0 THEN array_to_string(basic, ',')
               WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'invalid_high_low_relationship'
               ELSE '' END AS reasons
FROM ({_BASIC})""")
I.cte("clean_bars", """
SELECT ticker, exchange, date, count(*) AS n,
       arg_max(row(open, high, low, close, adj_close, volume, provider), source_row_number) AS win
FROM judged WHERE reasons = '' GROUP BY ticker, exchange, date""")


@query("bar_quarantine", "F1 S1", """
SELECT ticker, date, l_orderkey, reasons, count(*) AS n FROM judged WHERE reasons <> '' GROUP BY ALL""")
def bar_quarantine(spark, sf):
    judged = B.bar_reasons(B.normalize_provider_columns(I.raw_bars(spark, sf)))
    _, bad = B.split_quarantine(judged)
    return bad.groupBy(
        "ticker", "date", F.col("source_row_number.l_orderkey").alias("l_orderkey"),
        F.concat_ws(",", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("bar_reason_counts", "F1", """
SELECT ticker, reasons, count(*) AS n FROM judged GROUP BY ALL""")
def bar_reason_counts(spark, sf):
    judged = B.bar_reasons(B.normalize_provider_columns(I.raw_bars(spark, sf)))
    return judged.groupBy("ticker", F.concat_ws(",", "reasons").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("bar_dedupe", "U2", f"""
SELECT ticker, exchange, date, win[1] AS open, win[2] AS high, win[3] AS low,
       win[4] AS close, win[6] AS volume, win[7] AS provider, n - 1 AS duplicates FROM clean_bars""")
def bar_dedupe(spark, sf):
    judged = B.bar_reasons(B.normalize_provider_columns(I.raw_bars(spark, sf)))
    valid, _ = B.split_quarantine(judged)
    return B.dedupe_bars(valid).select(*KEYS, "date", *PRICES, "volume", "provider", "duplicates")


@query("bar_provider_precedence", "S3", """
WITH ranked AS (SELECT *, list_position(['nse_bhavcopy', 'upstox', 'yfinance'], provider) AS rank FROM raw_bars
                WHERE NOT (provider = 'nse_bhavcopy' AND CAST(substr(ticker, 2) AS INTEGER) % 2 = 0)),
best AS (SELECT ticker, exchange, min(rank) AS rank FROM ranked GROUP BY ticker, exchange)
SELECT ticker, exchange, provider, count(*) AS row_count, count(DISTINCT date_text) AS day_count
FROM ranked JOIN best USING (ticker, exchange, rank) GROUP BY ALL""")
def bar_provider_precedence(spark, sf):
    # Instruments with an even number have no official rows and fall back to the next provider.
    landed = B.normalize_provider_columns(I.raw_bars(spark, sf)).where(
        ~((F.col("provider") == "nse_bhavcopy") & (F.substring("ticker", 2, 9).cast("int") % 2 == 0)))
    return B.choose_provider(landed, PRIORITY).groupBy(*KEYS, "provider").agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("date").alias("day_count"))


@query("bar_provider_official_only", "S3", """
SELECT ticker, exchange, provider, count(*) AS row_count FROM raw_bars WHERE provider = 'nse_bhavcopy' GROUP BY ALL""")
def bar_provider_official_only(spark, sf):
    landed = B.normalize_provider_columns(I.raw_bars(spark, sf))
    chosen = B.choose_provider(landed, PRIORITY, official_only=frozenset({"nse_bhavcopy", "bse_bhavcopy"}))
    return chosen.groupBy(*KEYS, "provider").agg(F.count(F.lit(1)).alias("row_count"))


@query("bar_window_slice", "F2", f"""
SELECT ticker, exchange, date, open, high, low, close, volume FROM bars
WHERE date BETWEEN DATE '1997-03-03' AND DATE '1998-06-30'""")
def bar_window_slice(spark, sf):
    return B.slice_window(I.bars(spark, sf), "1997-03-03", "1998-06-30").select(
        *KEYS, "date", *PRICES, "volume")


@query("bar_gap_fill", "J1 W15", f"""
SELECT ticker, exchange, date, open, high, low, close, volume, market_data_gap_flag FROM aligned""")
def bar_gap_fill(spark, sf):
    out = B.align_to_sessions(I.bars(spark, sf), I.calendar(spark))
    return out.select(*KEYS, "date", *PRICES, "volume", "market_data_gap_flag")


@query("bar_missing_sessions", "J2", """
SELECT s.ticker, s.exchange, c.date FROM spans s
JOIN cal c ON c.exchange = s.exchange AND c.is_session AND c.date BETWEEN s.a AND s.b
ANTI JOIN bars b ON b.ticker = s.ticker AND b.date = c.date""")
def bar_missing_sessions(spark, sf):
    return B.missing_sessions(I.bars(spark, sf), I.calendar(spark))


@query("bar_contract", "F3", """
SELECT ticker, exchange, count(*) AS row_count,
       count(*) FILTER (try_cast(date_text AS DATE) IS NULL) AS invalid_date_count,
       count(try_cast(date_text AS DATE)) - count(DISTINCT try_cast(date_text AS DATE)) AS duplicate_date_count,
       count(*) FILTER (close IS NULL) AS invalid_close_count,
       count(*) FILTER (close <= 0) AS nonpositive_close_count,
       count(*) FILTER (volume IS NULL) AS invalid_volume_count,
       count(*) FILTER (volume < 0) AS negative_volume_count,
       CAST(count(*) < 255 AS INTEGER) AS short_history
FROM raw_bars GROUP BY ticker, exchange""")
def bar_contract(spark, sf):
    raw = B.bar_reasons(B.normalize_provider_columns(I.raw_bars(spark, sf)))
    return B.bar_contract(raw).drop("violations")


@query("bar_contract_violations", "F3", """
SELECT ticker, exchange, CASE WHEN count(*) < 255 THEN 'insufficient_rows' ELSE '' END AS violations
FROM bars GROUP BY ticker, exchange""")
def bar_contract_violations(spark, sf):
    return B.bar_contract(I.bars(spark, sf)).select(*KEYS, F.concat_ws(",", "violations").alias("violations"))


@query("bar_summary", "A8", """
WITH kept AS (SELECT ticker, exchange, count(*) AS row_count, min(date) AS coverage_start, max(date) AS coverage_end,
                     CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM clean_bars GROUP BY ticker, exchange),
dropped AS (SELECT ticker, exchange, count(*) AS dropped_row_count FROM judged WHERE reasons <> '' GROUP BY ticker, exchange),
absent AS (SELECT k.ticker, k.exchange, count(*) AS missing_session_count
           FROM kept k JOIN cal c ON c.is_session AND c.date BETWEEN k.coverage_start AND k.coverage_end
           ANTI JOIN clean_bars b ON b.ticker = k.ticker AND b.date = c.date GROUP BY k.ticker, k.exchange)
SELECT ticker, exchange, coalesce(row_count, 0) AS row_count, coverage_start, coverage_end,
       coalesce(duplicate_count, 0) AS duplicate_count, coalesce(dropped_row_count, 0) AS dropped_row_count,
       coalesce(missing_session_count, 0) AS missing_session_count
FROM kept FULL JOIN dropped USING (ticker, exchange) LEFT JOIN absent USING (ticker, exchange)""")
def bar_summary(spark, sf):
    judged = B.bar_reasons(B.normalize_provider_columns(I.raw_bars(spark, sf)))
    valid, bad = B.split_quarantine(judged)
    clean = B.dedupe_bars(valid)
    return B.bar_summary(clean, bad, B.missing_sessions(clean, I.calendar(spark)))


@query("bar_tail_merge", "J14", f"""
WITH existing AS (SELECT * FROM bars WHERE date < DATE '2000-01-01'),
bounds AS (SELECT ticker, exchange, greatest(max(date) - 5, min(date)) AS overlap_start FROM existing GROUP BY ticker, exchange),
merged AS (
  SELECT e.ticker, e.exchange, e.date, e.close, e.volume FROM existing e JOIN bounds USING (ticker, exchange) WHERE e.date < overlap_start
  UNION ALL
  SELECT b.ticker, b.exchange, b.date, b.close + 1 AS close, b.volume FROM bars b LEFT JOIN bounds USING (ticker, exchange)
  WHERE b.date >= DATE '1999-12-01' AND (overlap_start IS NULL OR b.date >= overlap_start))
SELECT ticker, exchange, date, close, volume FROM merged""")
def bar_tail_merge(spark, sf):
    bars = I.bars(spark, sf)
    existing = bars.where("date < DATE '2000-01-01'")
    refetched = bars.where("date >= DATE '1999-12-01'").withColumn("close", F.col("close") + 1)
    return B.merge_tail(existing, refetched, PilotSettings().overlap_days).select(
        *KEYS, "date", "close", "volume")


I.cte("freshness_requests", """
SELECT ticker, exchange, max(date) + (CAST(substr(ticker, 2) AS INTEGER) % 7) - 3 AS required_date
FROM bars GROUP BY ticker, exchange
UNION ALL SELECT 'NONE', 'NSE', DATE '2000-03-04'""")


@query("bar_freshness", "F15", """
SELECT q.ticker, q.exchange, q.required_date, c.on_or_before AS effective_date, m.coverage_end,
       coalesce(m.coverage_end >= c.on_or_before, false) AS is_fresh,
       CAST(greatest(date_diff('day', c.on_or_before, m.coverage_end), 0) AS INTEGER) AS days_ahead,
       CAST(greatest(date_diff('day', m.coverage_end, c.on_or_before), 0) AS INTEGER) AS days_behind,
       CASE WHEN m.coverage_end IS NULL THEN 'no_existing_data'
            WHEN m.coverage_end > c.on_or_before THEN 'covers_beyond_required'
            WHEN m.coverage_end = c.on_or_before AND c.on_or_before <> q.required_date THEN 'fresh_prior_session'
            WHEN m.coverage_end = c.on_or_before THEN 'fresh' ELSE 'stale' END AS reason
FROM freshness_requests q LEFT JOIN cal c ON c.date = q.required_date
LEFT JOIN (SELECT ticker, max(date) AS coverage_end FROM bars GROUP BY ticker) m ON m.ticker = q.ticker""")
def bar_freshness(spark, sf):
    bars = I.bars(spark, sf)
    asked = bars.groupBy(*KEYS).agg(F.max("date").alias("d")).select(
        *KEYS, F.date_add("d", F.substring("ticker", 2, 9).cast("int") % 7 - 3).alias("required_date"))
    missing = spark.sql("SELECT 'NONE' AS ticker, 'NSE' AS exchange, DATE '2000-03-04' AS required_date")
    return B.freshness(bars, asked.unionByName(missing), I.calendar(spark))


@query("session_end_cap", "F14", """
WITH q AS (SELECT event_id, ts - to_days(8127) AS now_utc, CAST(ts - to_days(8127) + INTERVAL 330 MINUTE AS DATE) AS today,
                  strftime(ts - to_days(8127) + INTERVAL 330 MINUTE, '%H:%M:%S') AS hms FROM events),
p AS (SELECT event_id, hms, today, today - CAST(event_id % 3 AS INTEGER) AS end_date FROM q)
SELECT p.event_id, p.end_date,
       CASE WHEN p.end_date = p.today AND c.is_session AND hms < '15:30:00' THEN c.previous_session ELSE p.end_date END AS capped_end_date,
       CASE WHEN p.end_date = p.today AND c.is_session AND hms < '15:30:00' THEN 'historical_end_date_capped_before_session_close' END AS cap_reason
FROM p LEFT JOIN cal c ON c.date = p.end_date""")
def session_end_cap(spark, sf):
    events = I.table(spark, sf, "events").select(
        "event_id", F.lit("NSE").alias("exchange"),
        (F.col("ts") - F.make_dt_interval(F.lit(I.EVENT_SHIFT_DAYS))).alias("now_utc"))
    asked = events.withColumn("end_date", F.date_sub(
        F.to_date(F.from_utc_timestamp("now_utc", I.MARKET.timezone)), (F.col("event_id") % 3).cast("int")))
    out = B.cap_incomplete_session(asked, I.calendar(spark), I.MARKET.timezone, I.MARKET.close_time)
    return out.select("event_id", "end_date", "capped_end_date", "cap_reason")


@query("session_phase", "T2", """
WITH q AS (SELECT event_id, ts - to_days(8127) + INTERVAL 330 MINUTE AS local_ts FROM events)
SELECT event_id, strftime(local_ts, '%H:%M:%S') AS local_time, c.is_session,
       CASE WHEN NOT c.is_session THEN 'non_trading' WHEN strftime(local_ts, '%H:%M:%S') < '09:15:00' THEN 'pre_market'
            WHEN strftime(local_ts, '%H:%M:%S') < '15:30:00' THEN 'intraday' ELSE 'after_close' END AS phase
FROM q JOIN cal c ON c.date = CAST(local_ts AS DATE)""")
def phases(spark, sf):
    local = F.from_utc_timestamp(
        F.col("ts") - F.make_dt_interval(F.lit(I.EVENT_SHIFT_DAYS)), I.MARKET.timezone)
    events = I.table(spark, sf, "events").select(
        "event_id", F.lit("NSE").alias("exchange"), F.date_format(local, "HH:mm:ss").alias("local_time"),
        F.to_date(local).alias("date"))
    cal = I.calendar(spark).select("exchange", "date", "is_session")
    return events.join(F.broadcast(cal), ["exchange", "date"]).select(
        "event_id", "local_time", "is_session",
        session_phase(F.col("local_time"), F.col("is_session"), I.MARKET).alias("phase"))
