"""Bars, articles, logs and calendars derived from the given tables, in Spark and in SQL.

Nothing here is made up: every row comes from a row of the given parquet tables, so the
work of each query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators.calendar import build_calendar
from tidemark.queries.oracle import GRID_CUT, cte
from tidemark.settings import MarketSettings

CAL_START, CAL_END = "1994-12-01", "2002-12-31"
MARKET = MarketSettings(calendar_start=CAL_START, calendar_end=CAL_END)
MODE_BY_ROW = ("full_article", "headline_plus_snippet", "headline_only")
PROVIDERS = tuple(V.SOURCE_WEIGHTS)
EVENT_SHIFT_DAYS = 8127


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def ntz(c) -> "F.Column":
    """Zone-less form of a timestamp for query outputs."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


_calendars: dict[str, DataFrame] = {}


def calendar(spark: SparkSession) -> DataFrame:
    """The calendar of the bar range, kept once per session: about 3,000 rows of a fixed dimension."""
    key = f"{spark.sparkContext.applicationId}-{id(spark)}"
    if key not in _calendars:
        _calendars[key] = build_calendar(spark, ("NSE",), MARKET).persist()
    return _calendars[key]


def r(c, digits: int = 6):
    """Double on a decimal grid; see `oracle.rnd` for the cut."""
    if isinstance(c, str):
        return F.expr(f"cast(floor({c} * 1e{digits}D + {GRID_CUT}D) as double) / 1e{digits}D")
    value = c
    return F.floor(value * F.lit(10.0**digits) + F.lit(GRID_CUT)).cast("double") / F.lit(10.0**digits)


def rounded(columns, digits: int = 6) -> list:
    return [r(c, digits).alias(c) for c in columns]


def pick(values, index):
    """Element of a fixed tuple by a non-negative column index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One trade per order line, named by the nation of its supplier."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_shipdate")
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"),
        F.lit("NSE").alias("exchange"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per nation, weekends included; the calendar join drops those."""
    trades = priced_lines(spark, sf)
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
    return trades.groupBy("ticker", "exchange", "date").agg(
        F.min(at)["price"].alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max(at)["price"].alias("close"),
        F.sum("quantity").alias("volume"),
    )


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Provider-shaped rows, one per order line, with defects on fixed key residues."""
    t = priced_lines(spark, sf)
    k = F.col("l_orderkey")
    close = F.col("price") * (F.lit(0.95) + F.col("discount"))
    return t.select(
        "ticker", "exchange",
        F.when(k % 79 == 0, "not a date").otherwise(F.col("date").cast("string")).alias("Date"),
        F.when(k % 101 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("Open"),
        F.when(k % 83 == 0, F.least("price", close) - 1).otherwise(F.greatest("price", close)).alias("High"),
        F.least("price", close).alias("Low"),
        F.when(k % 97 != 0, close).alias("Close"),
        close.alias("Adj Close"),
        F.when(k % 89 == 0, F.lit(-1.0)).otherwise(F.col("quantity")).alias("Volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "quantity", "discount").alias("source_row_number"),
        pick(("upstox", "yfinance", "nse_bhavcopy"), k % 3).alias("provider"),
    )


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Scored articles, one per order; every score is a function of the order key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    k = F.col("o_orderkey")
    score = ((k % 201) - 100) / 100.0
    published = F.timestamp_micros(F.unix_micros("o_orderdate") + ((k * 37) % 1440) * 60_000_000)
    mode = pick(MODE_BY_ROW, k % 3)
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        k.cast("string").alias("article_id"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"),
        F.lit("NSE").alias("exchange"),
        published.alias("published_at_utc"),
        mode.alias("extraction_mode"),
        F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.75).otherwise(0.5).alias("content_quality_score"),
        pick(PROVIDERS, k % 5).alias("provider"),
        pick(V.EVENT_TYPES, k % 17).alias("event_type"),
        score.alias("sentiment_score"),
        F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral").alias("sentiment_label"),
        F.when(score > 0, "bullish").when(score < 0, "bearish").otherwise("neutral").alias("directional_bias"),
        (((k % 7) + 4) / 10.0).alias("relevance_score"),
        (((k % 6) + 5) / 10.0).alias("confidence_score"),
        ((k % 11) / 10.0).alias("event_severity"),
        (k % 4 == 0).alias("warning_flag"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("article_title"),
        k.alias("k"),
    )


# ---- SQL twins -------------------------------------------------------------------

cte("cal_days", f"""
SELECT CAST(d AS DATE) AS date,
       (isodow(d) < 6 AND NOT (month(d) = 1 AND day(d) = 26) AND NOT (month(d) = 5 AND day(d) = 1)
        AND NOT (month(d) = 8 AND day(d) = 15) AND NOT (month(d) = 10 AND day(d) = 2)) AS is_session
FROM generate_series(DATE '{CAL_START}', DATE '{CAL_END}', INTERVAL 1 DAY) t(d)""")
cte("cal0", """
SELECT 'NSE' AS exchange, date, is_session,
       CAST(sum(CASE WHEN is_session THEN 1 ELSE 0 END) OVER a AS BIGINT) AS session_index,
       max(CASE WHEN is_session THEN date END) OVER a AS on_or_before,
       max(CASE WHEN is_session THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_session,
       min(CASE WHEN is_session THEN date END) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS on_or_after,
       min(CASE WHEN is_session THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_session
FROM cal_days WINDOW a AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("cal", """
SELECT x.*, y.next_session AS second_session
FROM cal0 x LEFT JOIN cal0 y ON x.on_or_after = y.date""")
cte("trades", """
SELECT 'N' || s_nationkey AS ticker, 'NSE' AS exchange, CAST(l_shipdate AS DATE) AS date,
       l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_discount AS discount,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
cte("bars", """
SELECT ticker, exchange, date,
       arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS open,
       max(price) AS high, min(price) AS low,
       arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS close,
       sum(quantity) AS volume
FROM trades GROUP BY ticker, exchange, date""")
cte("raw_bars", """
SELECT ticker, exchange,
       CASE WHEN l_orderkey % 79 = 0 THEN 'not a date' ELSE CAST(date AS VARCHAR) END AS date_text,
       CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE price END AS open,
       CASE WHEN l_orderkey % 83 = 0 THEN least(price, price * (0.95::DOUBLE + discount)) - 1 ELSE greatest(price, price * (0.95::DOUBLE + discount)) END AS high,
       least(price, price * (0.95::DOUBLE + discount)) AS low,
       CASE WHEN l_orderkey % 97 <> 0 THEN price * (0.95::DOUBLE + discount) END AS close,
       price * (0.95::DOUBLE + discount) AS adj_close,
       CASE WHEN l_orderkey % 89 = 0 THEN -1.0 ELSE quantity END AS volume,
       row(l_orderkey, l_linenumber, l_partkey, l_suppkey, price, quantity, discount) AS source_row_number,
       l_orderkey,
       CASE l_orderkey % 3 WHEN 0 THEN 'upstox' WHEN 1 THEN 'yfinance' ELSE 'nse_bhavcopy' END AS provider
FROM trades""")
_events = ", ".join(f"'{e}'" for e in V.EVENT_TYPES)
_providers = ", ".join(f"'{p}'" for p in PROVIDERS)
cte("extractions", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, 'N' || c_nationkey AS ticker, 'NSE' AS exchange,
       o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS INTEGER)) AS published_at_utc,
       CASE o_orderkey % 3 WHEN 0 THEN 'full_article' WHEN 1 THEN 'headline_plus_snippet' ELSE 'headline_only' END AS extraction_mode,
       CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS content_quality_score,
       ([{_providers}])[1 + o_orderkey % 5] AS provider,
       ([{_events}])[1 + o_orderkey % 17] AS event_type,
       ((o_orderkey % 201) - 100) / 100.0::DOUBLE AS sentiment_score,
       CASE WHEN o_orderkey % 201 > 100 THEN 'positive' WHEN o_orderkey % 201 < 100 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CASE WHEN o_orderkey % 201 > 100 THEN 'bullish' WHEN o_orderkey % 201 < 100 THEN 'bearish' ELSE 'neutral' END AS directional_bias,
       ((o_orderkey % 7) + 4) / 10.0::DOUBLE AS relevance_score,
       ((o_orderkey % 6) + 5) / 10.0::DOUBLE AS confidence_score,
       (o_orderkey % 11) / 10.0::DOUBLE AS event_severity,
       o_orderkey % 4 = 0 AS warning_flag,
       c_name || ' ' || c_mktsegment AS article_title, o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey""")
# Sessions an instrument covers, with gap flag and forward-filled prices.
cte("spans", "SELECT ticker, exchange, min(date) AS a, max(date) AS b FROM bars GROUP BY ticker, exchange")
cte("gridded", """
SELECT s.ticker, s.exchange, c.date, b.open, b.high, b.low, b.close, b.volume
FROM spans s JOIN cal c ON c.exchange = s.exchange AND c.is_session AND c.date BETWEEN s.a AND s.b
LEFT JOIN bars b ON b.ticker = s.ticker AND b.exchange = s.exchange AND b.date = c.date""")
cte("aligned", """
SELECT ticker, exchange, date,
       CASE WHEN close IS NULL THEN 1 ELSE 0 END AS market_data_gap_flag,
       coalesce(last_value(open IGNORE NULLS) OVER p, first_value(open IGNORE NULLS) OVER f) AS open,
       coalesce(last_value(high IGNORE NULLS) OVER p, first_value(high IGNORE NULLS) OVER f) AS high,
       coalesce(last_value(low IGNORE NULLS) OVER p, first_value(low IGNORE NULLS) OVER f) AS low,
       last_value(close IGNORE NULLS) OVER p AS close,
       coalesce(volume, 0.0) AS volume
FROM gridded
WINDOW p AS (PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (PARTITION BY ticker, exchange ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
