"""Trading-calendar dimension and session arithmetic.

The calendar is one row per (exchange, day): about 22,000 rows per exchange for
sixty years, fixed by the date range and not by the data. It is therefore the one
table that is always broadcast, and the builder refuses ranges beyond the bound.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.settings import MarketSettings

BROADCAST_ROW_BOUND = 2_000_000


def fixed_closures(spark: SparkSession, market: MarketSettings, start: str, end: str) -> DataFrame:
    """Recurring closures as dates, one per year and (month, day)."""
    years = range(date.fromisoformat(start).year, date.fromisoformat(end).year + 1)
    days = [(date(y, m, d),) for y in years for m, d in market.fixed_holidays]
    return spark.createDataFrame(days, "date date")


def build_calendar(
    spark: SparkSession,
    exchanges: tuple[str, ...] = ("NSE",),
    market: MarketSettings = MarketSettings(),
    closures: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per (exchange, date) with the session flags and neighbours.

    `closures` has `date` and optionally `exchange`; without `exchange` a closure
    holds for every exchange.
    """
    start = start or market.calendar_start
    end = end or market.calendar_end
    rows = ((date.fromisoformat(end) - date.fromisoformat(start)).days + 1) * len(exchanges)
    if rows > BROADCAST_ROW_BOUND:
        raise ValueError(f"calendar of {rows} rows is too large to broadcast")

    days = (
        spark.range(1)
        .select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
        .withColumn("exchange", F.explode(F.array(*[F.lit(e) for e in exchanges])))
    )
    closed = fixed_closures(spark, market, start, end)
    if closures is not None and "exchange" not in closures.columns:
        closed = closed.unionByName(closures.select("date"))
    closed = closed.distinct().withColumn("exchange", F.explode(F.array(*[F.lit(e) for e in exchanges])))
    if closures is not None and "exchange" in closures.columns:
        closed = closed.unionByName(closures.select("date", "exchange"))
    closed = closed.distinct().withColumn("closed", F.lit(True))

    flagged = (
        days.join(F.broadcast(closed), ["exchange", "date"], "left")
        .withColumn("is_session", (F.weekday("date") < 5) & F.col("closed").isNull())
        .drop("closed")
    )
    return with_neighbours(flagged)


def with_neighbours(days: DataFrame) -> DataFrame:
    """Next/previous/on-or-after/on-or-before sessions and a running session index."""
    up = Window.partitionBy("exchange").orderBy("date")
    down = Window.partitionBy("exchange").orderBy(F.col("date").desc())
    session = F.when(F.col("is_session"), F.col("date"))
    to_here = (Window.unboundedPreceding, Window.currentRow)
    before = (Window.unboundedPreceding, -1)
    placed = days.select(
        "exchange",
        "date",
        "is_session",
        F.sum(F.col("is_session").cast("int")).over(up.rowsBetween(*to_here)).alias("session_index"),
        F.max(session).over(up.rowsBetween(*to_here)).alias("on_or_before"),
        F.max(session).over(up.rowsBetween(*before)).alias("previous_session"),
        F.min(session).over(down.rowsBetween(*to_here)).alias("on_or_after"),
        F.min(session).over(down.rowsBetween(*before)).alias("next_session"),
    )
    # The session after the first session on or after the day.
    follower = F.when(F.col("is_session"), F.col("next_session"))
    return placed.withColumn("second_session", F.min(follower).over(down.rowsBetween(*to_here)))


def sessions(calendar: DataFrame) -> DataFrame:
    return calendar.where("is_session").select("exchange", "date", "session_index")


def lookup(df: DataFrame, calendar: DataFrame, on: str, **wanted: str) -> DataFrame:
    """Left-join calendar columns for the day in `on`; `wanted` maps output name to calendar column."""
    side = calendar.select(
        F.col("exchange"),
        F.col("date").alias(on),
        *[F.col(source).alias(name) for name, source in wanted.items()],
    )
    return df.join(F.broadcast(side), ["exchange", on], "left")


def closures_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Closure days from JSON: a list of ISO dates or an object with a `holidays` list."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<string>")
    as_object = F.from_json("value", "struct<holidays:array<string>>")["holidays"]
    return text.select(
        F.explode(F.coalesce(F.when(F.trim("value").startswith("["), as_list), as_object)).alias("d")
    ).select(F.col("d").cast("date").alias("date"))


def session_phase(local_time, is_session, market: MarketSettings = MarketSettings()):
    """pre_market / intraday / after_close by `HH:mm:ss`, non_trading off-session; the close counts as after."""
    return (
        F.when(~F.coalesce(is_session, F.lit(False)), "non_trading")
        .when(local_time < market.open_time, "pre_market")
        .when(local_time < market.close_time, "intraday")
        .otherwise("after_close")
    )
