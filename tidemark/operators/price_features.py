"""Technical features and the next-session label, one window pass per instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ema import span_alpha, with_ema
from tidemark.settings import KEYS, PriceSettings

LABEL = "target_next_day_direction"
IDENTITY = ("date", "target_date", "ticker", "exchange", "close", "volume")
GAP_COLUMNS = ("market_data_gap_flag", "market_data_gap_count_5d")


def by_instrument() -> "Window":
    return Window.partitionBy(*KEYS).orderBy("date")


def full(fn: Column, counted: Column, k: int, frame) -> Column:
    """Window value only when the frame holds `k` non-null inputs."""
    return F.when(F.count(counted).over(frame) == k, fn.over(frame))


def safe_ratio(numerator: Column, denominator: Column, neutral: float) -> Column:
    return F.when(denominator == 0, F.lit(neutral)).otherwise(F.try_divide(numerator, denominator))


def technical_features(bars: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    """All base features on session-aligned bars."""
    w = by_instrument()

    def last(k: int):
        return w.rowsBetween(-(k - 1), 0)

    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    prev = F.lag("close").over(w)
    delta = close - prev
    moved = F.coalesce(F.signum(delta), F.lit(0.0))

    first = {f"ret_{k}d": F.try_divide(close, F.lag("close", k).over(w)) - 1.0 for k in s.return_windows}
    first["_ret"] = F.try_divide(close, prev) - 1.0
    first |= {f"ma_{k}": full(F.avg("close"), close, k, last(k)) for k in s.ma_windows}
    first["_prev_volume"] = F.lag("volume").over(w)
    first["_volume_ma"] = full(F.avg("volume"), volume, s.volume_window, last(s.volume_window))
    year = last(s.year_window)
    first["price_vs_52w_high"] = F.try_divide(close, full(F.max("close"), close, s.year_window, year))
    first["price_vs_52w_low"] = F.try_divide(close, full(F.min("close"), close, s.year_window, year))
    band = last(s.bollinger_window)
    first["_mid"] = full(F.avg("close"), close, s.bollinger_window, band)
    first["_std"] = full(F.stddev_pop("close"), close, s.bollinger_window, band)
    first["_true_range"] = F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    first["_signed_volume"] = moved * volume
    stoch = last(s.stochastic_window)
    first["_low"] = full(F.min("low"), low, s.stochastic_window, stoch)
    first["_high"] = full(F.max("high"), high, s.stochastic_window, stoch)
    first["_gain"] = F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0)))
    first["_loss"] = F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))
    first["market_data_gap_count_5d"] = F.sum("market_data_gap_flag").over(last(s.gap_window))
    out = bars.withColumns(first)

    upper = F.col("_mid") + s.bollinger_std * F.col("_std")
    lower = F.col("_mid") - s.bollinger_std * F.col("_std")
    width = upper - lower
    span = F.col("_high") - F.col("_low")
    second = {f"volatility_{k}d": full(F.stddev_pop("_ret"), F.col("_ret"), k, last(k))
              for k in s.volatility_windows}
    second |= {
        "volume_change_1d": safe_ratio(volume, F.col("_prev_volume"), 1.0) - 1.0,
        "volume_ma_ratio": safe_ratio(volume, F.col("_volume_ma"), 1.0),
        "bb_width": F.when(F.abs("_mid") > 1e-12, width / F.col("_mid")),
        # Degenerate and warm-up bands are neutral, never null.
        "bb_position": F.coalesce(
            F.when(F.abs(width) > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (close - lower) / width))),
            F.lit(0.5)),
        f"atr_{s.atr_window}": full(F.avg("_true_range"), F.col("_true_range"), s.atr_window, last(s.atr_window)),
        "_obv": F.sum("_signed_volume").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "stoch_k": F.coalesce(F.when(span != 0, (close - F.col("_low")) / span * 100.0), F.lit(50.0)),
    }
    if s.include_day_of_week:
        second["day_of_week"] = F.weekday("date").cast("double")
    out = out.withColumns(second)
    out = out.withColumns({
        "obv_ratio": safe_ratio(F.col("_obv"), F.avg("_obv").over(last(20)), 1.0),
        "stoch_d": F.avg("stoch_k").over(last(3)),
    })

    out = with_ema(out, {
        "_fast": ("close", span_alpha(s.macd_fast), s.macd_fast),
        "_slow": ("close", span_alpha(s.macd_slow), s.macd_slow),
        "_avg_gain": ("_gain", 1.0 / s.rsi_window, s.rsi_window),
        "_avg_loss": ("_loss", 1.0 / s.rsi_window, s.rsi_window),
    }, KEYS).withColumn("macd", F.col("_fast") - F.col("_slow"))
    out = with_ema(out, {"macd_signal": ("macd", span_alpha(s.macd_signal), s.macd_signal)}, KEYS)
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    rsi = (
        F.when((gain == 0) & (loss == 0), 50.0)
        .when((loss == 0) & (gain > 0), 100.0)
        .when((gain == 0) & (loss > 0), 0.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))
    )
    out = out.withColumn(f"rsi_{s.rsi_window}", rsi)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def with_lags(df: DataFrame, columns: tuple[str, ...], lags: tuple[int, ...],
              partition: tuple[str, ...] = KEYS, order: str = "date", fill: float | None = None) -> DataFrame:
    """`<column>_lag<k>` of every column. The columns travel through the window as one struct, looked back at once per lag."""
    w = Window.partitionBy(*partition).orderBy(order)
    looked = df.withColumns({f"_back{k}": F.lag(F.struct(*columns), k).over(w) for k in lags})

    def lagged(c: str, k: int) -> Column:
        value = F.col(f"_back{k}.{c}")
        return value if fill is None else F.coalesce(value, F.lit(fill))

    return looked.withColumns({f"{c}_lag{k}": lagged(c, k) for k in lags for c in columns}).drop(*[f"_back{k}" for k in lags])


def with_label(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Next-session direction (ties count as down) and the session it refers to."""
    nxt = F.lead("close").over(by_instrument())
    labelled = df.withColumn(LABEL, F.when(nxt.isNotNull(), (nxt > F.col("close")).cast("int")))
    side = calendar.select("exchange", "date", F.col("next_session").alias("target_date"))
    return labelled.join(F.broadcast(side), ["exchange", "date"], "left")


def price_feature_rows(aligned: DataFrame, calendar: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    """Features, lags and label for every aligned row, with a `ready` flag per row."""
    feats = with_label(with_lags(technical_features(aligned, s), s.base_columns, s.lags), calendar)
    ready = F.lit(True)
    for c in ("date", "close", "volume", *s.feature_columns):
        ready = ready & F.col(c).isNotNull()
    return feats.select(*IDENTITY, *GAP_COLUMNS, *s.feature_columns, LABEL, ready.alias("ready"))


def readiness(rows: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    """Mark the warm-up rows and the holes after warm-up.

    `first_ready` is the first fully populated date of the instrument; a later row
    that is not ready is a hole, which breaks the contract.
    """
    whole = Window.partitionBy(*KEYS)
    first = F.min(F.when(F.col("ready"), F.col("date"))).over(whole)
    last = F.max("date").over(whole)
    return rows.withColumns({"first_ready": first, "last_date": last}).withColumns({
        "is_warmup": F.coalesce(F.col("date") < F.col("first_ready"), F.lit(True)),
        "is_hole": F.coalesce((F.col("date") > F.col("first_ready")) & ~F.col("ready"), F.lit(False)),
        "is_unlabelled_tail": F.col(LABEL).isNull() & (F.col("date") == F.col("last_date")),
        "is_label_hole": F.col(LABEL).isNull() & (F.col("date") < F.col("last_date")),
    })


def feature_ready(rows: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    marked = readiness(rows, s)
    return marked.where("not is_warmup") if s.drop_warmup else marked


def build_price_features(aligned: DataFrame, calendar: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    """Training table: feature-ready rows with a label."""
    kept = feature_ready(price_feature_rows(aligned, calendar, s), s)
    return kept.where(F.col(LABEL).isNotNull()).select(*IDENTITY, *GAP_COLUMNS, *s.feature_columns, LABEL)


def price_feature_summary(rows: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    """One row per instrument: rows in and out, warm-up, holes, gap fill, coverage."""
    marked = readiness(rows, s)
    kept = ~F.col("is_warmup")
    output = kept & F.col(LABEL).isNotNull()
    return marked.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("input_row_count"),
        F.count_if(output).alias("output_row_count"),
        F.count_if(F.col("is_warmup")).alias("warmup_rows_dropped"),
        F.count_if(kept & F.col("is_unlabelled_tail")).alias("label_rows_dropped"),
        F.count_if(F.col("is_hole")).alias("hole_count"),
        F.count_if(kept & F.col("is_label_hole")).alias("label_hole_count"),
        F.sum("market_data_gap_flag").alias("gap_filled_row_count"),
        F.max(F.when(output, F.col("market_data_gap_count_5d"))).alias("max_gap_count_5d"),
        F.min(F.when(output, F.col("date"))).alias("coverage_start"),
        F.max(F.when(output, F.col("date"))).alias("coverage_end"),
    )
