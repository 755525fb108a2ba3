"""Plain settings objects. Every operator takes the part it needs."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("ticker", "exchange")
MODES = ("pre_market", "after_close")

# Formula versions of the two feature tables.
PRICE_FORMULA_VERSION = "5"
NEWS_FORMULA_VERSION = "4"


@dataclass(frozen=True)
class MarketSettings:
    timezone: str = "Asia/Kolkata"
    open_time: str = "09:15:00"
    close_time: str = "15:30:00"
    # (month, day) closures that recur every year.
    fixed_holidays: tuple[tuple[int, int], ...] = ((1, 26), (5, 1), (8, 15), (10, 2))
    calendar_start: str = "1990-01-01"
    calendar_end: str = "2050-12-31"


@dataclass(frozen=True)
class PriceSettings:
    return_windows: tuple[int, ...] = (1, 3, 5)
    ma_windows: tuple[int, ...] = (5, 10, 20)
    volatility_windows: tuple[int, ...] = (5, 10)
    rsi_window: int = 14
    volume_window: int = 20
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    year_window: int = 252
    lags: tuple[int, ...] = (1, 2)
    bollinger_window: int = 20
    bollinger_std: float = 2.0
    stochastic_window: int = 14
    atr_window: int = 14
    include_day_of_week: bool = True
    drop_warmup: bool = True
    gap_window: int = 5

    @property
    def base_columns(self) -> tuple[str, ...]:
        cols = [f"ret_{k}d" for k in self.return_windows]
        cols += [f"ma_{k}" for k in self.ma_windows]
        cols += [f"volatility_{k}d" for k in self.volatility_windows]
        cols += ["volume_change_1d", "volume_ma_ratio", "macd", "macd_signal",
                 "price_vs_52w_high", "price_vs_52w_low", f"rsi_{self.rsi_window}",
                 "bb_width", "bb_position", f"atr_{self.atr_window}",
                 "obv_ratio", "stoch_k", "stoch_d"]
        if self.include_day_of_week:
            cols.append("day_of_week")
        return tuple(cols)

    @property
    def feature_columns(self) -> tuple[str, ...]:
        lagged = tuple(f"{c}_lag{k}" for k in self.lags for c in self.base_columns)
        return self.base_columns + lagged

    @property
    def minimum_rows(self) -> int:
        """Input rows needed for at least one labelled, fully populated row."""
        longest = max(
            *self.return_windows, *self.ma_windows,
            *(k + 1 for k in self.volatility_windows),
            self.rsi_window, self.volume_window,
            self.macd_slow + self.macd_signal - 1,
            self.year_window, self.bollinger_window,
            self.stochastic_window, self.atr_window, 20,
        )
        return longest + max(self.lags, default=0) + 1


@dataclass(frozen=True)
class NewsSettings:
    quality_weights: dict[str, float] = field(default_factory=lambda: {
        "full_article": 1.0, "headline_plus_snippet": 0.75, "headline_only": 0.5})
    use_confidence: bool = True
    carry_days: int = 2
    carry_decay: float = 0.7
    # None reproduces the unbounded carry of the original rule.
    max_carry_sessions: int | None = None
    rolling_windows: tuple[int, ...] = (1, 3, 5)
    fallback_heavy_ratio: float = 0.5


@dataclass(frozen=True)
class IngestSettings:
    lookback_days: int = 90
    lookback_buffer_days: int = 2
    max_articles: int = 50
    cache_ttl_hours: float = 24.0
    full_text_min_chars: int = 250
    max_input_chars: int = 12000
    richer_text_margin: int = 80
    recovery_budget: int = 20
    # Source order, best first.
    provider_priority: tuple[str, ...] = (
        "nse_rss", "bse_rss", "nse_announcements", "google_news_rss",
        "economic_times", "alphavantage", "marketaux")


@dataclass(frozen=True)
class ModelSettings:
    model_type: str = "gradient_boosting"
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    test_ratio: float = 0.15
    threshold: float = 0.5
    logistic_c: float = 1.0
    logistic_max_iter: int = 1000
    gbt_trees: int = 300
    gbt_depth: int = 4
    gbt_rate: float = 0.02
    gbt_subsample: float = 0.8
    gbt_min_leaf: int = 10
    rf_trees: int = 300
    # None means unlimited; Spark trees stop at depth 30.
    rf_depth: int | None = None
    rf_min_leaf: int = 10
    balanced_weights: bool = True
    calibrate: bool = True
    seed: int = 42
    lags: tuple[int, ...] = (1, 2)


@dataclass(frozen=True)
class PilotSettings:
    pre_market_run: str = "08:05"
    after_close_run: str = "16:15"
    abstain_margin: float = 0.05
    quality_floor: float = 55.0
    carried_penalty: float = 0.02
    degraded_penalty: float = 0.05
    fallback_heavy_ratio: float = 0.5
    overlap_days: int = 5
    high_confidence_margin: float = 0.10
    slow_run_seconds: float = 120.0


@dataclass(frozen=True)
class EvaluationSettings:
    materiality: float = 0.02
    news_heavy_min_articles: int = 1
