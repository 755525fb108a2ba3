"""Training table: price rows per mode joined with news, lags, interactions, splits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.contracts import one_row_per_key
from tidemark.operators.news_features import NEWS_COLUMNS, STATE
from tidemark.operators.price_features import LABEL, with_lags
from tidemark.settings import KEYS, MODES, ModelSettings, PriceSettings

MERGE_KEYS = ("historical_date", "prediction_date", *KEYS, "prediction_mode")
MERGE_IDENTITY = (*MERGE_KEYS, "close", "volume")
NEWS_JOIN = ("prediction_date", *KEYS, "prediction_mode")

# Columns that belong to the news quality group, by prefix.
QUALITY_PREFIXES = (
    "news_article_count", "news_max_severity", "news_full_article_count",
    "news_headline_plus_snippet_count", "news_headline_only_count",
    "news_warning_article_count", "news_fallback_article_ratio",
    "news_avg_content_quality_score",
)
# Names of the feature groups.
GROUPS = ("historical_features", "news_sentiment_features", "news_event_count_features",
          "news_quality_fallback_features")


@dataclass(frozen=True)
class Interaction:
    name: str
    left: str
    right: str
    center: float = 0.0


def interactions(price_columns: tuple[str, ...], news_columns: tuple[str, ...]) -> tuple[Interaction, ...]:
    """The cross features whose two inputs exist in the tables."""
    rsi = next((c for c in price_columns if c.startswith("rsi_")), "rsi")
    mood = "news_sentiment_3d"
    # Names and inputs of the cross features.
    wanted = (
        Interaction(f"cross_{rsi}_sentiment", rsi, mood, 50.0),
        Interaction("cross_momentum_confidence", "ret_5d", "news_weighted_confidence_score"),
        Interaction("cross_company_sector_sentiment", "news_company_weighted_sentiment_score",
                    "news_sector_weighted_sentiment_score"),
        Interaction("cross_macd_sentiment", "macd", mood),
        Interaction("cross_price_vs_52w_high_sentiment", "price_vs_52w_high", mood),
    )
    known = {*price_columns, *news_columns}
    return tuple(i for i in wanted if i.left in known and i.right in known)


@dataclass(frozen=True)
class FeatureSpec:
    """Column plan of the merged table; the same plan serves training and live rows."""

    price: tuple[str, ...]
    news: tuple[str, ...]
    lags: tuple[int, ...]

    @property
    def lagged(self) -> tuple[str, ...]:
        return tuple(f"{c}_lag{k}" for k in self.lags for c in self.news)

    @property
    def crosses(self) -> tuple[Interaction, ...]:
        return interactions(self.price, self.news)

    @property
    def extended_news(self) -> tuple[str, ...]:
        return self.news + self.lagged + tuple(i.name for i in self.crosses)

    @property
    def all(self) -> tuple[str, ...]:
        return self.price + self.extended_news

    def groups(self) -> dict[str, tuple[str, ...]]:
        events = tuple(c for c in self.extended_news if "news_event_count_" in c)
        quality = tuple(c for c in self.extended_news if c.startswith(QUALITY_PREFIXES) and c not in events)
        rest = tuple(c for c in self.extended_news if c not in events and c not in quality)
        return dict(zip(GROUPS, (self.price, rest, events, quality)))


def default_spec(price: PriceSettings = PriceSettings(), model: ModelSettings = ModelSettings()) -> FeatureSpec:
    return FeatureSpec(price.feature_columns, NEWS_COLUMNS, tuple(sorted(set(model.lags))))


def expand_modes(price_rows: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """One row per price row and mode; a constant-size explode, not a cross join."""
    return (
        price_rows.withColumnRenamed("date", "historical_date")
        .withColumnRenamed("target_date", "prediction_date")
        .withColumn("prediction_mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    )


def join_news(expanded: DataFrame, news: DataFrame, columns: tuple[str, ...] = NEWS_COLUMNS) -> DataFrame:
    """Left join of the mode rows with their news row; absent news becomes zeros.

    One-to-one: a news key that occurs twice fails the join, by a guard on the rows that the
    join's own shuffle brings together. `news_missing` marks rows without a news row.
    """
    side = news.withColumnRenamed("date", "prediction_date").select(*NEWS_JOIN, STATE, *columns)
    side = one_row_per_key(side, list(NEWS_JOIN), "news rows")
    joined = expanded.join(side.withColumn("_hit", F.lit(True)), list(NEWS_JOIN), "left")
    return joined.withColumns({
        "news_missing": F.col("_hit").isNull(),
        STATE: F.coalesce(F.col(STATE), F.lit("zero_news")),
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in columns},
    }).drop("_hit")


def add_crosses(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns({
        i.name: (F.coalesce(F.col(i.left), zero) - i.center) * F.coalesce(F.col(i.right), zero)
        for i in spec.crosses
    })


def apply_spec(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """News lags per (ticker, exchange, mode) in prediction order, then the crosses."""
    lagged = with_lags(df, spec.news, spec.lags, (*KEYS, "prediction_mode"), "prediction_date", fill=0.0)
    return add_crosses(lagged, spec)


def build_merged(price_rows: DataFrame, news: DataFrame, spec: FeatureSpec | None = None,
                 modes: tuple[str, ...] = MODES) -> DataFrame:
    spec = spec or default_spec()
    merged = apply_spec(join_news(expand_modes(price_rows, modes), news, spec.news), spec)
    extra = [c for c in ("market_data_gap_flag", "market_data_gap_count_5d") if c in merged.columns]
    return merged.select(*MERGE_IDENTITY, STATE, *extra, "news_missing", *spec.all, LABEL)


def temporal_split(df: DataFrame, train_ratio: float, validation_ratio: float,
                   partition: tuple[str, ...], order: str) -> DataFrame:
    """`split` by row order inside each group: train, then validation, then test.

    Cut points use the same double arithmetic as int(n * ratio).
    """
    whole = Window.partitionBy(*partition)
    rn = F.row_number().over(whole.orderBy(order))
    n = F.count(F.lit(1)).over(whole)
    train_end = F.floor(n * F.lit(train_ratio))
    validation_end = F.floor(n * F.lit(train_ratio + validation_ratio))
    return df.withColumn("split", F.when(rn <= train_end, "train").when(rn <= validation_end, "validation")
                         .otherwise("test"))


def split_merged(df: DataFrame, s: ModelSettings = ModelSettings()) -> DataFrame:
    return temporal_split(df, s.train_ratio, s.validation_ratio, (*KEYS, "prediction_mode"), "prediction_date")


def split_price(df: DataFrame, s: ModelSettings = ModelSettings()) -> DataFrame:
    return temporal_split(df, s.train_ratio, s.validation_ratio, KEYS, "date")


def split_summary(df: DataFrame, date_column: str, group: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*group, "split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(date_column).alias("date_start"),
        F.max(date_column).alias("date_end"),
    )


def evaluation_rows(df: DataFrame) -> DataFrame:
    """Validation and test rows together, with their split name."""
    return df.where(F.col("split").isin("validation", "test"))


def _not_finite(c: str):
    value = F.col(c).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def training_rules(keys: tuple[str, ...], features: tuple[str, ...], label: str = LABEL) -> dict:
    """Row rules of a training table, for `contracts.observed` and `contracts.guarded`."""
    return {
        "non_finite_feature": reduce(lambda a, b: a | b, [_not_finite(c) for c in features], F.lit(False)),
        "empty_key": F.greatest(*[F.col(k).isNull() for k in keys]),
        "invalid_close": _not_finite("close") | (F.col("close") <= 0),
        "invalid_volume": _not_finite("volume") | (F.col("volume") < 0),
        "non_binary_label": F.col(label).isNull() | ~F.col(label).isin(0, 1),
    }


def training_contract(df: DataFrame, keys: tuple[str, ...], features: tuple[str, ...], label: str = LABEL) -> DataFrame:
    """Violation counts of a training table, one (rule, violations) row per rule."""
    broken = _not_finite

    bad_features = F.lit(0)
    for c in features:
        bad_features = bad_features + broken(c).cast("int")
    per_key = df.withColumn("_bad", bad_features).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_bad").alias("non_finite_feature"),
        F.count_if(F.greatest(*[F.col(k).isNull() for k in keys])).alias("empty_key"),
        F.count_if(broken("close") | (F.col("close") <= 0)).alias("invalid_close"),
        F.count_if(broken("volume") | (F.col("volume") < 0)).alias("invalid_volume"),
        F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("non_binary_label"),
    )
    names = ["non_finite_feature", "empty_key", "invalid_close", "invalid_volume", "non_binary_label", "duplicate_key"]
    total = per_key.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names[:-1]],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_key"))
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return total.selectExpr(f"stack({len(names)}, {pairs}) as (rule, violations)")
