"""Per session and mode news aggregates, rolling windows and carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.scalars import enum_text, literal_map, safe_text, to_bool, to_float
from tidemark.operators.calendar import session_phase
from tidemark.operators.ema import span_alpha, with_ema
from tidemark.settings import KEYS, MODES, MarketSettings, NewsSettings

IDENTITY = ("date", *KEYS, "prediction_mode")
STATE = "news_signal_state"

# The news feature columns, by group, in table order.
RAW_COLUMNS = (
    "news_article_count", "news_sentiment_dispersion_1d", "news_directional_agreement_rate",
    "news_avg_sentiment", "news_max_severity", "news_avg_relevance", "news_avg_confidence",
    "news_bullish_article_count", "news_bearish_article_count", "news_neutral_article_count",
    "news_full_article_count", "news_headline_plus_snippet_count", "news_headline_only_count",
    "news_warning_article_count", "news_fallback_article_ratio",
    "news_avg_content_quality_score", "news_avg_source_quality_score",
    "news_zero_flag", "news_carried_flag",
)
WEIGHTED_COLUMNS = (
    "news_weighted_sentiment_score", "news_weighted_relevance_score",
    "news_weighted_confidence_score", "news_weighted_source_quality_score",
    "news_weighted_bullish_score", "news_weighted_bearish_score",
)
CHANNEL_METRICS = ("article_count", "article_share", "avg_sentiment", "weighted_sentiment_score", "max_severity")
CHANNEL_COLUMNS = tuple(f"news_{c}_{m}" for c in V.CHANNELS for m in CHANNEL_METRICS)
EVENT_COLUMNS = tuple(f"news_event_count_{e}" for e in V.EVENT_TYPES)
FLAG_COLUMNS = (
    "has_news_signal", "carried_forward_signal", "degraded_news_context",
    "has_fresh_news", "is_carried_forward", "is_fallback_heavy",
)
ROLLING_WINDOWS = (1, 3, 5)
ROLLING_COLUMNS = tuple(
    f"{p}_{k}d" for k in ROLLING_WINDOWS for p in ("news_sentiment", "news_event_count", "news_volume"))
NEWS_COLUMNS = RAW_COLUMNS + WEIGHTED_COLUMNS + CHANNEL_COLUMNS + EVENT_COLUMNS + FLAG_COLUMNS + ROLLING_COLUMNS
COUNT_COLUMNS = (
    "news_article_count", "news_bullish_article_count", "news_bearish_article_count",
    "news_neutral_article_count", "news_full_article_count", "news_headline_plus_snippet_count",
    "news_headline_only_count", "news_warning_article_count", "news_zero_flag", "news_carried_flag",
    *(f"news_{c}_article_count" for c in V.CHANNELS), *EVENT_COLUMNS, *FLAG_COLUMNS,
)
FLOAT_COLUMNS = tuple(c for c in NEWS_COLUMNS if c not in COUNT_COLUMNS)
# Dispersion and the rolling columns (…_1d, _3d, _5d) keep their own values on carried rows.
DECAYED_COLUMNS = tuple(c for c in FLOAT_COLUMNS if not c.endswith("d"))


def feature_range(column: str) -> tuple[float, float]:
    """Closed range a float feature must stay in."""
    if column == "news_sentiment_dispersion_1d":
        return 0.0, 2.0
    if column.startswith(("news_event_count_", "news_volume_")):
        return 0.0, 5000.0
    if "sentiment" in column:
        return -1.0, 1.0
    return 0.0, 1.0


def quality_weight(mode: Column, s: NewsSettings) -> Column:
    return literal_map(s.quality_weights, mode).cast("double")


def source_weight(provider: Column) -> Column:
    return literal_map(V.SOURCE_WEIGHTS, F.lower(safe_text(provider)), V.DEFAULT_SOURCE_WEIGHT).cast("double")


def article_times(articles: DataFrame, calendar: DataFrame, market: MarketSettings = MarketSettings()) -> DataFrame:
    """Market-local time, phase, market date and the target session of each mode."""
    from_utc = F.from_utc_timestamp("published_at_utc", market.timezone)
    local = F.coalesce(F.col("published_at_ist"), from_utc) if "published_at_ist" in articles.columns else from_utc
    dated = articles.withColumn("published_at_market", local).withColumn("_day", F.to_date("published_at_market"))
    side = calendar.select(
        "exchange", F.col("date").alias("_day"), "is_session", "next_session", "second_session")
    joined = dated.join(F.broadcast(side), ["exchange", "_day"], "left")
    phase = session_phase(F.date_format("published_at_market", "HH:mm:ss"), F.col("is_session"), market)
    placed = joined.withColumn("market_phase", phase)
    same_day = F.col("is_session")
    return placed.withColumns({
        "market_date": F.when(same_day & F.col("market_phase").isin("pre_market", "intraday"), F.col("_day"))
        .otherwise(F.col("next_session")),
        "pre_market_target_date": F.when(same_day & (F.col("market_phase") == "pre_market"), F.col("_day"))
        .otherwise(F.col("next_session")),
        "after_close_target_date": F.col("second_session"),
    }).drop("_day", "is_session", "next_session", "second_session")


def article_weights(articles: DataFrame, s: NewsSettings = NewsSettings()) -> DataFrame:
    """Quality, source and confidence weights and their product with relevance."""
    weighted = articles.withColumns({
        "quality_weight": quality_weight(F.col("extraction_mode"), s),
        "source_quality_weight": source_weight(F.col("provider")),
        "confidence_weight": F.col("confidence_score") if s.use_confidence else F.lit(1.0),
        "is_fallback": (F.col("extraction_mode") != "full_article").cast("int"),
        "channel": F.when(F.col("event_type").isin(*V.SECTOR_EVENTS), "sector")
        .when(F.col("event_type").isin(*V.MACRO_EVENTS), "macro").otherwise("company"),
    })
    return weighted.withColumn(
        "article_weight",
        F.col("quality_weight") * F.col("source_quality_weight")
        * F.col("relevance_score") * F.col("confidence_weight"),
    )


def enrich_articles(articles: DataFrame, calendar: DataFrame, s: NewsSettings = NewsSettings(),
                    market: MarketSettings = MarketSettings()) -> DataFrame:
    return article_weights(article_times(articles, calendar, market), s)


def per_mode(enriched: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """One row per article and mode, dated by that mode's target session."""
    slots = F.array(*[
        F.struct(F.lit(m).alias("prediction_mode"), F.col(f"{m}_target_date").alias("date")) for m in modes])
    return enriched.withColumn("_slot", F.explode(slots)).select("*", "_slot.*").drop("_slot")


def row_lineage(enriched: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Articles behind each feature row, one per line, with their sort key.

    The order inside a row is (published_at_market, article_id). Keeping the pairs long
    means no group of articles is ever gathered into one array or one task.
    """
    return per_mode(enriched, modes).select(*IDENTITY, "published_at_market", "article_id")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(0.0)


def aggregate_articles(enriched: DataFrame, s: NewsSettings = NewsSettings(),
                       modes: tuple[str, ...] = MODES) -> DataFrame:
    """All article aggregates of a (ticker, exchange, session, mode) in one groupBy.

    Every aggregate has a partial form, so a hot session is combined before the shuffle.
    """
    col = F.col
    is_bias = {b: (col("directional_bias") == b).cast("int") for b in V.BIASES}
    bias_n = {b: F.sum(is_bias[b]) for b in V.BIASES}
    n = F.count(F.lit(1))
    heavy = (F.avg("is_fallback") > s.fallback_heavy_ratio).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    aggs = {
        "news_article_count": n,
        "news_sentiment_dispersion_1d": F.when(n <= 1, 0.0).otherwise(F.stddev_pop("sentiment_score")),
        "news_directional_agreement_rate": F.greatest(*bias_n.values()) / n,
        "news_avg_sentiment": F.avg("sentiment_score"),
        "news_max_severity": F.max("event_severity"),
        "news_avg_relevance": F.avg("relevance_score"),
        "news_avg_confidence": F.avg("confidence_score"),
        "news_bullish_article_count": bias_n["bullish"],
        "news_bearish_article_count": bias_n["bearish"],
        "news_neutral_article_count": bias_n["neutral"],
        "news_full_article_count": F.count_if(col("extraction_mode") == "full_article"),
        "news_headline_plus_snippet_count": F.count_if(col("extraction_mode") == "headline_plus_snippet"),
        "news_headline_only_count": F.count_if(col("extraction_mode") == "headline_only"),
        "news_warning_article_count": F.count_if(col("warning_flag")),
        "news_fallback_article_ratio": F.avg("is_fallback"),
        "news_avg_content_quality_score": F.avg("content_quality_score"),
        "news_avg_source_quality_score": F.avg("source_quality_weight"),
        "news_zero_flag": zero,
        "news_carried_flag": zero,
        "news_weighted_sentiment_score": weighted_mean(col("sentiment_score"), col("article_weight")),
        "news_weighted_relevance_score": weighted_mean(col("relevance_score"), col("quality_weight")),
        "news_weighted_confidence_score": weighted_mean(col("confidence_score"), col("quality_weight")),
        "news_weighted_source_quality_score": weighted_mean(col("source_quality_weight"), col("article_weight")),
        "news_weighted_bullish_score": weighted_mean(is_bias["bullish"], col("article_weight")),
        "news_weighted_bearish_score": weighted_mean(is_bias["bearish"], col("article_weight")),
        "has_news_signal": one,
        "carried_forward_signal": zero,
        "degraded_news_context": heavy,
        "has_fresh_news": one,
        "is_carried_forward": zero,
        "is_fallback_heavy": heavy,
    }
    for c in V.CHANNELS:
        inside = col("channel") == c
        score, weight = F.when(inside, col("sentiment_score")), F.when(inside, col("article_weight"))
        aggs |= {
            f"news_{c}_article_count": F.count_if(inside),
            f"news_{c}_article_share": F.count_if(inside) / n,
            f"news_{c}_avg_sentiment": F.coalesce(F.avg(score), F.lit(0.0)),
            f"news_{c}_weighted_sentiment_score": F.coalesce(weighted_mean(score, weight), F.lit(0.0)),
            f"news_{c}_max_severity": F.coalesce(F.max(F.when(inside, col("event_severity"))), F.lit(0.0)),
        }
    for e in V.EVENT_TYPES:
        aggs[f"news_event_count_{e}"] = F.count_if(col("event_type") == e)
    return per_mode(enriched, modes).groupBy(*IDENTITY).agg(*[v.alias(k) for k, v in aggs.items()])


def dense_grid(grouped: DataFrame, calendar: DataFrame) -> DataFrame:
    """Fill the sessions between an instrument's first and last target with zero rows.

    Each row is exploded over the sessions up to the next row of its mode, so the grid
    needs one (ticker, exchange) shuffle of the already aggregated rows and no grid join.
    """
    filled = tuple(c for c in grouped.columns if c not in IDENTITY)
    indexed = grouped.join(
        F.broadcast(calendar.where("is_session").select("exchange", "date", "session_index")), ["exchange", "date"])
    whole = Window.partitionBy(*KEYS)
    w = Window.partitionBy(*KEYS, "prediction_mode").orderBy("date")
    edge = indexed.withColumns({
        "_first": F.min("session_index").over(whole), "_last": F.max("session_index").over(whole),
        "_next": F.lead("session_index").over(w), "_rank": F.row_number().over(w),
    })
    start = F.when(F.col("_rank") == 1, F.col("_first")).otherwise(F.col("session_index"))
    spread = edge.withColumn(
        "_slot", F.explode(F.sequence(start, F.coalesce(F.col("_next") - 1, F.col("_last")))))
    own = F.col("_slot") == F.col("session_index")
    slots = calendar.where("is_session").select(
        "exchange", F.col("session_index").alias("_slot"), F.col("date").alias("_session"))

    def value(c: str) -> Column:
        if c == "news_zero_flag":
            return F.when(own, F.col(c)).otherwise(1).cast("long")
        kind = "long" if c in COUNT_COLUMNS else "double"
        return F.when(own, F.col(c)).otherwise(F.lit(0).cast(kind))

    return spread.join(F.broadcast(slots), ["exchange", "_slot"]).select(
        F.col("_session").alias("date"), *KEYS, "prediction_mode", *[value(c).alias(c) for c in filled])


def rolling_news(grid: DataFrame, windows: tuple[int, ...] = ROLLING_WINDOWS) -> DataFrame:
    """Rolling volume and event counts and the sentiment average per mode."""
    part = (*KEYS, "prediction_mode")
    w = Window.partitionBy(*part).orderBy("date")
    events = F.lit(0)
    for e in EVENT_COLUMNS:
        events = events + F.col(e)
    out = grid.withColumn("_events", events)
    sums = {}
    for k in windows:
        frame = w.rowsBetween(-(k - 1), 0)
        sums[f"news_volume_{k}d"] = F.sum("news_article_count").over(frame).cast("double")
        sums[f"news_event_count_{k}d"] = F.sum("_events").over(frame).cast("double")
        if k == 1:
            sums["news_sentiment_1d"] = F.col("news_weighted_sentiment_score")
    out = out.withColumns(sums).drop("_events")
    return with_ema(out, {
        f"news_sentiment_{k}d": ("news_weighted_sentiment_score", span_alpha(k), 1) for k in windows if k > 1
    }, part)


def signal_state() -> Column:
    """One label per row; a fallback-heavy or degraded row outranks fresh and carried news."""
    def on(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)) == 1
    return (
        F.when(on("is_fallback_heavy") | on("degraded_news_context"), V.FALLBACK)
        .when(on("has_fresh_news"), V.FRESH)
        .when(on("is_carried_forward"), V.CARRIED)
        .when(F.coalesce(F.col("news_article_count"), F.lit(0)) > 0, V.FRESH)
        .otherwise(V.ZERO)
    )


def carry_forward(grid: DataFrame, s: NewsSettings = NewsSettings()) -> DataFrame:
    """Give zero-news rows the decayed values of the last row with news.

    A carried row counts as news for the row after it, so the decay runs on without an
    end: value * decay**distance. `max_carry_sessions` limits the distance.
    """
    if s.carry_days <= 0:
        return grid
    w = Window.partitionBy(*KEYS, "prediction_mode").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("news_zero_flag") == 0
    placed = grid.withColumn("_rn", F.row_number().over(w))
    source = placed.withColumns({
        "_at": F.last(F.when(fresh, F.col("_rn")), ignorenulls=True).over(so_far),
        **{f"_s_{c}": F.last(F.when(fresh, F.col(c)), ignorenulls=True).over(so_far) for c in DECAYED_COLUMNS},
    })
    distance = F.col("_rn") - F.col("_at")
    carried = F.coalesce(distance > 0, F.lit(False))
    if s.max_carry_sessions is not None:
        carried = carried & (distance <= s.max_carry_sessions)
    scale = F.pow(F.lit(s.carry_decay), distance.cast("double"))
    marked = source.withColumns({"_carried": carried, "_scale": scale})
    flag = F.col("_carried").cast("long")
    out = marked.withColumns({
        **{c: F.when(F.col("_carried"), F.col(f"_s_{c}") * F.col("_scale")).otherwise(F.col(c))
           for c in DECAYED_COLUMNS},
        "news_zero_flag": F.when(F.col("_carried"), 0).otherwise(F.col("news_zero_flag")).cast("long"),
        "news_carried_flag": F.greatest(F.col("news_carried_flag"), flag),
        "has_news_signal": F.greatest(F.col("has_news_signal"), flag),
        "carried_forward_signal": F.greatest(F.col("carried_forward_signal"), flag),
        "is_carried_forward": F.greatest(F.col("is_carried_forward"), flag),
    })
    return out.drop("_rn", "_at", "_carried", "_scale", *[f"_s_{c}" for c in DECAYED_COLUMNS])


def build_news_features(articles: DataFrame, calendar: DataFrame, s: NewsSettings = NewsSettings(),
                        market: MarketSettings = MarketSettings(),
                        modes: tuple[str, ...] = MODES) -> DataFrame:
    """Scored articles to the news feature table."""
    grouped = aggregate_articles(enrich_articles(articles, calendar, s, market), s, modes)
    grid = rolling_news(dense_grid(grouped, calendar), s.rolling_windows)
    return carry_forward(grid, s).withColumn(STATE, signal_state()).select(*IDENTITY, STATE, *NEWS_COLUMNS)


def extraction_rules(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Scored articles in normal form and the rules that a row can break by itself."""
    norm = rows.select(
        safe_text(F.col("article_id")).alias("article_id"),
        *[enum_text(F.col(c)).alias(c) for c in ("sentiment_label", "directional_bias", "event_type", "extraction_mode")],
        *[to_float(F.col(c)).alias(c) for c in V.SCORE_RANGES],
        to_bool(F.col("warning_flag")).alias("warning_flag"),
    )
    allowed = {
        "sentiment_label": V.SENTIMENT_LABELS, "directional_bias": V.BIASES,
        "event_type": V.EVENT_TYPES, "extraction_mode": V.EXTRACTION_MODES,
    }
    checks = {"empty_article_id": F.col("article_id") == ""}
    checks |= {f"unsupported_{c}": ~F.col(c).isin(*values) for c, values in allowed.items()}
    for c, (low, high) in V.SCORE_RANGES.items():
        checks[f"invalid_{c}"] = F.col(c).isNull()
        checks[f"out_of_range_{c}"] = (F.col(c) < low) | (F.col(c) > high)
    checks["invalid_warning_flag"] = F.col("warning_flag").isNull()
    return norm, checks


def extraction_contract(rows: DataFrame) -> DataFrame:
    """Violation counts of a scored-article table, one (rule, violations) row per rule.

    Ids are counted by a two-step aggregate, so a repeated id costs one row per task.
    """
    norm, checks = extraction_rules(rows)
    per_id = norm.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(v).alias(k) for k, v in checks.items()])
    total = per_id.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in checks],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_article_id"))
    names = [*checks, "duplicate_article_id"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return total.selectExpr(f"stack({len(names)}, {pairs}) as (rule, violations)")


def news_feature_rules(modes: tuple[str, ...] = MODES) -> dict[str, Column]:
    """The rules that a row of the news feature table can break by itself."""
    checks = {
        "empty_identity": F.greatest(*[F.col(c).isNull().cast("int") for c in IDENTITY]) == 1,
        "unsupported_mode": ~F.col("prediction_mode").isin(*modes),
        "unsupported_state": ~F.col(STATE).isin(*V.NEWS_STATES),
    }
    for c in COUNT_COLUMNS:
        value = F.col(c).cast("double")
        checks[f"invalid_{c}"] = value.isNull() | F.isnan(value) | (value < 0) | (value % 1 != 0)
    for c in FLOAT_COLUMNS:
        low, high = feature_range(c)
        checks[f"invalid_{c}"] = F.col(c).isNull() | F.isnan(c) | (F.col(c) < low) | (F.col(c) > high)
    return checks


def news_feature_contract(features: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """Violation counts of a news feature table, one (rule, violations) row per rule."""
    checks = news_feature_rules(modes)
    per_key = features.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(v).alias(k) for k, v in checks.items()])
    total = per_key.agg(
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in checks],
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_identity"))
    names = [*checks, "duplicate_identity"]
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return total.selectExpr(f"stack({len(names)}, {pairs}) as (rule, violations)")


def news_feature_summary(features: DataFrame) -> DataFrame:
    """One row per instrument: coverage, zero and carried rows, rows per mode and state."""
    return features.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("output_row_count"),
        F.count_if(F.col("news_article_count") == 0).alias("zero_news_row_count"),
        F.count_if(F.col("news_article_count") > 0).alias("nonzero_news_row_count"),
        F.sum("news_carried_flag").alias("carried_row_count"),
        F.min("date").alias("coverage_start"),
        F.max("date").alias("coverage_end"),
        *[F.count_if(F.col("prediction_mode") == m).alias(f"{m}_row_count") for m in MODES],
        *[F.count_if(F.col(STATE) == st).alias(f"{st}_state_count") for st in V.NEWS_STATES],
    )
