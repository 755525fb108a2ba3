"""Landed bars and scored articles to the merged training table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.bars import align_to_sessions, clean_bars
from tidemark.operators.merge import FeatureSpec, build_merged, default_spec
from tidemark.operators.news_features import build_news_features
from tidemark.operators.price_features import build_price_features
from tidemark.settings import MarketSettings, NewsSettings, PriceSettings


def price_table(bars: DataFrame, calendar: DataFrame, s: PriceSettings = PriceSettings()) -> DataFrame:
    return build_price_features(align_to_sessions(bars, calendar), calendar, s)


def price_table_from_raw(raw: DataFrame, calendar: DataFrame, s: PriceSettings = PriceSettings()) -> tuple[DataFrame, DataFrame]:
    """(price features, quarantined raw rows)."""
    clean, quarantine = clean_bars(raw)
    return price_table(clean, calendar, s), quarantine


def merged_table(bars: DataFrame, articles: DataFrame, calendar: DataFrame,
                 price: PriceSettings = PriceSettings(), news: NewsSettings = NewsSettings(),
                 market: MarketSettings = MarketSettings(), spec: FeatureSpec | None = None) -> DataFrame:
    spec = spec or default_spec(price)
    return build_merged(price_table(bars, calendar, price), build_news_features(articles, calendar, news, market), spec)
