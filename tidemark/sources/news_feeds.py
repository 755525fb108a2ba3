"""Normalizers of landed news payloads to the processed-article schema.

Each takes a DataFrame of landed records with `ticker` and `exchange`, and returns all
records with `reasons`; rows without reasons are articles, the others are the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_text
from tidemark.functions.times import article_id, market_timestamp, provider_timestamp
from tidemark.functions.urls import publisher_name, source_domain, validate_url
from tidemark.settings import MarketSettings

# Columns of the processed-article table.
ARTICLE_COLUMNS = (
    "article_id", "ticker", "exchange", "provider", "discovery_mode", "provider_uuid",
    "article_title", "article_url", "canonical_url", "source_domain", "provider_source",
    "source_name", "published_at_raw", "published_at_utc", "published_at_ist",
    "published_date_ist", "summary_snippet", "full_text", "content_origin",
    "text_acquisition_mode", "text_acquisition_reason", "fetch_warning_flag", "fetch_error",
    "http_status", "provider_entity_payload", "raw_snapshot_path", "fetched_at_utc",
)
# Provider names, discovery modes and labels of the feeds.
TICKER_FEED, RSS_FEED, ANNOUNCEMENTS = "alphavantage", "google_news_rss", "nse_announcements"
ANNOUNCEMENT_LABEL, ANNOUNCEMENT_HOST = "NSE Corporate Announcements", "https://www.nseindia.com"
OFFICIAL_LABELS = {"nse_rss": "NSE Official RSS", "bse_rss": "BSE Official RSS"}

ENTITY = "struct<symbol:string,name:string,exchange:string,country:string,type:string>"
COMPANY_SCHEMA = (
    "struct<data:array<struct<uuid:string,title:string,published_at:string,url:string,description:string,"
    f"snippet:string,source:string,entities:array<{ENTITY}>>>>")
TICKER_SCHEMA = (
    "struct<feed:array<struct<title:string,time_published:string,url:string,source:string,summary:string,"
    "overall_sentiment_score:string,overall_sentiment_label:string,topics:array<struct<topic:string,relevance_score:string>>,"
    "ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string,"
    "ticker_sentiment_label:string>>>>>")
NOTICE = "struct<subject:string,exchdisstime:string,attchmntFile:string,bflag:string,`desc`:string>"
RSS_ITEM = "struct<title:string,pubDate:string,link:string,source:struct<_VALUE:string,_url:string>>"


def _finish(df: DataFrame, market: MarketSettings) -> DataFrame:
    """Add local times, empty acquisition columns and the fixed column order."""
    local = F.from_utc_timestamp("published_at_utc", market.timezone)
    text = {c: F.lit(None).cast("string") for c in (
        "full_text", "content_origin", "text_acquisition_mode", "text_acquisition_reason", "fetch_error")}
    extra = {c: F.lit(None).cast(t) for c, t in (
        ("raw_snapshot_path", "string"), ("fetched_at_utc", "timestamp")) if c not in df.columns}
    out = df.withColumns({
        "published_at_ist": local, "published_date_ist": F.to_date(local),
        "fetch_warning_flag": F.lit(None).cast("boolean"), "http_status": F.lit(None).cast("int"), **text, **extra})
    # A refused record gets no id.
    out = out.withColumn("article_id", F.when(F.size("reasons") == 0, F.col("article_id")))
    return out.select(*ARTICLE_COLUMNS, "reasons")


def _reasons(title: Column, published: Column, url: Column, checked: Column, *more: Column) -> Column:
    return F.array_compact(F.array(
        F.when(title.isNull(), "missing_title"),
        F.when(published.isNull(), "invalid_published_at"),
        F.when(url.isNotNull() & checked["url"].isNull(), F.coalesce(checked["reason"], F.lit("invalid_article_url"))),
        *more))


def company_news(payloads: DataFrame, provider: str, discovery_mode: str = "entity_symbols",
                 symbols: Column | None = None, market: MarketSettings = MarketSettings()) -> DataFrame:
    """Company-news pages: JSON text in `payload` with a `data` array.

    `symbols` is an array column of resolved symbols; entities outside it are left out.
    """
    carry = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*carry, F.explode(F.from_json("payload", COMPANY_SCHEMA)["data"]).alias("a")).where("a is not null")
    entities = F.coalesce(F.col("a.entities"), F.array().cast(f"array<{ENTITY}>"))
    entities = F.filter(entities, lambda e: e.isNotNull())
    if symbols is not None:
        wanted = F.transform(symbols, lambda s: F.upper(s))
        entities = F.when(F.size(symbols) > 0, F.filter(
            entities, lambda e: F.array_contains(wanted, F.upper(F.trim(e["symbol"]))))).otherwise(entities)
    base = rows.select(
        *carry,
        clean_text(F.col("a.title")).alias("article_title"),
        clean_text(F.col("a.published_at")).alias("published_at_raw"),
        clean_text(F.col("a.url")).alias("article_url"),
        clean_text(F.col("a.uuid")).alias("provider_uuid"),
        F.coalesce(clean_text(F.col("a.description")), clean_text(F.col("a.snippet"))).alias("summary_snippet"),
        clean_text(F.col("a.source")).alias("provider_source"),
        F.to_json(entities).alias("provider_entity_payload"))
    base = base.withColumns({
        "published_at_utc": provider_timestamp(F.col("published_at_raw")), "_u": validate_url(F.col("article_url"))})
    base = base.withColumn("canonical_url", F.col("_u.url"))
    base = base.withColumn("source_domain", source_domain(F.coalesce("canonical_url", "article_url", "provider_source")))
    out = base.withColumns({
        "provider": F.lit(provider), "discovery_mode": F.lit(discovery_mode),
        "source_name": publisher_name(F.col("provider_source"), F.col("source_domain")),
        "article_id": article_id(*[F.col(c) for c in (
            "provider_uuid", "canonical_url", "article_url", "article_title", "published_at_utc")]),
        "reasons": _reasons(F.col("article_title"), F.col("published_at_utc"), F.col("article_url"), F.col("_u"))})
    return _finish(out, market)


def ticker_feed(payloads: DataFrame, market: MarketSettings = MarketSettings()) -> DataFrame:
    """Ticker-sentiment pages: JSON text in `payload` with a `feed` array."""
    carry = [c for c in payloads.columns if c != "payload"]
    rows = payloads.select(*carry, F.explode(F.from_json("payload", TICKER_SCHEMA)["feed"]).alias("a")).where("a is not null")
    mine = F.filter(F.col("a.ticker_sentiment"), lambda e: F.trim(e["ticker"]) == F.upper(F.trim(F.col("ticker"))))
    base = rows.select(
        *carry,
        clean_text(F.col("a.title")).alias("article_title"),
        clean_text(F.col("a.time_published")).alias("published_at_raw"),
        clean_text(F.col("a.url")).alias("article_url"),
        clean_text(F.col("a.source")).alias("provider_source"),
        clean_text(F.col("a.summary")).alias("summary_snippet"),
        F.coalesce(F.size(mine), F.lit(0)).alias("_matches"),
        F.to_json(F.struct(
            clean_text(F.col("a.overall_sentiment_label")).alias("overall_sentiment_label"),
            clean_text(F.col("a.overall_sentiment_score")).alias("overall_sentiment_score"),
            mine.alias("ticker_sentiment"), F.col("a.topics").alias("topics"))).alias("provider_entity_payload"))
    base = base.withColumns({
        "published_at_utc": provider_timestamp(F.col("published_at_raw")), "_u": validate_url(F.col("article_url"))})
    base = base.withColumn("canonical_url", F.col("_u.url"))
    base = base.withColumn("source_domain", source_domain(F.coalesce("canonical_url", "article_url", "provider_source")))
    out = base.withColumns({
        "provider": F.lit(TICKER_FEED), "discovery_mode": F.lit("ticker_sentiment"),
        "provider_uuid": F.lit(None).cast("string"),
        "source_name": publisher_name(F.col("provider_source"), F.col("source_domain")),
        "article_id": article_id(F.lit(None).cast("string"), *[F.col(c) for c in (
            "canonical_url", "article_url", "article_title", "published_at_utc")]),
        "reasons": _reasons(
            F.col("article_title"), F.col("published_at_utc"), F.col("article_url"), F.col("_u"),
            F.when(F.col("provider_source").isNull(), "missing_source_name"),
            F.when(F.col("_matches") <= 0, "missing_requested_ticker_sentiment"))})
    return _finish(out, market)


def rss_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS documents held as text in `feed`, one row per item."""
    carry = [c for c in feeds.columns if c != "feed"]
    schema = f"struct<channel:struct<item:array<{RSS_ITEM}>>>"
    return feeds.select(*carry, F.explode(F.from_xml("feed", schema)["channel"]["item"]).alias("i")).select(*carry, "i.*")


def read_rss(spark, path: str) -> DataFrame:
    """Items of landed RSS files, split at the item tag."""
    return spark.read.format("xml").option("rowTag", "item").schema(
        "title string, pubDate string, link string, source struct<_VALUE:string,_url:string>").load(path)


def rss_articles(items: DataFrame, market: MarketSettings = MarketSettings()) -> DataFrame:
    """RSS items (title, pubDate, link, source with url) to articles; no canonical URL."""
    base = items.withColumns({
        "article_title": clean_text(F.col("title")), "published_at_raw": clean_text(F.col("pubDate")),
        "_link": clean_text(F.col("link")), "provider_source": clean_text(F.col("source._VALUE")),
        "_source_url": clean_text(F.col("source._url"))})
    base = base.withColumns({
        "published_at_utc": provider_timestamp(F.col("published_at_raw")), "_u": validate_url(F.col("_link"))})
    base = base.withColumns({
        "article_url": F.coalesce("_u.url", "_link"), "canonical_url": F.lit(None).cast("string"),
        "source_domain": source_domain(F.coalesce("_source_url", "provider_source"))})
    out = base.withColumns({
        "provider": F.lit(RSS_FEED), "discovery_mode": F.lit("rss_search"),
        "provider_uuid": F.lit(None).cast("string"), "summary_snippet": F.lit(None).cast("string"),
        "source_name": publisher_name(F.col("provider_source"), F.col("source_domain")),
        "provider_entity_payload": F.to_json(F.struct(F.col("_source_url").alias("source_url"))),
        "article_id": article_id(
            F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("article_url"), F.col("article_title"),
            F.col("published_at_utc")),
        "reasons": _reasons(
            F.col("article_title"), F.col("published_at_utc"), F.col("_link"), F.col("_u"),
            F.when(F.col("provider_source").isNull(), "missing_source_name"))})
    return _finish(out, market)


def official_rss(articles: DataFrame, provider: str) -> DataFrame:
    """Relabel scope-matched RSS articles as exchange notices."""
    return articles.withColumns({
        "provider": F.lit(provider), "discovery_mode": F.lit("official_rss"),
        "provider_source": F.lit(OFFICIAL_LABELS[provider])})


def announcement_rows(payloads: DataFrame) -> DataFrame:
    """Announcements in `payload`: a JSON list or an object with a `data` list."""
    carry = [c for c in payloads.columns if c != "payload"]
    listed = F.from_json("payload", f"array<{NOTICE}>")
    wrapped = F.from_json("payload", f"struct<data:array<{NOTICE}>>")["data"]
    rows = F.when(F.ltrim("payload").startswith("["), listed).otherwise(wrapped)
    return payloads.select(*carry, F.explode(rows).alias("n")).where("n is not null").select(*carry, "n.*")


def announcements(rows: DataFrame, market: MarketSettings = MarketSettings()) -> DataFrame:
    """Exchange announcements; naive times are market-local, relative attachments get the host."""
    attachment = clean_text(F.col("attchmntFile"))
    base = rows.withColumns({
        "article_title": clean_text(F.col("subject")), "published_at_raw": clean_text(F.col("exchdisstime")),
        "provider_uuid": attachment,
        "_link": F.when(attachment.startswith("/"), F.concat(F.lit(ANNOUNCEMENT_HOST), attachment)).otherwise(attachment)})
    base = base.withColumns({
        "published_at_utc": market_timestamp(F.col("published_at_raw"), market.timezone), "_u": validate_url(F.col("_link"))})
    base = base.withColumns({"article_url": F.col("_u.url"), "canonical_url": F.col("_u.url")})
    out = base.withColumns({
        "provider": F.lit(ANNOUNCEMENTS), "discovery_mode": F.lit("corp_announcements"),
        "source_domain": source_domain(F.lit(ANNOUNCEMENT_HOST)),
        "provider_source": F.lit(ANNOUNCEMENT_LABEL), "source_name": F.lit(ANNOUNCEMENT_LABEL),
        "summary_snippet": clean_text(F.col("desc")),
        "provider_entity_payload": F.to_json(F.struct(
            F.col("provider_uuid").alias("attachment_path"), clean_text(F.col("bflag")).alias("bflag"))),
        "article_id": article_id(*[F.col(c) for c in (
            "provider_uuid", "canonical_url", "article_url", "article_title", "published_at_utc")]),
        "reasons": _reasons(F.col("article_title"), F.col("published_at_utc"), F.col("_link"), F.col("_u"))})
    return _finish(out, market)


def split_articles(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, quarantined records with reasons)."""
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)
