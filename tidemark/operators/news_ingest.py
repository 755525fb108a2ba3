"""Article collection: scope, specificity, dedupe, ranking, text acquisition, summaries."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import bound, clean_text, match_text
from tidemark.functions.urls import validate_url
from tidemark.settings import KEYS, IngestSettings

# Discovery bonus of the specificity score.
DISCOVERY_BONUS = {"corp_announcements": 4, "ticker_sentiment": 3, "entity_symbols": 2, "search_fallback": 1}
# Ingest priority of the providers; any other named provider is 3, none is 9.
PROVIDER_RANK = {"nse_announcements": 0, "nse_rss": 1, "bse_rss": 1, "alphavantage": 2, "google_news_rss": 4}


def company_terms(catalog: DataFrame) -> DataFrame:
    """Normalized ticker, company name and aliases per instrument, longest first."""
    raw = F.concat(F.array("symbol", "company_name"), F.coalesce("search_aliases", F.array().cast("array<string>")))
    terms = F.array_distinct(F.filter(F.transform(raw, match_text), lambda t: t != ""))
    ordered = F.transform(
        F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return catalog.select(
        F.col("symbol").alias("ticker"), "exchange", ordered.alias("terms"), match_text(F.col("company_name")).alias("company_norm"))


def with_terms(articles: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach the terms of the article's instrument; Spark broadcasts the catalog if it is small."""
    return articles.join(company_terms(catalog), list(KEYS), "left")


def matches_scope(title: Column, snippet: Column, terms: Column) -> Column:
    """Whether any term occurs anywhere in title or snippet."""
    text = F.concat_ws(" ", match_text(title), match_text(snippet))
    return bound(text, lambda x: F.coalesce(F.exists(terms, lambda t: F.contains(x, t)), F.lit(False)))


def whole_token_hits(text: Column, terms: Column) -> Column:
    """Number of terms that occur as their own token span.

    The cheap containment test runs first, so the pattern is built for candidates only.
    """
    def hits(x: Column) -> Column:
        def hit(t: Column) -> Column:
            pattern = F.concat(F.lit(r"(?<![a-z0-9])\Q"), t, F.lit(r"\E(?![a-z0-9])"))
            return F.contains(x, t) & F.regexp_like(x, pattern)
        return F.coalesce(F.size(F.filter(terms, hit)), F.lit(0))

    return bound(text, hits)


def payload_bonus(payload: Column, ticker: Column, company: Column) -> Column:
    """Bonus of the provider payload: 3 for the instrument itself, 2 for the company name."""
    listed = F.from_json(payload, "array<struct<symbol:string,name:string>>")
    scored = F.transform(listed, lambda e: F.when(clean_text(e["symbol"]) == ticker, 3)
                         .when(match_text(e["name"]) == company, 2).otherwise(0))
    first = F.coalesce(F.get(F.filter(scored, lambda x: x > 0), F.lit(0)), F.lit(0))
    wrapped = F.from_json(payload, "struct<ticker_sentiment:array<string>,name:string>")
    name = match_text(wrapped["name"])
    single = F.when(F.coalesce(F.size(wrapped["ticker_sentiment"]), F.lit(0)) > 0, 3).when(
        (name != "") & (name == company), 2).otherwise(0)
    return F.when(F.ltrim(payload).startswith("["), first).when(payload.isNotNull(), single).otherwise(0)


def specificity(articles: DataFrame, name: str = "specificity") -> DataFrame:
    """Company specificity score; needs `terms` and `company_norm` from `with_terms`."""
    title, snippet = match_text(F.col("article_title")), match_text(F.col("summary_snippet"))
    bonus = F.lit(0)
    for mode, value in DISCOVERY_BONUS.items():
        bonus = F.when(clean_text(F.col("discovery_mode")) == mode, value).otherwise(bonus)
    payload = payload_bonus(F.col("provider_entity_payload"), F.col("ticker"), F.col("company_norm"))
    return articles.withColumn(
        name,
        F.least(whole_token_hits(title, F.col("terms")), F.lit(3)) * 4
        + F.least(whole_token_hits(snippet, F.col("terms")), F.lit(2)) * 2 + payload + bonus)


def entity_score(symbol: Column, name: Column, exchange: Column, country: Column, kind: Column,
                 ticker: Column, company: Column, alias: Column, home_exchange: Column, home_country: Column) -> Column:
    """How well a provider entity matches a ticker; fixed weights 100/60/30/20/10/5."""
    def up(c):
        return F.upper(F.trim(F.coalesce(c, F.lit(""))))
    norm = match_text(name)
    parts = (
        (up(symbol) == F.upper(ticker), 100), (norm == match_text(company), 60), (norm == match_text(alias), 30),
        (up(exchange) == F.upper(home_exchange), 20), (up(country) == F.upper(home_country), 10), (up(kind) == "EQUITY", 5))
    return reduce(lambda a, b: a + b, [F.when(cond, value).otherwise(0) for cond, value in parts])


def union_sources(frames: Iterable[tuple[str, DataFrame | None]], spark) -> tuple[DataFrame | None, DataFrame]:
    """Union of the sources that landed, and one status row per source.

    A source without data (None) adds no rows and a warning, it does not stop the others.
    """
    landed, status = [], []
    for name, frame in frames:
        status.append((name, "ok" if frame is not None else "failed", None if frame is not None else f"{name}_unavailable"))
        if frame is not None:
            landed.append(frame)
    union = reduce(lambda a, b: a.unionByName(b), landed) if landed else None
    return union, spark.createDataFrame(status, "provider string, status string, warning string")


def read_or_none(read, path: str) -> DataFrame | None:
    """The source at `path`, or None when it has not landed."""
    from pyspark.errors import AnalysisException

    try:
        return read(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in (exc.getCondition() or ""):
            return None
        raise


def dedupe_articles(articles: DataFrame) -> DataFrame:
    """One article per canonical URL, or per (domain, title, UTC day) where there is no URL.

    The longest snippet wins, then the newest, then provider id and article id. Articles
    without a usable key are all kept. The winner is an aggregate with a map-side form, so
    a page copied many times costs one row per task in the shuffle. `copies` counts the
    rows each winner stands for.
    """
    url = clean_text(F.col("canonical_url"))
    title = match_text(F.col("article_title"))
    domain = F.coalesce(clean_text(F.col("source_domain")), F.lit(""))
    day = F.date_format("published_at_utc", "yyyy-MM-dd")
    by_title = F.when((domain != "") & (title != "") & day.isNotNull(), F.concat_ws("\x1f", F.lit("t"), domain, title, day))
    keyed = articles.withColumn("_key", F.when(url.isNotNull(), F.concat_ws("\x1f", F.lit("u"), url)).otherwise(by_title))
    cols = [c for c in articles.columns if c not in KEYS]
    best = F.struct(
        (-F.length(F.coalesce("summary_snippet", F.lit("")))).alias("a"),
        (-F.unix_micros("published_at_utc")).alias("b"),
        F.col("provider_uuid").isNull().alias("c"), F.col("provider_uuid").alias("d"), F.col("article_id").alias("e"))
    won = (
        keyed.where("_key is not null").groupBy(*KEYS, "_key")
        .agg(F.min_by(F.struct(*cols), best).alias("w"), F.count(F.lit(1)).alias("copies"))
        .select(*KEYS, "w.*", "copies"))
    alone = keyed.where("_key is null").drop("_key").withColumn("copies", F.lit(1).cast("long"))
    return won.unionByName(alone.select(won.columns))


def provider_rank(provider: Column) -> Column:
    name = F.coalesce(clean_text(provider), F.lit(""))
    out = F.when(name == "", 9)
    for p, rank in PROVIDER_RANK.items():
        out = out.when(name == p, rank)
    return out.otherwise(3)


def rank_articles(articles: DataFrame, limit: int) -> DataFrame:
    """First `limit` articles per instrument: provider rank, specificity, newest, source, id.

    The rank filter lets Spark keep only `limit` rows per instrument and task before the
    shuffle, so an instrument with most of the articles stays cheap.
    """
    order = (
        provider_rank(F.col("provider")), F.col("specificity").desc(), F.col("published_at_utc").desc_nulls_last(),
        F.coalesce(F.col("source_name"), F.lit("")), F.coalesce(F.col("article_id"), F.lit("")))
    w = Window.partitionBy(*KEYS).orderBy(*order)
    return articles.withColumn("priority", F.row_number().over(w)).where(F.col("priority") <= limit)


def fallback_text(title: Column, snippet: Column) -> Column:
    title = F.coalesce(clean_text(title), F.lit(""))
    snippet = clean_text(snippet)
    return F.when(snippet.isNotNull(), F.concat(title, F.lit("\n\n"), snippet)).otherwise(title)


def text_usability(text: Column, title: Column, snippet: Column, s: IngestSettings = IngestSettings()) -> Column:
    """Null when the fetched text is materially richer than title and snippet, else the reason."""
    provided = F.when(snippet.isNotNull() & (snippet != ""), F.concat(
        F.coalesce(title, F.lit("")), F.lit("\n\n"), snippet)).otherwise(F.coalesce(title, F.lit("")))

    def compared(p: Column) -> Column:
        candidate, baseline = p["candidate"], p["baseline"]
        return F.when((baseline != "") & (candidate == baseline), "article_text_matches_provider_text").when(
            (baseline != "") & (F.length(candidate) < F.length(baseline) + s.richer_text_margin),
            "article_text_not_materially_richer")

    def judged(cleaned: Column) -> Column:
        return F.when(cleaned.isNull(), "no_article_text_found").when(
            F.length(cleaned) < s.full_text_min_chars, "article_text_below_min_chars").otherwise(
            bound(F.struct(match_text(cleaned).alias("candidate"), match_text(provided).alias("baseline")), compared))

    return bound(clean_text(text), judged)


def acquire_text(articles: DataFrame, text: str, reason: str | None = None, s: IngestSettings = IngestSettings()) -> DataFrame:
    """Choose full text or the headline fallback and describe the outcome.

    `text` is the fetched article text; `reason` an optional column naming why it succeeded.
    """
    refused = text_usability(F.col(text), F.col("article_title"), F.col("summary_snippet"), s)
    # A column of its own, since five others name it.
    articles, refused = articles.withColumn("_refused", refused), F.col("_refused")
    usable = refused.isNull()
    has_snippet = clean_text(F.col("summary_snippet")).isNotNull()
    mode = F.when(usable, "full_article").when(has_snippet, "headline_plus_snippet").otherwise("headline_only")
    out = articles.withColumns({
        "text_acquisition_mode": mode,
        "text_acquisition_reason": F.coalesce(refused, F.col(reason) if reason else F.lit("article_tag")),
        "fetch_warning_flag": ~usable,
        "full_text": F.when(usable, clean_text(F.col(text))).otherwise(
            fallback_text(F.col("article_title"), F.col("summary_snippet"))),
    })
    return out.withColumn("content_origin", content_origin(F.col("text_acquisition_mode"))).drop("_refused")


def content_origin(mode: Column) -> Column:
    return F.when(mode == "full_article", "direct_publisher_text").when(
        mode == "headline_plus_snippet", "aggregator_text").otherwise("snippet_only")


def cache_lookup(articles: DataFrame, cache: DataFrame, now: Column, ttl_hours: float) -> DataFrame:
    """Hit, expired or miss per article by canonical URL and age of the cached text.

    The cache is reduced to its newest entry per key before the join, so a popular URL
    meets one cached row; the article side may repeat it freely.
    """
    key = validate_url(F.coalesce(clean_text(F.col("canonical_url")), clean_text(F.col("article_url"))))["url"]
    payload = [c for c in cache.columns if c not in ("cache_key",)]
    newest = cache.groupBy("cache_key").agg(F.max_by(F.struct(*payload), F.col("cached_at_utc")).alias("entry"))
    joined = articles.withColumn("cache_key", key).join(newest, "cache_key", "left")
    age = (F.unix_micros(now) - F.unix_micros("entry.cached_at_utc")) / 3.6e9
    fresh = age.between(0.0, float(ttl_hours)) & F.lit(ttl_hours > 0)
    return joined.withColumns({
        "cache_age_hours": age,
        "cache_status": F.when(age.isNull(), "miss").when(fresh, "hit").otherwise("expired")})


def adaptive_lookback(coverage_end: Column, target: Column, s: IngestSettings = IngestSettings()) -> Column:
    """Look-back days that close the coverage gap, at least the configured number."""
    seconds = (F.unix_micros(target) - F.unix_micros(coverage_end)) / 1e6
    gap = F.greatest(F.lit(0), F.floor(seconds / 86400.0))
    return F.coalesce(F.greatest(gap + s.lookback_buffer_days, F.lit(s.lookback_days)), F.lit(s.lookback_days)).cast("int")


def provider_label(providers: Column) -> Column:
    """The provider's name when there is exactly one, else `multi_source`."""
    unique = F.array_distinct(providers)
    return F.when(F.size(unique) == 1, F.element_at(unique, 1)).otherwise("multi_source")


def ingest_summary(articles: DataFrame) -> DataFrame:
    """Counts, ratios and degraded-source warnings per instrument.

    Providers are the few known feeds, so the set per instrument stays small.
    """
    n = F.count(F.lit(1))
    direct = F.count_if(F.col("content_origin") == "direct_publisher_text")
    low = F.count_if(F.col("specificity") < 4)
    out = articles.groupBy(*KEYS).agg(
        n.alias("row_count"), F.min("published_date_ist").alias("coverage_start"),
        F.max("published_date_ist").alias("coverage_end"),
        F.sort_array(F.collect_set(clean_text(F.col("provider")))).alias("providers_used"),
        F.countDistinct("source_domain").alias("source_domain_count"),
        F.countDistinct("source_name").alias("source_name_count"),
        direct.alias("direct_text_count"), (n - direct).alias("fallback_count"), low.alias("low_specificity_count"),
        *[F.count_if(F.col("text_acquisition_mode") == m).alias(f"{m}_count")
          for m in ("full_article", "headline_plus_snippet", "headline_only")])
    rows = F.col("row_count")
    return out.withColumns({
        "provider_label": provider_label(F.col("providers_used")),
        "warnings": F.array_compact(F.array(
            F.when(F.array_join("providers_used", ",") == "google_news_rss", "degraded_source_google_only"),
            F.when(F.col("fallback_count") / rows > 0.5, "degraded_source_fallback_majority"),
            F.when(F.col("low_specificity_count") / rows > 0.5, "degraded_source_low_specificity")))})


def value_counts(articles: DataFrame, column: str) -> DataFrame:
    """Long counts of one column per instrument; null counts as the text `null`."""
    return articles.groupBy(*KEYS, F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("column", F.lit(column))
