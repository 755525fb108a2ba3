"""News ingest: feeds, URLs, text, dedupe, ranking, cache, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.functions import times as T
from tidemark.functions import urls as U
from tidemark.functions.decisions import compact_reasons
from tidemark.functions.html_text import with_article_text
from tidemark.operators import news_ingest as G
from tidemark.queries import ingest_inputs as D
from tidemark.queries import inputs as I
from tidemark.queries.inputs import ntz, r
from tidemark.queries.oracle import cte, in_list, rnd
from tidemark.queries.registry import ENTRIES, query
from tidemark.settings import KEYS, IngestSettings
from tidemark.sources import candles, news_feeds, tables
from tidemark.sources.catalog import overlay_catalog

S = IngestSettings()


@query("text_cleaning", "X1", f"""
SELECT doc_id, {D.clean('text')} AS cleaned, md5({D.match('text')}) AS match_hash,
       md5(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g'))) AS safe_hash FROM documents""")
def text_cleaning(spark, sf):
    text = F.col("text")
    return I.table(spark, sf, "documents").select(
        "doc_id", X.clean_text(text).alias("cleaned"), F.md5(X.match_text(text)).alias("match_hash"),
        F.md5(X.safe_text(text)).alias("safe_hash"))


@query("enum_normalization", "X2", """
SELECT doc_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g'))),
       '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS enum_value FROM documents""")
def enum_normalization(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", X.enum_text(F.col("text")).alias("enum_value"))


cte("page_parts", """
SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|ga_|fbclid|gclid|mc_|ref)'))) AS params
FROM pages""")


@query("url_canonical", "X3", """
SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
       || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url, CAST(NULL AS VARCHAR) AS reason FROM page_parts""")
def url_canonical(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", U.validate_url(F.col("url")).alias("u")).select(
        "page_id", F.col("u.url").alias("canonical_url"), F.col("u.reason").alias("reason"))


_CASES = (
    ("HTTPS://Example.com:443/path/?utm_source=feed&b=2&a=1#fragment", "https://example.com/path?a=1&b=2", None),
    ("javascript:alert(1)", None, "invalid_article_url"),
    ("https://user:pw@example.com/a", None, "article_url_contains_credentials"),
    ("http://127.0.0.1/a", None, "disallowed_article_url_host"),
    ("http://localhost/a", None, "disallowed_article_url_host"),
    ("http://192.168.4.5/a", None, "disallowed_article_url_host"),
    ("http://8.8.8.8/a", "http://8.8.8.8/a", None),
    ("http://bad-.example.com/", None, "disallowed_article_url_host"),
    ("http://example.com:99999/", None, "malformed_article_url"),
    ("http://example.com:8080/a;x=1?q=a+b&empty=&refer=z", "http://example.com:8080/a?empty=&q=a+b", None),
)


@query("url_validation", "X3", f"""
SELECT p.page_id, c.url || CASE WHEN c.reason IS NULL AND c.url NOT LIKE '%?%' THEN '' ELSE '' END AS canonical_url, c.reason
FROM pages p JOIN (VALUES {', '.join("(%d, %s, %s)" % (i, "NULL" if u is None else repr(u), "NULL" if x is None else repr(x)) for i, (_, u, x) in enumerate(_CASES))}) c(i, url, reason)
ON p.page_id % {len(_CASES)} = c.i""")
def url_validation(spark, sf):
    """Every page id checks one of the known hard URLs."""
    raw = I.pick(tuple(c[0] for c in _CASES), F.col("page_id") % len(_CASES))
    return I.table(spark, sf, "pages").select("page_id", U.validate_url(raw).alias("u")).select(
        "page_id", F.col("u.url").alias("canonical_url"), F.col("u.reason").alias("reason"))


@query("source_names", "X4", """
WITH h AS (SELECT *, string_split(regexp_replace(host, '^www\\.', ''), '.') AS parts FROM page_parts),
n AS (SELECT *, array_to_string(list_transform(string_split(replace(parts[1], '-', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS label FROM h)
SELECT page_id, host AS source_domain, label AS domain_label,
       CASE page_id % 3 WHEN 0 THEN label WHEN 1 THEN label ELSE 'The Daily ' || (page_id % 7) END AS source_name FROM n""")
def source_names(spark, sf):
    # Provider label: the bare host, nothing, or a name of its own.
    k = F.col("page_id")
    pages = I.table(spark, sf, "pages").withColumn("dom", U.source_domain(F.col("url")))
    given = F.when(k % 3 == 0, F.upper("dom")).when(k % 3 == 2, F.concat(F.lit("  The   Daily "), (k % 7).cast("string")))
    return pages.select(
        "page_id", F.col("dom").alias("source_domain"), U.publisher_from_domain(F.col("dom")).alias("domain_label"),
        U.publisher_name(given, F.col("dom")).alias("source_name"))


@query("article_ids", "X5", """
SELECT article_id AS source_id, coalesce(CASE WHEN doc_id % 6 = 0 THEN provider_uuid END,
  substr(sha256(coalesce(canonical_url, '') || chr(10) || '' || chr(10) || article_title || chr(10) || strftime(published_at_utc, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10)), 1, 24)) AS article_id
FROM doc_articles""")
def article_ids(spark, sf):
    return D.articles(spark, sf).select(
        F.col("article_id").alias("source_id"),
        T.article_id(F.when(F.col("doc_id") % 6 == 0, F.col("provider_uuid")), F.col("canonical_url"),
                     F.lit(None).cast("string"), F.col("article_title"), F.col("published_at_utc")).alias("article_id"))


@query("company_specificity", "X6", "SELECT article_id, specificity FROM doc_scored")
def company_specificity(spark, sf):
    scored = G.specificity(G.with_terms(D.articles(spark, sf), D.catalog(spark, sf)))
    return scored.select("article_id", "specificity")


@query("company_scope", "F8", """
SELECT article_id, len(list_filter(terms, lambda t: contains(title_norm || ' ' || snippet_norm, t))) > 0 AS in_scope FROM doc_norm""")
def company_scope(spark, sf):
    rows = G.with_terms(D.articles(spark, sf), D.catalog(spark, sf))
    return rows.select("article_id", G.matches_scope(
        F.col("article_title"), F.col("summary_snippet"), F.col("terms")).alias("in_scope"))


@query("entity_scores", "X7", """
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 40 = s_nationkey THEN 100 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 60 ELSE 0 END
  + CASE WHEN s_suppkey % 3 = 1 THEN 30 ELSE 0 END
  + CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 7 = 0 THEN 5 ELSE 0 END AS INTEGER) AS score
FROM supplier""")
def entity_scores(spark, sf):
    k = F.col("s_suppkey")
    cat = D.catalog(spark, sf).select("symbol", "company_name", F.element_at("search_aliases", 1).alias("alias"))
    rows = I.table(spark, sf, "supplier").withColumn(
        "symbol", F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).join(cat, "symbol")
    return rows.select("s_suppkey", G.entity_score(
        F.concat(F.lit(" n"), (k % 40).cast("string")),
        F.when(k % 3 == 0, F.lower("company_name")).when(k % 3 == 1, F.upper("alias")).otherwise("other"),
        F.when(k % 2 == 0, "nse").otherwise("BSE"), F.when(k % 5 == 0, "IN").otherwise("us"),
        F.when(k % 7 == 0, "Equity").otherwise("index"),
        F.col("symbol"), F.col("company_name"), F.col("alias"), F.lit("NSE"), F.lit("in")).alias("score"))


cte("stamp_rows", """
SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t, event_id % 9 AS f FROM events""")


@query("timestamp_parsing", "X8", """
SELECT event_id, CASE f WHEN 1 THEN date_trunc('minute', t) WHEN 4 THEN t - INTERVAL 330 MINUTE WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE t END AS provider_ts,
  CASE f WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN t WHEN 4 THEN t - INTERVAL 330 MINUTE WHEN 2 THEN t - INTERVAL 330 MINUTE WHEN 6 THEN t - INTERVAL 330 MINUTE
         WHEN 5 THEN t WHEN 8 THEN t - INTERVAL 330 MINUTE ELSE NULL END AS market_ts
FROM stamp_rows""")
def timestamp_parsing(spark, sf):
    t, f = F.date_trunc("second", F.col("ts")), F.col("event_id") % 9
    raw = (
        F.when(f == 0, F.date_format(t, "yyyyMMdd'T'HHmmss")).when(f == 1, F.date_format(t, "yyyyMMdd'T'HHmm"))
        .when(f == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(f == 3, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(f == 4, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .when(f == 5, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(f == 6, F.concat(F.lit("  "), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" ")))
        .when(f == 7, F.lit("yesterday")).otherwise(F.date_format(t, "dd-MMM-yyyy HH:mm:ss")))
    return I.table(spark, sf, "events").select(
        "event_id", ntz(T.provider_timestamp(raw)).alias("provider_ts"),
        ntz(T.market_timestamp(raw, I.MARKET.timezone)).alias("market_ts"))


_baseline = D.match("CASE WHEN summary_snippet IS NOT NULL THEN article_title || chr(10) || chr(10) || summary_snippet ELSE article_title END")
cte("acquired", f"""
SELECT *, CASE WHEN {D.clean('fetched')} IS NULL THEN 'no_article_text_found' WHEN length({D.clean('fetched')}) < 250 THEN 'article_text_below_min_chars'
     WHEN {_baseline} <> '' AND {D.match('fetched')} = {_baseline} THEN 'article_text_matches_provider_text'
     WHEN {_baseline} <> '' AND length({D.match('fetched')}) < length({_baseline}) + 80 THEN 'article_text_not_materially_richer' END AS refused
FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN article_title || chr(10) || summary_snippet ELSE page_text END AS fetched FROM doc_articles)""")


@query("text_acquisition", "X9", f"""
SELECT article_id, CASE WHEN refused IS NULL THEN 'full_article' WHEN {D.clean('summary_snippet')} IS NOT NULL THEN 'headline_plus_snippet' ELSE 'headline_only' END AS text_acquisition_mode,
  coalesce(refused, 'article_tag') AS text_acquisition_reason, refused IS NOT NULL AS fetch_warning_flag,
  CASE WHEN refused IS NULL THEN 'direct_publisher_text' WHEN {D.clean('summary_snippet')} IS NOT NULL THEN 'aggregator_text' ELSE 'snippet_only' END AS content_origin,
  md5(CASE WHEN refused IS NULL THEN {D.clean('fetched')} WHEN {D.clean('summary_snippet')} IS NOT NULL
    THEN coalesce({D.clean('article_title')}, '') || chr(10) || chr(10) || {D.clean('summary_snippet')} ELSE coalesce({D.clean('article_title')}, '') END) AS text_hash
FROM acquired""")
def text_acquisition(spark, sf):
    d = F.col("doc_id")
    rows = D.articles(spark, sf).drop("text_acquisition_mode", "content_origin").withColumn(
        "fetched", F.when(d % 10 == 0, None).when(d % 10 == 1, F.concat("article_title", F.lit("\n"), "summary_snippet"))
        .otherwise(F.col("page_text")))
    return G.acquire_text(rows, "fetched", None, S).select(
        "article_id", "text_acquisition_mode", "text_acquisition_reason", "fetch_warning_flag", "content_origin",
        F.md5("full_text").alias("text_hash"))


@query("page_article_text", "X10 U4")
def page_article_text(spark, sf):
    pages = I.table(spark, sf, "pages").select("page_id", "html")
    return with_article_text(pages).select(
        "page_id", "text_source", F.length("article_text").alias("n_chars"), F.md5("article_text").alias("text_hash"))


@query("article_dedupe", "U3", "SELECT article_id, ticker, canonical_url, copies FROM doc_deduped")
def article_dedupe(spark, sf):
    return G.dedupe_articles(D.articles(spark, sf).drop("page_text")).select("article_id", "ticker", "canonical_url", "copies")


@query("article_ranking", "K1 X6 U3", """
SELECT ticker, article_id, specificity, CAST(row_number() OVER (PARTITION BY ticker ORDER BY
  CASE provider WHEN 'nse_announcements' THEN 0 WHEN 'nse_rss' THEN 1 WHEN 'bse_rss' THEN 1 WHEN 'alphavantage' THEN 2 WHEN 'google_news_rss' THEN 4 ELSE 3 END,
  specificity DESC, published_at_utc DESC, source_name, article_id) AS INTEGER) AS priority FROM doc_deduped QUALIFY priority <= 50""")
def article_ranking(spark, sf):
    kept = G.dedupe_articles(D.articles(spark, sf).drop("page_text"))
    scored = G.specificity(G.with_terms(kept, D.catalog(spark, sf)))
    return G.rank_articles(scored, S.max_articles).select("ticker", "article_id", "specificity", "priority")


@query("reason_dedupe", "U5", """
WITH p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
f AS (SELECT doc_id, trim(x) AS x, min(i) AS i FROM p WHERE trim(x) <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
SELECT d.doc_id, coalesce(string_agg(n.x, '|' ORDER BY n.i), '') AS reasons FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id AND n.rn <= 6 GROUP BY d.doc_id""")
def reason_dedupe(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("|", compact_reasons(F.split("text", " "))).alias("reasons"))


cte("url_cache", """
SELECT 'https://' || source || '.example.com/' || md5(text) AS cache_key, max(TIMESTAMP '2000-01-01' + to_hours(CAST(doc_id % 700 AS INTEGER))) AS cached_at_utc
FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1""")


@query("article_cache_lookup", "J9", f"""
SELECT a.article_id, {rnd("date_diff('second', c.cached_at_utc, TIMESTAMP '2000-01-20 06:00:00') / 3600.0::DOUBLE")} AS cache_age_hours,
  CASE WHEN c.cached_at_utc IS NULL THEN 'miss' WHEN date_diff('second', c.cached_at_utc, TIMESTAMP '2000-01-20 06:00:00') / 3600.0::DOUBLE BETWEEN 0 AND 240 THEN 'hit' ELSE 'expired' END AS cache_status
FROM doc_articles a LEFT JOIN url_cache c ON c.cache_key = a.canonical_url""")
def article_cache_lookup(spark, sf):
    d = F.col("doc_id")
    cache = I.table(spark, sf, "documents").where(d % 4 != 3).select(
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.md5("text")).alias("cache_key"),
        F.timestamp_seconds(F.lit(946684800) + (d % 700) * 3600).alias("cached_at_utc"),
        F.lit("headline_only").alias("text_acquisition_mode"))
    rows = D.articles(spark, sf).select("article_id", "canonical_url", F.lit(None).cast("string").alias("article_url"))
    out = G.cache_lookup(rows, cache, F.lit("2000-01-20 06:00:00").cast("timestamp"), 240.0)
    return out.select("article_id", r("cache_age_hours").alias("cache_age_hours"), "cache_status")


@query("adaptive_lookback", "X26", """
SELECT ticker, CAST(coalesce(greatest(greatest(0, floor(date_diff('second', max(published_at_utc), TIMESTAMP '2002-01-01') / 86400.0::DOUBLE)) + 2, 90), 90) AS INTEGER) AS lookback_days
FROM extractions GROUP BY ticker""")
def adaptive_lookback(spark, sf):
    cover = I.extractions(spark, sf).groupBy("ticker").agg(F.max("published_at_utc").alias("end"))
    return cover.select("ticker", G.adaptive_lookback(F.col("end"), F.lit("2002-01-01").cast("timestamp"), S).alias("lookback_days"))


@query("ingest_summary", "A11 X28", """
WITH s AS (SELECT ticker, exchange, count(*) AS row_count, min(CAST(published_at_utc AS DATE)) AS coverage_start, max(CAST(published_at_utc AS DATE)) AS coverage_end,
  array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers_used, count(DISTINCT source_domain) AS source_domain_count, count(DISTINCT source_name) AS source_name_count,
  count(*) FILTER (text_acquisition_mode = 'full_article') AS direct_text_count, count(*) FILTER (text_acquisition_mode <> 'full_article') AS fallback_count,
  count(*) FILTER (specificity < 4) AS low_specificity_count FROM doc_scored GROUP BY ticker, exchange)
SELECT *, CASE WHEN providers_used NOT LIKE '%,%' THEN providers_used ELSE 'multi_source' END AS provider_label,
  concat_ws(',', CASE WHEN providers_used = 'google_news_rss' THEN 'degraded_source_google_only' END,
            CASE WHEN fallback_count / row_count > 0.5 THEN 'degraded_source_fallback_majority' END,
            CASE WHEN low_specificity_count / row_count > 0.5 THEN 'degraded_source_low_specificity' END) AS warnings FROM s""")
def ingest_summary(spark, sf):
    scored = G.specificity(G.with_terms(D.articles(spark, sf).drop("page_text"), D.catalog(spark, sf)))
    out = G.ingest_summary(scored)
    return out.select(
        *KEYS, "row_count", "coverage_start", "coverage_end", F.array_join("providers_used", ",").alias("providers_used"),
        "source_domain_count", "source_name_count", "direct_text_count", "fallback_count", "low_specificity_count",
        "provider_label", F.concat_ws(",", "warnings").alias("warnings"))


@query("ingest_value_counts", "A11", """
SELECT ticker, exchange, coalesce(source_domain, 'null') AS value, count(*) AS n, 'source_domain' AS "column" FROM doc_articles GROUP BY ALL
UNION ALL SELECT ticker, exchange, text_acquisition_mode AS value, count(*) AS n, 'text_acquisition_mode' AS "column" FROM doc_articles GROUP BY ALL""")
def ingest_value_counts(spark, sf):
    rows = D.articles(spark, sf)
    return G.value_counts(rows, "source_domain").unionByName(G.value_counts(rows, "text_acquisition_mode"))


# ---- landed feeds ---------------------------------------------------------------

_FEED_URLS = ("https://WWW.{s}.example.com:443/p/{n}/?utm_source=x&b=2&a=1", "javascript:alert(1)", "http://user:pw@host.example.com/a")


def _feed_rows(spark, sf):
    d = F.col("doc_id")
    title = F.substring_index("text", "\n", 1)
    url = (
        F.when(d % 5 == 0, None).when(d % 41 == 0, _FEED_URLS[1]).when(d % 43 == 0, _FEED_URLS[2])
        .otherwise(F.concat(F.lit("https://WWW."), F.col("source"), F.lit(".example.com:443/p/"),
                            d.cast("string"), F.lit("/?utm_source=x&b=2&a=1"))))
    at = F.timestamp_seconds(F.lit(946684800) + d * 61)
    return I.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("N"), (d % 25).cast("string")).alias("ticker"), F.lit("NSE").alias("exchange"),
        F.when(d % 31 == 0, "  ").otherwise(title).alias("title"), url.alias("url"), at.alias("at"),
        F.substring("text", F.length(title) + 2, F.length("text")).alias("description"),
        F.when(d % 23 == 0, None).otherwise(F.col("source")).alias("source"))


cte("feed_rows", f"""
SELECT doc_id, ticker, CASE WHEN doc_id % 31 = 0 THEN NULL ELSE {D.clean('title')} END AS title,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'javascript:alert(1)' WHEN doc_id % 43 = 0 THEN 'http://user:pw@host.example.com/a'
       ELSE 'https://WWW.' || source || '.example.com:443/p/' || doc_id || '/?utm_source=x&b=2&a=1' END AS url,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0 THEN NULL
       ELSE 'https://www.' || source || '.example.com/p/' || doc_id || '?a=1&b=2' END AS canonical_url,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'invalid_article_url' WHEN doc_id % 43 = 0 THEN 'article_url_contains_credentials' END AS url_reason,
  CASE WHEN doc_id % 37 = 0 THEN NULL ELSE TIMESTAMP '2000-01-01' + to_seconds(doc_id * 61) END AS published_at_utc,
  {D.clean("substr(text, length(title) + 2)")} AS snippet, CASE WHEN doc_id % 23 = 0 THEN NULL ELSE source END AS source
FROM doc_base""")
_iso = "strftime(published_at_utc, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_id = f"substr(sha256(coalesce(canonical_url, '') || chr(10) || coalesce({{url}}, '') || chr(10) || title || chr(10) || {_iso} || chr(10)), 1, 24)"
_out = ("article_id", "ticker", "provider", "article_title", "article_url", "canonical_url", "source_domain", "source_name",
        "published_at_utc", "published_at_ist", "published_date_ist", "summary_snippet")


def _feed_out(judged):
    return judged.select(
        *[ntz(c).alias(c) if c in ("published_at_utc", "published_at_ist") else F.col(c) for c in _out],
        F.concat_ws(",", "reasons").alias("reasons"))


def _feed_sql(provider: str, ident: str, url: str, domain: str, name: str, snippet: str, reasons: str, title: str = "title") -> str:
    return f"""
SELECT CASE WHEN {reasons} = '' THEN {ident} END AS article_id, ticker, '{provider}' AS provider, {title} AS article_title, {url} AS article_url, canonical_url,
       {domain} AS source_domain, {name} AS source_name, published_at_utc, published_at_utc + INTERVAL 330 MINUTE AS published_at_ist,
       CAST(published_at_utc + INTERVAL 330 MINUTE AS DATE) AS published_date_ist, {snippet} AS summary_snippet, {reasons} AS reasons"""


_base_reasons = "CASE WHEN title IS NULL THEN 'missing_title' END, CASE WHEN published_at_utc IS NULL THEN 'invalid_published_at' END, url_reason"
_dom = """CASE WHEN canonical_url IS NOT NULL THEN 'www.' || regexp_extract(canonical_url, '//www\\.([^/]*)', 1) WHEN doc_id % 5 = 0 THEN source
  WHEN doc_id % 41 = 0 THEN 'javascript' WHEN doc_id % 43 = 0 THEN 'host.example.com' END"""
_lab = "upper(regexp_extract({0}, '^(?:www\\.)?([^.]*)', 1)[1:1]) || lower(regexp_extract({0}, '^(?:www\\.)?([^.]*)', 1)[2:])"


@query("company_news_feed", "S4 X3 X4 X5 X8", _feed_sql(
    "marketaux", f"CASE WHEN doc_id % 4 <> 0 THEN 'u' || doc_id ELSE {_id.format(url='url')} END", "url", _dom,
    f"CASE WHEN source IS NULL OR lower(source) = lower({_lab.format('(' + _dom + ')')}) OR lower(source) = ({_dom}) THEN {_lab.format('(' + _dom + ')')} ELSE source END",
    "snippet", f"concat_ws(',', {_base_reasons})") + " FROM feed_rows")
def company_news_feed(spark, sf):
    return _feed_out(news_feeds.company_news(company_pages(spark, sf), "marketaux", market=I.MARKET))


def company_pages(spark, sf):
    d = F.col("doc_id")
    rows = _feed_rows(spark, sf).withColumn("a", F.struct(
        F.when(d % 4 != 0, F.concat(F.lit("u"), d.cast("string"))).alias("uuid"), F.col("title").alias("title"),
        F.when(d % 37 == 0, "soon").otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("published_at"),
        F.col("url").alias("url"), F.col("description").alias("description"), F.lit(None).cast("string").alias("snippet"),
        F.col("source").alias("source"),
        F.array(F.struct(F.col("ticker").alias("symbol"), F.lit("x").alias("name"))).alias("entities")))
    # A landed page holds three articles of one instrument.
    pages = rows.groupBy("ticker", "exchange", F.floor(d / 75).alias("page")).agg(
        F.to_json(F.struct(F.collect_list("a").alias("data"))).alias("payload"))
    return pages.select("ticker", "exchange", "payload")


_tf_reason = f"concat_ws(',', {_base_reasons}, CASE WHEN source IS NULL THEN 'missing_source_name' END, CASE WHEN doc_id % 9 = 0 THEN 'missing_requested_ticker_sentiment' END)"


@query("ticker_sentiment_feed", "S5", _feed_sql(
    "alphavantage", _id.format(url="url"), "url", _dom,
    f"CASE WHEN source IS NULL OR lower(source) = lower({_lab.format('(' + _dom + ')')}) OR lower(source) = ({_dom}) THEN {_lab.format('(' + _dom + ')')} ELSE source END",
    "snippet", _tf_reason) + " FROM feed_rows")
def ticker_sentiment_feed(spark, sf):
    return _feed_out(news_feeds.ticker_feed(ticker_pages(spark, sf), I.MARKET))


def ticker_pages(spark, sf):
    d = F.col("doc_id")
    other = F.when(d % 9 == 0, "ZZZ").otherwise(F.col("ticker"))
    rows = _feed_rows(spark, sf).withColumn("a", F.struct(
        F.col("title").alias("title"),
        F.when(d % 37 == 0, "20000199T000000").otherwise(F.date_format("at", "yyyyMMdd'T'HHmmss")).alias("time_published"),
        F.col("url").alias("url"), F.col("source").alias("source"), F.col("description").alias("summary"),
        F.array(F.struct(F.lit("QQQ").alias("ticker")), F.struct(other.alias("ticker"))).alias("ticker_sentiment")))
    pages = rows.groupBy("ticker", "exchange", F.floor(d / 75).alias("page")).agg(
        F.to_json(F.struct(F.collect_list("a").alias("feed"))).alias("payload"))
    return pages.select("ticker", "exchange", "payload")


_rss_id = f"substr(sha256('' || chr(10) || coalesce(canonical_rss, url, '') || chr(10) || title || chr(10) || {_iso} || chr(10)), 1, 24)"


_rss_reasons = f"concat_ws(',', {_base_reasons}, CASE WHEN source IS NULL THEN 'missing_source_name' END)"


@query("rss_feed", "S6", f"""
SELECT CASE WHEN {_rss_reasons} = '' THEN {_rss_id} END AS article_id, ticker, 'google_news_rss' AS provider, title AS article_title, coalesce(canonical_rss, url) AS article_url,
  CAST(NULL AS VARCHAR) AS canonical_url, coalesce('news.' || source || '.example.org', NULL) AS source_domain,
  source AS source_name, published_at_utc, published_at_utc + INTERVAL 330 MINUTE AS published_at_ist,
  CAST(published_at_utc + INTERVAL 330 MINUTE AS DATE) AS published_date_ist, CAST(NULL AS VARCHAR) AS summary_snippet,
  {_rss_reasons} AS reasons
FROM (SELECT * EXCLUDE (canonical_url), canonical_url AS canonical_rss FROM feed_rows)""")
def rss_feed(spark, sf):
    return _feed_out(news_feeds.rss_articles(
        news_feeds.rss_items(rss_pages(spark, sf).withColumnRenamed("payload", "feed")), I.MARKET))


def rss_pages(spark, sf):
    d = F.col("doc_id")

    def esc(c):
        out = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
        out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return out

    source = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(
        F.lit('<source url="https://news.'), F.col("source"), F.lit('.example.org">'), F.col("source"), F.lit("</source>")))
    rows = _feed_rows(spark, sf).withColumn("item", F.concat(
        F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><pubDate>"),
        F.when(d % 37 == 0, "soon").otherwise(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")),
        F.lit("</pubDate>"), F.when(F.col("url").isNull(), F.lit("")).otherwise(
            F.concat(F.lit("<link>"), esc(F.col("url")), F.lit("</link>"))), source, F.lit("</item>")))
    feeds = rows.groupBy("ticker", "exchange", F.floor(d / 75).alias("page")).agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("payload"))
    return feeds.select("ticker", "exchange", "payload")


@query("announcement_feed", "S7 X8", f"""
SELECT CASE WHEN doc_id % 13 <> 1 THEN coalesce(CASE WHEN title IS NOT NULL AND published_at_utc IS NOT NULL THEN att END, substr(sha256(chr(10) || chr(10) || title || chr(10) || {_iso} || chr(10)), 1, 24)) END AS article_id, ticker, 'nse_announcements' AS provider,
  title AS article_title, link AS article_url, link AS canonical_url, 'www.nseindia.com' AS source_domain, 'NSE Corporate Announcements' AS source_name,
  published_at_utc, published_at_utc + INTERVAL 330 MINUTE AS published_at_ist, CAST(published_at_utc + INTERVAL 330 MINUTE AS DATE) AS published_date_ist,
  snippet AS summary_snippet, concat_ws(',', CASE WHEN title IS NULL THEN 'missing_title' END, CASE WHEN published_at_utc IS NULL THEN 'invalid_published_at' END,
    CASE WHEN doc_id % 13 = 1 THEN 'disallowed_article_url_host' END) AS reasons
FROM (SELECT doc_id, ticker, title, snippet, CASE WHEN doc_id % 37 = 0 THEN NULL ELSE TIMESTAMP '2000-01-01' + to_seconds(doc_id * 61) - INTERVAL 330 MINUTE END AS published_at_utc,
  CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'http://localhost/x.pdf' ELSE '/corporate/n' || doc_id || '.pdf' END AS att,
  CASE doc_id % 13 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'https://www.nseindia.com/corporate/n' || doc_id || '.pdf' END AS link FROM feed_rows)""")
def announcement_feed(spark, sf):
    return _feed_out(news_feeds.announcements(news_feeds.announcement_rows(notice_pages(spark, sf)), I.MARKET))


def notice_pages(spark, sf):
    d = F.col("doc_id")
    att = F.when(d % 13 == 0, None).when(d % 13 == 1, "http://localhost/x.pdf").otherwise(
        F.concat(F.lit("/corporate/n"), d.cast("string"), F.lit(".pdf")))
    rows = _feed_rows(spark, sf).withColumn("n", F.struct(
        F.col("title").alias("subject"),
        F.when(d % 37 == 0, "soon").otherwise(F.date_format("at", "dd-MMM-yyyy HH:mm:ss")).alias("exchdisstime"),
        att.alias("attchmntFile"), F.lit("B").alias("bflag"), F.col("description").alias("desc")))
    page = F.floor(d / 75)
    listed = rows.groupBy("ticker", "exchange", page.alias("page")).agg(F.collect_list("n").alias("data"))
    # Every other page comes in an envelope.
    payload = F.when(F.col("page") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data")))
    return listed.select("ticker", "exchange", payload.alias("payload"))


@query("official_rss_feed", "S6 F8", """
SELECT ticker, provider, provider_source, count(*) AS n FROM (
  SELECT a.ticker, CASE WHEN doc_id % 2 = 0 THEN 'nse_rss' ELSE 'bse_rss' END AS provider,
    CASE WHEN doc_id % 2 = 0 THEN 'NSE Official RSS' ELSE 'BSE Official RSS' END AS provider_source
  FROM doc_norm a WHERE len(list_filter(terms, lambda t: contains(title_norm || ' ' || snippet_norm, t))) > 0) GROUP BY ALL""")
def official_rss_feed(spark, sf):
    rows = G.with_terms(D.articles(spark, sf), D.catalog(spark, sf))
    matched = rows.where(G.matches_scope(F.col("article_title"), F.col("summary_snippet"), F.col("terms")))
    both = news_feeds.official_rss(matched.where("doc_id % 2 = 0"), "nse_rss").unionByName(
        news_feeds.official_rss(matched.where("doc_id % 2 = 1"), "bse_rss"))
    return both.groupBy("ticker", "provider", "provider_source").agg(F.count(F.lit(1)).alias("n"))


@query("candle_feed", "S2", """
SELECT ticker, exchange, date, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, price DESC) AS rn FROM (
    SELECT ticker, exchange, strftime(date, '%Y-%m-%d') || 'T00:00:00+05:30' AS date, price AS open, price + 1 AS high, price - 1 AS low,
           price AS close, quantity AS volume, l_orderkey, l_linenumber, l_partkey, price FROM trades WHERE l_orderkey % 5 <> 0)) WHERE rn = 1""")
def candle_feed(spark, sf):
    """One payload per order and instrument; every fifth order answered with an error."""
    t = I.priced_lines(spark, sf)
    p = F.col("price")
    candle = F.array(
        F.concat(F.col("date").cast("string"), F.lit("T00:00:00+05:30")), p.cast("string"), (p + 1).cast("string"),
        (p - 1).cast("string"), p.cast("string"), F.col("quantity").cast("string"), F.lit("0"))
    pages = t.groupBy("ticker", "exchange", "l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "price", candle.alias("c")))).alias("rows"))
    payload = F.to_json(F.struct(
        F.when(F.col("l_orderkey") % 5 == 0, "error").otherwise("success").alias("status"),
        F.struct(F.transform("rows", lambda x: x["c"]).alias("candles")).alias("data")))
    return candles.candle_rows(pages.select(
        "ticker", "exchange", F.col("l_orderkey").alias("payload_order"), payload.alias("payload"))).drop("adj_close")


@query("catalog_overlay", "S12", """
SELECT symbol, exchange, company_name, array_to_string(search_aliases, ',') AS search_aliases FROM catalog
  WHERE CAST(substr(symbol, 2) AS INTEGER) NOT IN (SELECT DISTINCT s_nationkey FROM supplier)
UNION ALL
SELECT 'N' || s_nationkey AS symbol, 'NSE' AS exchange, arg_max(s_name, s_suppkey) AS company_name, '' AS search_aliases FROM supplier GROUP BY s_nationkey""")
def catalog_overlay(spark, sf):
    local = I.table(spark, sf, "supplier").select(
        F.concat(F.lit(" n"), F.col("s_nationkey").cast("string")).alias("symbol"), F.lit("nse").alias("exchange"),
        F.col("s_name").alias("company_name"), F.array().cast("array<string>").alias("search_aliases"),
        F.col("s_suppkey").alias("position"))
    return overlay_catalog(D.catalog(spark, sf), local).withColumn(
        "search_aliases", F.array_join("search_aliases", ","))


def _feed_counts(name: str, provider: str, where: str = "true") -> str:
    return f"""
SELECT '{provider}' AS provider, 'ok' AS status, count(*) FILTER (reasons = '') AS article_count, count(*) FILTER (reasons <> '') AS refused_count,
  coalesce(min(article_id) FILTER (reasons = ''), '') AS first_id, coalesce(max(article_id) FILTER (reasons = ''), '') AS last_id FROM ({name}) WHERE {where}"""


_rss_rows = ENTRIES["rss_feed"].sql
_scoped = f"""SELECT r.* FROM ({_rss_rows}) r JOIN instrument_terms t USING (ticker)
WHERE len(list_filter(t.terms, lambda x: contains({D.match('r.article_title')} || ' ', x))) > 0"""


@query("source_union", "U1 S4 S5 S6 S7", " UNION ALL ".join([
    _feed_counts(ENTRIES["company_news_feed"].sql, "marketaux"), _feed_counts(ENTRIES["ticker_sentiment_feed"].sql, "alphavantage"),
    _feed_counts(_rss_rows, "google_news_rss"), _feed_counts(_rss_rows, "economic_times"),
    _feed_counts(ENTRIES["announcement_feed"].sql, "nse_announcements"),
    _feed_counts(_scoped, "nse_rss"), _feed_counts(_scoped, "bse_rss")]))
def source_union(spark, sf):
    """Seven feeds land as files, are parsed and staged one by one, and read back as one table."""
    from uuid import uuid4

    from tidemark.sources.landed import Feed, land, parsers, union_feeds

    folder = tables.shared_folder(spark)
    landed = f"{folder}/landed-{uuid4().hex[:12]}"
    pages = {"marketaux": company_pages, "alphavantage": ticker_pages, "nse_announcements": notice_pages}
    found = []
    for provider, (parse, whole) in parsers(D.catalog(spark, sf), I.MARKET).items():
        land(pages.get(provider, rss_pages)(spark, sf), f"{landed}/{provider}")
        found.append(Feed(provider, f"{landed}/{provider}", parse, whole))
    union, status = union_feeds(spark, found, folder)
    good = union.where(F.size("reasons") == 0).groupBy("provider").agg(
        F.min("article_id").alias("first_id"), F.max("article_id").alias("last_id"))
    return status.join(good, "provider", "left").select(
        "provider", "status", "article_count", "refused_count", F.coalesce("first_id", F.lit("")).alias("first_id"),
        F.coalesce("last_id", F.lit("")).alias("last_id"))
