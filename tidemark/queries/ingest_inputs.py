"""Articles, feeds and catalogs derived from documents, pages, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.queries import inputs as I
from tidemark.queries.oracle import cte, in_list
from tidemark.settings import IngestSettings

PROVIDERS = IngestSettings().provider_priority
MODES = ("corp_announcements", "ticker_sentiment", "entity_symbols", "search_fallback", "rss_search")
ALIASES = ("the", "thand", "le", "oureaux", "und", "sch", "de la", "el", "cióna", "on")
ACQUIRED = ("full_article", "headline_plus_snippet", "headline_only")


def catalog(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return I.table(spark, sf, "nation").select(
        F.concat(F.lit("N"), k.cast("string")).alias("symbol"), F.lit("NSE").alias("exchange"),
        F.col("n_name").alias("company_name"),
        F.array(I.pick(ALIASES, k % 10), I.pick(ALIASES, (k + 3) % 10)).alias("search_aliases"))


def articles(spark, sf) -> DataFrame:
    """Documents as normalized articles; exact copies share a canonical URL."""
    d = F.col("doc_id")
    docs = I.table(spark, sf, "documents")
    title = F.substring_index("text", "\n", 1)
    ticker = F.concat(F.lit("N"), (d % 25).cast("string"))
    snippet = F.substring("text", F.length(title) + 2, F.length("text"))
    published = F.timestamp_seconds(F.lit(946684800) + (d % 500) * 3600)
    payload = (
        F.when(d % 4 == 0, F.concat(F.lit('[{"symbol":"'), ticker, F.lit('","name":"x"}]')))
        .when(d % 4 == 1, F.lit('{"ticker_sentiment":["a"]}'))
        .when(d % 4 == 2, F.concat(F.lit('[{"symbol":"ZZZ","name":"NATION_'), (d % 25).cast("string"), F.lit('"}]'))))
    return docs.select(
        F.concat(F.lit("a"), d.cast("string")).alias("article_id"), ticker.alias("ticker"), F.lit("NSE").alias("exchange"),
        I.pick(PROVIDERS, d % 7).alias("provider"), I.pick(MODES, d % 5).alias("discovery_mode"),
        F.when(d % 2 == 0, F.concat(F.lit("u"), d.cast("string"))).alias("provider_uuid"),
        title.alias("article_title"), F.nullif(snippet, F.lit("")).alias("summary_snippet"),
        F.when(d % 3 != 0, F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.md5("text"))).alias("canonical_url"),
        F.when(d % 29 != 0, F.concat(F.col("source"), F.lit(".example.com"))).alias("source_domain"),
        F.col("source").alias("source_name"), published.alias("published_at_utc"),
        F.to_date(published).alias("published_date_ist"), payload.alias("provider_entity_payload"),
        I.pick(ACQUIRED, d % 3).alias("text_acquisition_mode"),
        F.when(d % 3 == 0, "direct_publisher_text").when(d % 3 == 1, "aggregator_text").otherwise("snippet_only").alias("content_origin"),
        F.col("text").alias("page_text"), d.alias("doc_id"),
    )


cte("catalog", f"""
SELECT 'N' || n_nationkey AS symbol, 'NSE' AS exchange, n_name AS company_name,
       [([{in_list(ALIASES)}])[1 + n_nationkey % 10], ([{in_list(ALIASES)}])[1 + (n_nationkey + 3) % 10]] AS search_aliases FROM nation""")
cte("instrument_terms", """
SELECT symbol AS ticker, lower(company_name) AS company_norm, list_distinct([lower(symbol), lower(company_name)] || search_aliases) AS terms FROM catalog""")
cte("doc_base", """
SELECT *, split_part(text, chr(10), 1) AS title, 'N' || (doc_id % 25) AS ticker FROM documents""")
cte("doc_articles", f"""
SELECT 'a' || doc_id AS article_id, ticker, 'NSE' AS exchange, ([{in_list(PROVIDERS)}])[1 + doc_id % 7] AS provider,
       ([{in_list(MODES)}])[1 + doc_id % 5] AS discovery_mode, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS provider_uuid,
       title AS article_title, nullif(substr(text, length(title) + 2), '') AS summary_snippet,
       CASE WHEN doc_id % 3 <> 0 THEN 'https://' || source || '.example.com/' || md5(text) END AS canonical_url,
       CASE WHEN doc_id % 29 <> 0 THEN source || '.example.com' END AS source_domain, source AS source_name,
       TIMESTAMP '2000-01-01' + to_hours(CAST(doc_id % 500 AS INTEGER)) AS published_at_utc,
       ([{in_list(ACQUIRED)}])[1 + doc_id % 3] AS text_acquisition_mode, text AS page_text, doc_id
FROM doc_base""")
_blank = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def clean(c: str) -> str:
    return f"nullif(trim({c}, {_blank}), '')"


def match(c: str) -> str:
    return f"coalesce(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'), {_blank})), '')"


cte("doc_norm", f"""
SELECT a.*, {match('article_title')} AS title_norm, {match('summary_snippet')} AS snippet_norm, t.terms, t.company_norm
FROM doc_articles a JOIN instrument_terms t USING (ticker)""")
_hits = "len(list_filter(terms, lambda t: regexp_matches({0}, '(^|[^a-z0-9])' || regexp_escape(t) || '($|[^a-z0-9])')))"
cte("doc_scored", f"""
SELECT *, CAST(least({_hits.format('title_norm')}, 3) * 4 + least({_hits.format('snippet_norm')}, 2) * 2
       + CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END
       + CASE discovery_mode WHEN 'corp_announcements' THEN 4 WHEN 'ticker_sentiment' THEN 3 WHEN 'entity_symbols' THEN 2 WHEN 'search_fallback' THEN 1 ELSE 0 END AS INTEGER) AS specificity
FROM doc_norm""")
cte("doc_deduped", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, dedupe_key ORDER BY length(coalesce(summary_snippet, '')) DESC, published_at_utc DESC,
           provider_uuid ASC NULLS LAST, article_id) AS rn, count(*) OVER (PARTITION BY ticker, dedupe_key) AS copies
  FROM (SELECT *, CASE WHEN canonical_url IS NOT NULL THEN 'u' || canonical_url
                       WHEN source_domain IS NOT NULL AND title_norm <> '' THEN 't' || source_domain || chr(31) || title_norm || chr(31) || strftime(published_at_utc, '%Y-%m-%d')
                       ELSE 'r' || article_id END AS dedupe_key FROM doc_scored)) WHERE rn = 1""")
