"""Scoring stage: prepared inputs, responses, cache, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import scoring as C
from tidemark.queries import ingest_inputs as D
from tidemark.queries import inputs as I
from tidemark.queries.inputs import r
from tidemark.queries.oracle import cte, in_list, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, IngestSettings

S = IngestSettings()


def articles(spark, sf):
    """Documents as processed articles, full text where the acquisition mode says so."""
    d = F.col("doc_id")
    rows = D.articles(spark, sf)
    return rows.withColumns({
        "full_text": F.when(F.col("text_acquisition_mode") == "full_article", F.concat(F.lit("<article_text>"), F.col("page_text"))),
        "article_url": F.lit(None).cast("string"), "provider_source": F.col("source_name"),
        "text_acquisition_reason": F.lit("article_tag"), "fetch_warning_flag": (d % 8 == 0).cast("string"),
        "company_name": F.concat(F.lit("NATION_"), (d % 25).cast("string")),
    })


_SAFE = "trim(regexp_replace(regexp_replace({0}, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g'))"


def safe(c: str) -> str:
    return _SAFE.format(f"coalesce(CAST({c} AS VARCHAR), '')")


cte("prep0", f"""
SELECT *, {safe('article_title')} AS t, {safe('summary_snippet')} AS s, text_acquisition_mode AS extraction_mode,
  CASE WHEN text_acquisition_mode = 'full_article' THEN replace({safe("'<article_text>' || page_text")}, '<article_text>', '[article_text]') ELSE '' END AS body FROM doc_articles""")
cte("prep1", f"""
SELECT *, CASE WHEN body <> '' THEN body WHEN t <> '' AND s <> '' THEN t || ' ' || s WHEN t <> '' THEN t ELSE s END AS raw_text,
  CAST(CASE extraction_mode WHEN 'full_article' THEN 1.0 WHEN 'headline_plus_snippet' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS content_quality_score FROM prep0""")
cte("prepared", f"""
SELECT *, length(raw_text) > {S.max_input_chars} AS prompt_truncated, doc_id % 8 = 0 OR length(raw_text) > {S.max_input_chars} AS warning_flag, substr(raw_text, 1, {S.max_input_chars}) AS prompt_article_text
FROM prep1 WHERE raw_text <> ''""")
_hash = " || chr(10) || ".join([
    "'article_id=' || article_id", "'article_title=' || t", "'article_url='", "'canonical_url=' || coalesce(canonical_url, '')",
    "'company_name=NATION_' || (doc_id % 25)", "'content_quality_score=' || CASE extraction_mode WHEN 'full_article' THEN '1.0' WHEN 'headline_plus_snippet' THEN '0.75' ELSE '0.5' END",
    "'exchange=' || exchange", "'extraction_mode=' || extraction_mode", "'prompt_article_text=' || prompt_article_text", "'provider=' || provider",
    "'provider_source=' || source_name", "'published_at_utc=' || strftime(published_at_utc, '%Y-%m-%dT%H:%M:%S') || '.000000'",
    "'source_domain=' || coalesce(source_domain, '')", "'summary_snippet=' || s", "'text_acquisition_reason=article_tag'", "'ticker=' || ticker",
    "'warning_flag=' || CASE WHEN warning_flag THEN 'true' ELSE 'false' END"])


@query("scoring_inputs", "X11", f"""
SELECT article_id, extraction_mode, content_quality_score, prompt_truncated, warning_flag, CAST(length(prompt_article_text) AS INTEGER) AS n_chars,
       sha256({_hash}) AS article_input_hash FROM prepared""")
def scoring_inputs(spark, sf):
    return C.prepare_inputs(articles(spark, sf), S).select(
        "article_id", "extraction_mode", "content_quality_score", "prompt_truncated", "warning_flag",
        F.length("prompt_article_text").alias("n_chars"), "article_input_hash")


@query("article_contract", "F7", """
SELECT 'empty_article_id' AS rule, count(*) FILTER (doc_id % 17 = 0) AS violations FROM documents
UNION ALL SELECT 'duplicate_article_id', count(*) - count(DISTINCT CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'same' ELSE CAST(doc_id AS VARCHAR) END) FROM documents
UNION ALL SELECT 'missing_identity', count(*) FILTER (doc_id % 23 = 0) FROM documents
UNION ALL SELECT 'unsupported_mode', count(*) FILTER (doc_id % 29 = 0) FROM documents""")
def article_contract(spark, sf):
    d = F.col("doc_id")
    rows = articles(spark, sf).withColumns({
        "article_id": F.when(d % 17 == 0, " ").when(d % 19 == 0, "same").otherwise(F.col("article_id")),
        "ticker": F.when(d % 23 != 0, F.col("ticker")),
        "text_acquisition_mode": F.when(d % 29 == 0, "video").otherwise(F.col("text_acquisition_mode"))})
    return C.article_contract(rows)


@query("weak_articles", "F11", """
SELECT article_id, extraction_mode <> 'full_article' OR warning_flag AS is_weak,
  CASE WHEN extraction_mode = 'headline_only' THEN 'headline_only_source_text' WHEN extraction_mode = 'headline_plus_snippet' THEN 'headline_plus_snippet_source_text'
       WHEN warning_flag THEN 'source_warning_flag' END AS recovery_reason FROM prepared""")
def weak_articles(spark, sf):
    mode, warn = F.col("extraction_mode"), F.col("warning_flag")
    return C.prepare_inputs(articles(spark, sf), S).select(
        "article_id", C.is_weak(mode, warn).alias("is_weak"), C.recovery_reason(mode, warn).alias("recovery_reason"))


@query("first_json_object", "X12")
def first_json_object(spark, sf):
    """Chat turns around JSON of the events: prose, braces that are no JSON, then an object."""
    chat = I.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.col("text"), F.when(
            F.col("turn") % 2 == 1, F.concat(F.lit(' {oops} {"conv": '), F.col("conv_id").cast("string"), F.lit(', "ok": true} tail'))
        ).otherwise("")).alias("response_text"))
    events = I.table(spark, sf, "events").select(
        F.col("event_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
        F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")).alias("response_text"))
    return C.with_first_json(chat.unionByName(events)).select("conv_id", "turn", "payload")


def _responses(spark, sf):
    """Scored articles as model responses, with damage on fixed key residues."""
    k = F.col("k")
    rows = I.extractions(spark, sf).withColumn("company_name", F.concat(F.lit("Co "), F.col("ticker")))
    payload = F.to_json(F.struct(
        F.when(k % 19 == 0, "ZZZ").otherwise(F.lower("ticker")).alias("ticker"), F.upper("company_name").alias("company_name"),
        F.col("relevance_score").alias("relevance_score"), F.when(k % 23 == 0, "mixed").otherwise(F.col("sentiment_label")).alias("sentiment_label"),
        F.when(k % 29 == 0, 3.5).otherwise(F.col("sentiment_score")).alias("sentiment_score"),
        F.initcap(F.col("event_type")).alias("event_type"), F.col("event_severity").alias("event_severity"),
        F.lit("Short Term").alias("expected_horizon"), F.col("directional_bias").alias("directional_bias"),
        F.when(k % 31 == 0, "high").otherwise(F.col("confidence_score").cast("string")).alias("confidence_score"),
        F.when(k % 37 == 0, " ").otherwise("because").alias("rationale_short"), F.col("extraction_mode").alias("extraction_mode"),
        F.when(k % 41 == 0, 0.9).otherwise(F.col("content_quality_score")).alias("content_quality_score"),
        F.when(k % 43 == 0, "perhaps").otherwise(F.col("warning_flag").cast("string")).alias("warning_flag")))
    payload = F.when(k % 47 == 0, '{"ticker": "A", "event_type": "other"}').when(k % 53 == 0, None).otherwise(payload)
    kept = rows.select("article_id", "ticker", "exchange", "company_name", "extraction_mode", "content_quality_score", "warning_flag", "k")
    return rows.select("article_id", payload.alias("payload")).join(kept, "article_id")


_fields = sorted(set(C.RESPONSE_FIELDS) - {"ticker", "event_type"})
cte("response_errors", f"""
SELECT *, CASE WHEN k % 53 = 0 AND k % 47 <> 0 THEN 'no_json_object' WHEN k % 47 = 0 THEN 'missing_fields:{','.join(_fields)}'
  ELSE concat_ws(',', CASE WHEN k % 19 = 0 THEN 'ticker_mismatch' END, CASE WHEN k % 41 = 0 THEN 'content_quality_score_mismatch' END,
    CASE WHEN k % 43 = 0 THEN 'warning_flag_not_boolean' END, CASE WHEN k % 43 = 0 THEN 'warning_flag_mismatch' END,
    CASE WHEN k % 23 = 0 THEN 'unsupported_sentiment_label' END, CASE WHEN k % 29 = 0 THEN 'sentiment_score_out_of_range' END,
    CASE WHEN k % 31 = 0 THEN 'confidence_score_not_numeric' END, CASE WHEN k % 37 = 0 THEN 'empty_rationale_short' END) END AS errors FROM extractions""")


@query("response_validation", "X13", """
SELECT article_id, errors, CASE WHEN errors = '' THEN event_type END AS event_type, CASE WHEN errors = '' THEN sentiment_score END AS sentiment_score,
       CASE WHEN errors = '' THEN 'short_term' END AS expected_horizon, CASE WHEN errors = '' THEN confidence_score END AS confidence_score FROM response_errors""")
def response_validation(spark, sf):
    return C.validate_responses(_responses(spark, sf)).select(
        "article_id", F.concat_ws(",", "errors").alias("errors"), "event_type", "sentiment_score", "expected_horizon", "confidence_score")


def _cache(spark, sf):
    """Inputs keyed by a hash of few values, and a cache that repeats and omits keys."""
    rows = I.extractions(spark, sf)
    k = F.col("k")
    inputs = rows.select(
        "article_id", F.sha2((k % 400).cast("string"), 256).alias("article_input_hash"), F.lit("plain_text").alias("request_mode"),
        F.lit("gemini").alias("llm_provider"), F.when(k % 2 == 0, "m1").otherwise("m2").alias("llm_model"),
        F.lit("stage6_v1").alias("prompt_version"), F.lit("1").alias("schema_version"))
    cache = rows.where(k % 3 == 0).select(
        F.sha2((k % 400).cast("string"), 256).alias("article_input_hash"), F.when(k % 5 == 0, "").otherwise("plain_text").alias("request_mode"),
        F.when(k % 11 == 0, "").otherwise("gemini").alias("llm_provider"), F.lit("m1").alias("llm_model"),
        F.lit("stage6_v1").alias("prompt_version"), F.lit("1").alias("schema_version"), k.alias("cached_order"), "sentiment_score")
    return inputs, cache


cte("score_cache", """
SELECT k % 400 AS h, arg_max(sentiment_score, k) AS cached_score FROM extractions WHERE k % 3 = 0 AND k % 11 <> 0 GROUP BY 1""")


@query("score_cache_hits", "J8", """
SELECT e.article_id, c.cached_score FROM extractions e JOIN score_cache c ON c.h = e.k % 400 WHERE e.k % 2 = 0""")
def score_cache_hits(spark, sf):
    inputs, cache = _cache(spark, sf)
    hits, _ = C.reuse_scores(inputs, cache, "cached_order", ["sentiment_score"])
    return hits.select("article_id", F.col("sentiment_score").alias("cached_score"))


@query("score_cache_misses", "J8", """
SELECT article_id FROM extractions e WHERE e.k % 2 <> 0 OR NOT EXISTS (SELECT 1 FROM score_cache c WHERE c.h = e.k % 400)""")
def score_cache_misses(spark, sf):
    inputs, cache = _cache(spark, sf)
    _, misses = C.reuse_scores(inputs, cache, "cached_order", ["sentiment_score"])
    return misses.select("article_id")


cte("rec0", """
SELECT *, extraction_mode <> 'full_article' OR warning_flag AS weak, k % 3 <> 0 AND (extraction_mode <> 'full_article' OR warning_flag) AS can FROM extractions""")
cte("rec1", """
SELECT *, count(*) FILTER (can) OVER (PARTITION BY ticker ORDER BY published_at_utc, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  count(*) FILTER (can) OVER (PARTITION BY ticker ORDER BY published_at_utc, article_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rec0""")
cte("recovery", """
SELECT *, CASE WHEN NOT weak THEN 'not_needed' WHEN before >= 20 THEN 'exhausted' WHEN NOT can THEN 'skipped' WHEN upto > 18 THEN 'skipped' ELSE 'attempt' END AS recovery_status FROM rec1""")


@query("recovery_plan", "K5 F11", """
SELECT article_id, recovery_status, CASE WHEN recovery_status = 'attempt' THEN CASE WHEN upto <= 12 THEN 'm1' ELSE 'm2' END END AS recovery_model FROM recovery""")
def recovery_plan(spark, sf):
    rows = I.extractions(spark, sf).withColumns({
        "canonical_url": F.when(F.col("k") % 3 == 1, F.concat(F.lit("https://x.example.com/"), F.col("article_id"))),
        "article_url": F.when(F.col("k") % 3 == 2, F.concat(F.lit("http://x.example.com/"), F.col("article_id"))).otherwise("ftp://x")})
    rows = rows.withColumn("article_url", F.when(F.col("k") % 3 == 0, "ftp://x").otherwise(F.col("article_url")))
    return C.recovery_plan(rows, ["published_at_utc", "article_id"], IngestSettings().recovery_budget, (("m1", 12), ("m2", 6))).select(
        "article_id", "recovery_status", "recovery_model")


@query("extraction_summary", "A12", f"""
WITH s AS (SELECT e.ticker, e.exchange, count(*) AS source_row_count, count(*) FILTER (errors = '') AS success_count, count(*) FILTER (errors <> '') AS failure_count,
  count(*) FILTER (errors = '' AND e.extraction_mode <> 'full_article') AS fb, count(*) FILTER (errors = '' AND e.extraction_mode = 'full_article') AS full_article_count,
  count(*) FILTER (errors = '' AND e.extraction_mode = 'headline_only') AS headline_only_count,
  count(*) FILTER (errors = '' AND recovery_status = 'exhausted') AS exhausted_count, count(*) FILTER (errors = '' AND recovery_status = 'skipped') AS skipped_count,
  min(CAST(e.published_at_utc AS DATE)) FILTER (errors = '') AS coverage_start, max(CAST(e.published_at_utc AS DATE)) FILTER (errors = '') AS coverage_end
  FROM response_errors e JOIN recovery USING (article_id) GROUP BY e.ticker, e.exchange)
SELECT ticker, exchange, source_row_count, success_count, failure_count, {rnd('success_count / source_row_count')} AS success_rate, {rnd('fb / success_count')} AS fallback_usage_rate,
  full_article_count, headline_only_count, exhausted_count, skipped_count, coverage_start, coverage_end,
  concat_ws(',', CASE WHEN success_count = 0 THEN 'no_successful_extractions' END, CASE WHEN failure_count > 0 THEN 'extraction_failures_present' END,
    CASE WHEN exhausted_count > 0 THEN 'recovery_exhausted_present' END, CASE WHEN skipped_count > 0 THEN 'recovery_skipped_present' END) AS warnings FROM s""")
def extraction_summary(spark, sf):
    judged = C.validate_responses(_responses(spark, sf)).select("article_id", (F.size("errors") == 0).alias("success"))
    rows = I.extractions(spark, sf).withColumns({
        "canonical_url": F.when(F.col("k") % 3 != 0, "https://x.example.com/"), "article_url": F.lit("ftp://x")})
    plan = C.recovery_plan(rows, ["published_at_utc", "article_id"], 20, (("m1", 12), ("m2", 6)))
    out = C.extraction_summary(plan.join(judged, "article_id"))
    return out.select(
        *KEYS, "source_row_count", "success_count", "failure_count", r("success_rate").alias("success_rate"),
        r("fallback_usage_rate").alias("fallback_usage_rate"), "full_article_count", "headline_only_count", "exhausted_count",
        "skipped_count", "coverage_start", "coverage_end", F.concat_ws(",", "warnings").alias("warnings"))
