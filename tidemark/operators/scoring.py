"""Scoring stage: prepared inputs, response validation, cache reuse, recovery budget."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.scalars import bound, enum_text, literal_map, safe_text, to_bool
from tidemark.settings import KEYS, IngestSettings

# Fields a scored response must have.
RESPONSE_FIELDS = (
    "ticker", "company_name", "relevance_score", "sentiment_label", "sentiment_score", "event_type",
    "event_severity", "expected_horizon", "directional_bias", "confidence_score", "rationale_short",
    "extraction_mode", "content_quality_score", "warning_flag",
)
# Parts of the cache key.
CACHE_KEY = ("article_input_hash", "request_mode", "llm_provider", "llm_model", "prompt_version", "schema_version")
# Text markers that must not survive inside an article, and their replacements.
MARKERS = {"<article_text>": "[article_text]", "</article_text>": "[/article_text]"}
DEFAULT_REQUEST_MODE = "plain_text"


def article_contract(articles: DataFrame) -> DataFrame:
    """Violation counts of a processed-article table, one (rule, violations) row per rule."""
    norm = articles.select(safe_text(F.col("article_id")).alias("article_id"), *[
        F.col(c).isNull().alias(f"_{c}") for c in KEYS], enum_text(F.col("text_acquisition_mode")).alias("mode"))
    per_id = norm.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_ticker") | F.col("_exchange")).alias("missing_identity"),
        F.count_if(~F.col("mode").isin(*V.EXTRACTION_MODES)).alias("unsupported_mode"))
    total = per_id.agg(
        F.coalesce(F.sum(F.when(F.col("article_id") == "", F.col("_n"))), F.lit(0)).alias("empty_article_id"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_article_id"),
        F.coalesce(F.sum("missing_identity"), F.lit(0)).alias("missing_identity"),
        F.coalesce(F.sum("unsupported_mode"), F.lit(0)).alias("unsupported_mode"))
    names = total.columns
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return total.selectExpr(f"stack({len(names)}, {pairs}) as (rule, violations)")


def bounded_text(raw: Column) -> Column:
    out = safe_text(raw)
    for marker, neutral in MARKERS.items():
        out = F.replace(out, F.lit(marker), F.lit(neutral))
    return out


def prepare_inputs(articles: DataFrame, s: IngestSettings = IngestSettings()) -> DataFrame:
    """Bounded article text, truncation and warning flags, quality score and a stable input hash.

    Needs `company_name` on the row. The whole text is read; only the scoring input is
    bounded, and rows over the bound are flagged. Rows without usable text are dropped.
    """
    title, snippet = safe_text(F.col("article_title")), safe_text(F.col("summary_snippet"))
    fallback = F.when((title != "") & (snippet != ""), F.concat(title, F.lit("\n\n"), snippet)).otherwise(
        F.when(title != "", title).otherwise(snippet))
    body = bounded_text(F.col("full_text"))
    text = F.when(body != "", body).otherwise(bounded_text(fallback))
    mode = enum_text(F.col("text_acquisition_mode"))
    out = articles.withColumns({
        "extraction_mode": mode,
        "_text": text,
        "content_quality_score": literal_map(V.CONTENT_QUALITY, mode).cast("double"),
        "_source_warning": F.coalesce(to_bool(F.col("fetch_warning_flag")), F.lit(False)),
    }).where((F.col("_text") != "") & F.col("content_quality_score").isNotNull())
    out = out.withColumns({
        "prompt_truncated": F.length("_text") > s.max_input_chars,
        "prompt_article_text": F.substring(F.col("_text"), F.lit(1), F.lit(s.max_input_chars)),
    })
    out = out.withColumns({
        "warning_flag": F.col("_source_warning") | F.col("prompt_truncated"),
        "source_fetch_warning_flag": F.col("_source_warning"),
    })
    return out.withColumn("article_input_hash", input_hash()).drop("_text", "_source_warning")


# Fields that identify a scoring input, in key order.
HASHED_FIELDS = (
    "article_id", "article_title", "article_url", "canonical_url", "company_name", "content_quality_score",
    "exchange", "extraction_mode", "prompt_article_text", "provider", "provider_source", "published_at_utc",
    "source_domain", "summary_snippet", "text_acquisition_reason", "ticker", "warning_flag",
)


def input_hash() -> Column:
    """SHA-256 over `name=value` lines; any change of a field changes it."""
    def shown(name: str) -> Column:
        c = F.col(name)
        if name == "published_at_utc":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if name == "prompt_article_text":
            return F.concat(F.lit(f"{name}="), c)
        return F.concat(F.lit(f"{name}="), safe_text(c))
    return F.sha2(F.concat_ws("\n", *[shown(n) for n in HASHED_FIELDS]), 256)


def first_json_object(text: str | None) -> str | None:
    """First complete JSON object inside free text, as compact JSON."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for start in re.finditer(r"\{", text):
        try:
            value, _ = decoder.raw_decode(text, start.start())
        except json.JSONDecodeError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
    return None


def with_first_json(responses: DataFrame, text: str = "response_text", name: str = "payload") -> DataFrame:
    """Add the first JSON object of each response; Arrow batches, no shuffle."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(first_json_object)

    # Text without a brace never reaches Python.
    return responses.withColumn(name, F.when(F.contains(text, F.lit("{")), extract(F.col(text))))


def _range_errors(value: Column, name: str, low: float, high: float) -> list[Column]:
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return [
        F.when(value.isNull(), f"{name}_not_numeric"),
        F.when(~finite, f"{name}_not_finite"),
        F.when(finite & ~value.between(low, high), f"{name}_out_of_range"),
    ]


def validate_responses(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Check each response against its prepared article and attach the ordered error codes.

    `rows` holds the prepared article and the JSON object of its response. The result has
    the response fields normalized, plus `errors`; rows with no errors are successes. Every
    field is normalized once, and then compared.
    """
    enums = {"sentiment_label": V.SENTIMENT_LABELS, "directional_bias": V.BIASES,
             "expected_horizon": V.HORIZONS, "event_type": V.EVENT_TYPES}
    numbers = ("relevance_score", "sentiment_score", "event_severity", "confidence_score")

    def normalized(p: Column) -> Column:
        def got(name: str) -> Column:
            return F.element_at(p, F.lit(name))

        missing = F.array_sort(F.filter(
            F.array(*[F.lit(f) for f in RESPONSE_FIELDS]), lambda f: ~F.map_contains_key(p, f)))
        return F.struct(
            p.isNull().alias("absent"), F.when(p.isNotNull(), missing).alias("missing"),
            F.upper(safe_text(got("ticker"))).alias("ticker"), F.lower(safe_text(got("company_name"))).alias("company_name"),
            enum_text(got("extraction_mode")).alias("extraction_mode"), to_bool(got("warning_flag")).alias("warning_flag"),
            safe_text(got("rationale_short")).alias("rationale_short"),
            *[enum_text(got(name)).alias(name) for name in enums],
            *[got(name).try_cast("double").alias(name) for name in ("content_quality_score", *numbers)])

    def listed(v: Column) -> Column:
        quality, flag = v["content_quality_score"], v["warning_flag"]
        errors = [
            F.when(v["ticker"] != F.upper(safe_text(F.col("ticker"))), "ticker_mismatch"),
            F.when(v["company_name"] != F.lower(safe_text(F.col("company_name"))), "company_name_mismatch"),
            F.when(v["extraction_mode"] != F.col("extraction_mode"), "extraction_mode_mismatch"),
            *_range_errors(quality, "content_quality_score", 0.0, 1.0),
            F.when(quality.between(0.0, 1.0) & (F.abs(quality - F.col("content_quality_score")) > 1e-9),
                   "content_quality_score_mismatch"),
            F.when(flag.isNull(), "warning_flag_not_boolean"),
            F.when(flag.isNull() | (flag != F.col("warning_flag")), "warning_flag_mismatch"),
            *[F.when(~v[name].isin(*allowed), f"unsupported_{name}") for name, allowed in enums.items()],
            *[e for name in numbers for e in _range_errors(v[name], name, *V.SCORE_RANGES[name])],
            F.when(v["rationale_short"] == "", "empty_rationale_short")]
        return (
            F.when(v["absent"], F.array(F.lit("no_json_object")))
            .when(F.size(v["missing"]) > 0, F.array(F.concat(F.lit("missing_fields:"), F.array_join(v["missing"], ","))))
            .otherwise(F.array_compact(F.array(*errors))))

    read = rows.withColumn("_v", bound(F.from_json(payload, "map<string,string>"), normalized))
    judged = read.withColumn("errors", bound(F.col("_v"), listed))
    fine = F.size("errors") == 0
    return judged.withColumns({
        name: F.when(fine, F.col(f"_v.{name}")) for name in (*enums, *numbers, "rationale_short")}).drop("_v")


def cache_columns(rows: DataFrame) -> DataFrame:
    """Normalize the key parts; a blank request mode is the default one."""
    out = rows.withColumns({c: safe_text(F.col(c)) for c in CACHE_KEY if c in rows.columns})
    return out.withColumn("request_mode", F.when(F.col("request_mode") == "", DEFAULT_REQUEST_MODE).otherwise(F.col("request_mode")))


def reuse_scores(inputs: DataFrame, cache: DataFrame, order: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inputs with their cached scores, inputs that must be scored).

    The cache is reduced to the last row per full key; incomplete keys are ignored.
    """
    keyed = cache_columns(inputs)
    complete = F.lit(True)
    for c in CACHE_KEY:
        complete = complete & (F.col(c) != "")
    last = cache_columns(cache).where(complete).groupBy(*CACHE_KEY).agg(
        F.max_by(F.struct(*values), F.col(order)).alias("_v")).select(*CACHE_KEY, "_v.*")
    hits = keyed.join(last, list(CACHE_KEY))
    misses = keyed.join(last.select(*CACHE_KEY), list(CACHE_KEY), "left_anti")
    return hits, misses


def is_weak(mode: Column, warning: Column) -> Column:
    return (mode != "full_article") | warning


def recovery_reason(mode: Column, warning: Column) -> Column:
    return (
        F.when(mode == "headline_only", "headline_only_source_text")
        .when(mode == "headline_plus_snippet", "headline_plus_snippet_source_text")
        .when(warning, "source_warning_flag"))


def recovery_plan(articles: DataFrame, order: list[str], budget: int, model_limits: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Which weak articles get a recovery attempt, per instrument and in source order.

    The first `budget` weak articles with a usable URL are attempted. Weak articles
    without one are skipped while budget is left, and every later one is exhausted. With
    `model_limits`, attempts fill the models in order. Only the first `budget` articles
    per instrument are ranked, so a hot instrument is cut down before the shuffle; all
    other rows compare themselves with the last attempt.
    """
    weak = is_weak(F.col("extraction_mode"), F.col("warning_flag"))
    url = F.coalesce("canonical_url", "article_url").rlike("^https?://")
    marked = articles.withColumns({
        "recovery_reason": F.when(weak, recovery_reason(F.col("extraction_mode"), F.col("warning_flag"))),
        "_weak": weak, "_can": weak & F.coalesce(url, F.lit(False)), "_at": F.struct(*order)})
    if budget <= 0:
        return marked.withColumns({
            "recovery_status": F.when(F.col("_weak"), "skipped").otherwise("not_needed"),
            "recovery_model": F.lit(None).cast("string")}).drop("_weak", "_can", "_at")
    w = Window.partitionBy(*KEYS).orderBy(*order)
    first = marked.where("_can").select(*KEYS, "_at", *order).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= budget)
    ends = first.groupBy(*KEYS).agg(
        F.max("_at").alias("_last"), F.count(F.lit(1)).alias("_used"),
        F.sort_array(F.collect_list("_at")).alias("_attempts"))
    placed = marked.join(ends, list(KEYS), "left")
    open_budget = F.col("_used").isNull() | (F.col("_used") < budget) | (F.col("_at") <= F.col("_last"))
    rank = F.array_position("_attempts", F.col("_at"))
    model = F.lit(None).cast("string")
    capacity = sum(n for _, n in model_limits)
    for name, limit in reversed(model_limits):
        model = F.when(rank <= capacity, name).otherwise(model)
        capacity -= limit
    over = F.lit(False) if not model_limits else rank > sum(n for _, n in model_limits)
    status = (
        F.when(~F.col("_weak"), "not_needed")
        .when(~open_budget, "exhausted")
        .when(~F.col("_can") | over, "skipped")
        .otherwise("attempt"))
    out = placed.withColumn("recovery_status", status)
    return out.withColumn("recovery_model", F.when(F.col("recovery_status") == "attempt", model)).drop(
        "_weak", "_can", "_at", "_last", "_used", "_attempts")


def extraction_summary(outcomes: DataFrame) -> DataFrame:
    """Success and fallback rates and counts per instrument; `success` marks scored rows."""
    ok = F.col("success")
    n, good = F.count(F.lit(1)), F.count_if(ok)
    fallback = F.count_if(ok & (F.col("extraction_mode") != "full_article"))
    out = outcomes.groupBy(*KEYS).agg(
        n.alias("source_row_count"), good.alias("success_count"), F.count_if(~ok).alias("failure_count"),
        F.when(n > 0, good / n).alias("success_rate"), F.when(good > 0, fallback / good).alias("fallback_usage_rate"),
        *[F.count_if(ok & (F.col("extraction_mode") == m)).alias(f"{m}_count") for m in V.EXTRACTION_MODES],
        F.count_if(ok & F.col("warning_flag")).alias("warning_count"),
        F.count_if(ok & (F.col("recovery_status") == "exhausted")).alias("exhausted_count"),
        F.count_if(ok & (F.col("recovery_status") == "skipped")).alias("skipped_count"),
        F.min(F.when(ok, F.to_date("published_at_utc"))).alias("coverage_start"),
        F.max(F.when(ok, F.to_date("published_at_utc"))).alias("coverage_end"))
    return out.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("success_count") == 0, "no_successful_extractions"),
        F.when(F.col("failure_count") > 0, "extraction_failures_present"),
        F.when(F.col("exhausted_count") > 0, "recovery_exhausted_present"),
        F.when(F.col("skipped_count") > 0, "recovery_skipped_present"))))
