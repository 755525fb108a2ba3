"""Fixed values shared by the news and scoring stages."""

# Vocabularies of a scored article.
EVENT_TYPES = (
    "acquisition", "analyst_commentary", "deal_win", "earnings", "government_policy_impact",
    "guidance", "lawsuit", "macro_spillover", "management_change", "market_reaction", "other",
    "partnership", "product_launch", "regulation", "rupee_commodity_sensitivity",
    "sector_development", "supply_chain",
)
SENTIMENT_LABELS = ("negative", "neutral", "positive")
BIASES = ("bearish", "bullish", "neutral")
HORIZONS = ("intraday", "long_term", "medium_term", "short_term")
EXTRACTION_MODES = ("full_article", "headline_only", "headline_plus_snippet")

# News channels; every event type not listed here belongs to `company`.
CHANNELS = ("company", "sector", "macro")
SECTOR_EVENTS = ("analyst_commentary", "sector_development", "regulation", "market_reaction")
MACRO_EVENTS = ("macro_spillover", "government_policy_impact", "rupee_commodity_sensitivity")

# Source quality by provider; unknown providers get DEFAULT_SOURCE_WEIGHT.
SOURCE_WEIGHTS = {
    "nse_announcements": 1.0,
    "marketaux": 1.0,
    "economic_times": 0.9,
    "alphavantage": 0.85,
    "google_news_rss": 0.75,
}
DEFAULT_SOURCE_WEIGHT = 0.85

# Content quality by extraction mode.
CONTENT_QUALITY = {"full_article": 1.0, "headline_plus_snippet": 0.75, "headline_only": 0.5}

# News signal states.
FRESH, CARRIED, ZERO, FALLBACK = "fresh_news", "carried_forward_only", "zero_news", "fallback_heavy"
NEWS_STATES = (FRESH, CARRIED, ZERO, FALLBACK)

# Columns of the scored-article table.
EXTRACTION_COLUMNS = (
    "article_id", "ticker", "exchange", "company_name", "article_title", "article_url",
    "canonical_url", "source_domain", "provider", "provider_source", "published_at_utc",
    "published_at_ist", "published_date_ist", "extraction_mode", "content_quality_score",
    "warning_flag", "source_fetch_warning_flag", "prompt_truncated", "article_input_hash",
    "request_mode", "recovery_reason", "recovery_status", "llm_provider", "llm_model",
    "prompt_version", "schema_version", "relevance_score", "sentiment_label",
    "sentiment_score", "event_type", "event_severity", "expected_horizon",
    "directional_bias", "confidence_score", "rationale_short",
)
# Closed ranges of the article scores.
SCORE_RANGES = {
    "content_quality_score": (0.0, 1.0),
    "relevance_score": (0.0, 1.0),
    "sentiment_score": (-1.0, 1.0),
    "event_severity": (0.0, 1.0),
    "confidence_score": (0.0, 1.0),
}
