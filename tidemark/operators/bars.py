"""Daily bars: cleaning, quarantine, dedupe, gap fill, contracts, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.settings import KEYS, PriceSettings

# Provider column names (lower-cased) and their table names.
PROVIDER_COLUMNS = {
    "date": "date", "datetime": "date", "open": "open", "high": "high", "low": "low",
    "close": "close", "adj close": "adj_close", "adj_close": "adj_close", "volume": "volume",
}
# Order of the cleaned bar table.
BAR_COLUMNS = (
    "date", "ticker", "exchange", "provider", "provider_symbol", "open", "high", "low",
    "close", "adj_close", "volume", "fetched_at_utc", "raw_snapshot_path",
)
PRICES = ("open", "high", "low", "close")


def normalize_provider_columns(raw: DataFrame) -> DataFrame:
    """Lower-case provider headers and map them to the bar names."""
    return raw.select(*[
        F.col(f"`{c}`").alias(PROVIDER_COLUMNS.get(c.strip().lower(), c.strip().lower()))
        for c in raw.columns
    ])


def _number(name: str, columns) -> Column:
    value = F.col(name).try_cast("double") if name in columns else F.lit(None).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def _crossed() -> Column:
    return (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))


def is_valid_bar() -> Column:
    """The same verdict as an empty reason list, without building the list."""
    present = F.col("date").isNotNull() & F.col("volume").isNotNull() & (F.col("volume") >= 0)
    for c in PRICES:
        present = present & F.col(c).isNotNull()
    return F.coalesce(present & ~_crossed(), F.lit(False))


def bar_reasons(raw: DataFrame) -> DataFrame:
    """Coerce prices and attach `reasons`, the ordered list of rule violations per row.

    The high/low rule is judged only when nothing else is wrong with the row.
    """
    cols = raw.columns
    day = F.when(F.length("date") == 10, F.col("date").try_cast("date")).otherwise(
        F.col("date").try_cast("timestamp").cast("date")) if dict(raw.dtypes)["date"] == "string" else F.col("date").cast("date")
    typed = raw.withColumns({
        "date": day,
        **{c: _number(c, cols) for c in (*PRICES, "volume", "adj_close")},
        # A column Catalyst cannot substitute: filters on the result stay above this step,
        # instead of repeating the parsing of every field for every mention of it.
        "_parsed": F.spark_partition_id(),
    })
    basic = F.array_compact(F.array(
        F.when(F.col("date").isNull(), "invalid_date"),
        *[F.when(F.col(c).isNull(), f"invalid_{c}") for c in PRICES],
        F.when(F.col("volume").isNull() | (F.col("volume") < 0), "invalid_volume"),
    ))
    crossed = _crossed()
    return typed.withColumn("_basic", basic).withColumn(
        "reasons",
        F.when((F.size("_basic") == 0) & crossed, F.array(F.lit("invalid_high_low_relationship")))
        .otherwise(F.col("_basic")),
    ).drop("_basic")


def split_quarantine(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reasons)."""
    parsed = F.col("_parsed") >= 0
    return (judged.where(is_valid_bar() & parsed).drop("reasons", "_parsed"),
            judged.where(~is_valid_bar() & parsed).drop("_parsed"))


def dedupe_bars(bars: DataFrame, order: str = "source_row_number") -> DataFrame:
    """Keep the last row per (ticker, exchange, date) and count what it replaced.

    `max_by` keeps one candidate per key on the map side, so a key repeated many
    times costs one row in the shuffle.
    """
    keys = [*KEYS, "date"]
    rest = [c for c in bars.columns if c not in keys]
    return (
        bars.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n"))
        .select(*keys, "r.*", (F.col("n") - 1).alias("duplicates"))
    )


def clean_bars(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated, deduplicated bars plus the quarantine. `raw` has `source_row_number`."""
    valid, quarantine = split_quarantine(bar_reasons(raw))
    return dedupe_bars(valid).drop("source_row_number"), quarantine


def slice_window(bars: DataFrame, start, end) -> DataFrame:
    """Inclusive date slice; literal bounds reach the parquet scan."""
    return bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def merge_tail(existing: DataFrame, refetched: DataFrame, overlap_days: int) -> DataFrame:
    """Keep saved rows before the overlap start and take the refetched tail after it.

    The overlap starts `overlap_days` before the saved coverage end, never before the
    saved coverage start. Each instrument has its own overlap.
    """
    keys = [*KEYS, "date"]
    cover = existing.groupBy(*KEYS).agg(F.max("date").alias("_end"), F.min("date").alias("_start"))
    # One row per instrument on this side; Spark broadcasts it only if it is small.
    bounds = cover.select(*KEYS, F.greatest(F.date_sub("_end", overlap_days), "_start").alias("overlap_start"))
    prefix = existing.join(bounds, list(KEYS)).where("date < overlap_start").drop("overlap_start")
    tail = (
        refetched.join(bounds, list(KEYS), "left")
        .where(F.col("overlap_start").isNull() | (F.col("date") >= F.col("overlap_start")))
        .drop("overlap_start")
    )
    both = prefix.withColumn("_age", F.lit(0)).unionByName(tail.withColumn("_age", F.lit(1)))
    return dedupe_bars(both, "_age").drop("_age", "duplicates")


def choose_provider(landed: DataFrame, priority: tuple[str, ...],
                    official_only: frozenset[str] | None = None) -> DataFrame:
    """Rows of the best-ranked provider that has any row for the instrument.

    The choice is made for the whole window, not per date.
    """
    if official_only is not None:
        landed = landed.where(F.col("provider").isin(*sorted(official_only)))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("provider"))
    ranked = landed.withColumn("_rank", rank).where("_rank > 0")
    best = ranked.groupBy(*KEYS).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*KEYS, "_rank"]).drop("_rank")


def align_to_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Re-index every instrument to its sessions and fill the gaps.

    Bars on non-session days disappear. A gap row repeats the last known prices with
    volume 0 and `market_data_gap_flag` 1. Instead of a grid join, each bar is
    exploded over the sessions it covers, so the whole step needs the one
    (ticker, exchange) shuffle that all later windows reuse.
    """
    facts = [c for c in bars.columns if c not in (*KEYS, "date", "volume")]
    optional = [c for c in ("open", "high", "low", "adj_close") if c in facts]
    marked = bars.join(
        F.broadcast(calendar.select("exchange", "date", "is_session", "session_index")),
        ["exchange", "date"],
    )
    whole = Window.partitionBy(*KEYS)
    w = whole.orderBy("date")
    # Index of the first session on or after a day is session_index + (0 if session else 1).
    edge = marked.withColumns({
        "_first": F.min(F.col("session_index") + (~F.col("is_session")).cast("int")).over(whole),
        "_last": F.max("session_index").over(whole),
    }).where("is_session")
    whole_ordered = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = edge.withColumns({
        "_next": F.lead("session_index").over(w),
        "_rank": F.row_number().over(w),
        **{c: F.coalesce(
            F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            F.first(c, ignorenulls=True).over(whole_ordered),
            F.col("close")) for c in optional},
    })
    lead_start = F.when(F.col("_rank") == 1, F.col("_first")).otherwise(F.col("session_index"))
    spread = filled.withColumn(
        "_slot",
        F.explode(F.sequence(lead_start, F.coalesce(F.col("_next") - 1, F.col("_last")))),
    )
    own = F.col("_slot") == F.col("session_index")
    leading = F.col("_slot") < F.col("session_index")
    slots = calendar.where("is_session").select(
        "exchange", F.col("session_index").alias("_slot"), F.col("date").alias("_session"))
    keep_from_bar = set(optional)
    return (
        spread.withColumns({
            "volume": F.when(own, F.col("volume")).otherwise(F.lit(0.0)),
            "market_data_gap_flag": F.when(own, 0).otherwise(1),
            "close": F.when(~leading, F.col("close")),
            **{c: F.when(own, F.col(c)) for c in facts if c not in keep_from_bar | {"close"}},
        })
        .join(F.broadcast(slots), ["exchange", "_slot"])
        .select(*KEYS, F.col("_session").alias("date"), *facts, "volume", "market_data_gap_flag")
    )


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions inside each instrument's coverage that have no bar."""
    spans = bars.groupBy(*KEYS).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = spans.select(*KEYS, F.explode(F.sequence("_a", "_b")).alias("date"))
    expected = days.join(
        F.broadcast(calendar.where("is_session").select("exchange", "date")), ["exchange", "date"], "left_semi")
    return expected.join(bars.select(*KEYS, "date"), [*KEYS, "date"], "left_anti").select(*KEYS, "date")


def bar_contract(bars: DataFrame, settings: PriceSettings = PriceSettings()) -> DataFrame:
    """Violation counts per instrument; `violations` is the ordered list of broken rules."""
    per_day = bars.groupBy(*KEYS, "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("close").isNull()).alias("bad_close"),
        F.count_if(F.col("close") <= 0).alias("nonpositive_close"),
        F.count_if(F.col("volume").isNull()).alias("bad_volume"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
    )
    out = per_day.groupBy(*KEYS).agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("date").isNull(), F.col("n")).otherwise(0)).alias("invalid_date_count"),
        F.sum(F.when(F.col("date").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicate_date_count"),
        F.sum("bad_close").alias("invalid_close_count"),
        F.sum("nonpositive_close").alias("nonpositive_close_count"),
        F.sum("bad_volume").alias("invalid_volume_count"),
        F.sum("negative_volume").alias("negative_volume_count"),
    ).withColumn("short_history", (F.col("row_count") < settings.minimum_rows).cast("int"))
    return out.withColumn("violations", F.array_compact(F.array(
        F.when(F.col("invalid_date_count") > 0, "invalid_date"),
        F.when(F.col("duplicate_date_count") > 0, "duplicate_date"),
        F.when(F.col("invalid_close_count") > 0, "invalid_close"),
        F.when(F.col("nonpositive_close_count") > 0, "nonpositive_close"),
        F.when(F.col("invalid_volume_count") > 0, "invalid_volume"),
        F.when(F.col("negative_volume_count") > 0, "negative_volume"),
        F.when(F.col("short_history") > 0, "insufficient_rows"),
    )))


def bar_summary(valid: DataFrame, quarantine: DataFrame, missing: DataFrame) -> DataFrame:
    """One row per instrument: coverage, duplicates, dropped rows and missing sessions."""
    kept = valid.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("date").alias("coverage_start"),
        F.max("date").alias("coverage_end"),
        F.sum("duplicates").alias("duplicate_count"),
    )
    dropped = quarantine.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("dropped_row_count"))
    absent = missing.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("missing_session_count"))
    return (
        kept.join(dropped, list(KEYS), "full").join(absent, list(KEYS), "left")
        .fillna(0, ["row_count", "duplicate_count", "dropped_row_count", "missing_session_count"])
    )


def freshness(bars: DataFrame, required: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per requested (ticker, exchange, required_date): fresh or stale, by how many days, and why."""
    latest = bars.groupBy(*KEYS).agg(F.max("date").alias("coverage_end"))
    asked = required.join(
        F.broadcast(calendar.select("exchange", F.col("date").alias("required_date"),
                                    F.col("on_or_before").alias("effective_date"))),
        ["exchange", "required_date"], "left",
    ).join(latest, list(KEYS), "left")
    ahead = F.datediff("coverage_end", "effective_date")
    return asked.withColumns({
        "is_fresh": F.coalesce(ahead >= 0, F.lit(False)),
        "days_ahead": F.greatest(ahead, F.lit(0)),
        "days_behind": F.greatest(-ahead, F.lit(0)),
        "reason": F.when(F.col("coverage_end").isNull(), "no_existing_data")
        .when(ahead > 0, "covers_beyond_required")
        .when((ahead == 0) & (F.col("effective_date") != F.col("required_date")), "fresh_prior_session")
        .when(ahead == 0, "fresh")
        .otherwise("stale"),
    })


def cap_incomplete_session(requests: DataFrame, calendar: DataFrame, timezone: str, close_time: str) -> DataFrame:
    """Move an end date back one session while today's session has not closed.

    `requests` has exchange, end_date and now_utc.
    """
    local = F.from_utc_timestamp("now_utc", timezone)
    joined = requests.join(
        F.broadcast(calendar.select("exchange", F.col("date").alias("end_date"), "is_session", "previous_session")),
        ["exchange", "end_date"], "left",
    )
    open_today = (
        (F.col("end_date") == F.to_date(local)) & F.col("is_session")
        & (F.date_format(local, "HH:mm:ss") < close_time)
    )
    return joined.withColumns({
        "capped_end_date": F.when(open_today, F.col("previous_session")).otherwise(F.col("end_date")),
        "cap_reason": F.when(open_today, "historical_end_date_capped_before_session_close"),
    }).drop("is_session", "previous_session")
