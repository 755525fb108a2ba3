"""Provider timestamps and stable article ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import bound, clean_text

# Layouts of provider timestamps beside ISO.
COMPACT_SECONDS, COMPACT_MINUTES = "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm"
MAIL_DATE = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})\s+([+-]\d{4}|GMT|UTC|UT|Z)$"
EXCHANGE_DATE = "d-MMM-yyyy HH:mm:ss"
HAS_ZONE = r"(Z|[+-]\d{2}:?\d{2}| GMT| UTC)$"


def _mail(text: Column) -> Column:
    body = F.regexp_extract(text, MAIL_DATE, 1)
    offset = bound(F.regexp_extract(text, MAIL_DATE, 2), lambda zone: F.when(zone.rlike("^[+-]"), zone).otherwise("+0000"))
    return F.when(text.rlike(MAIL_DATE), F.try_to_timestamp(
        F.concat(body, F.lit(" "), offset), F.lit("d MMM yyyy HH:mm:ss Z")))


def provider_timestamp(raw: Column) -> Column:
    """UTC timestamp of compact, ISO or mail-style text; naive values are UTC."""
    return bound(clean_text(raw), lambda text: F.coalesce(
        F.when(F.length(text) == 15, F.try_to_timestamp(text, F.lit(COMPACT_SECONDS))),
        F.when(F.length(text) == 13, F.try_to_timestamp(text, F.lit(COMPACT_MINUTES))),
        _mail(text),
        text.try_cast("timestamp"),
    ))


def market_timestamp(raw: Column, timezone: str) -> Column:
    """UTC timestamp of text whose naive values are market-local."""
    def read(text: Column) -> Column:
        naive = F.coalesce(F.try_to_timestamp(text, F.lit(EXCHANGE_DATE)), text.try_cast("timestamp"))
        return F.when(text.rlike(HAS_ZONE), F.coalesce(_mail(text), text.try_cast("timestamp"))).otherwise(
            F.to_utc_timestamp(naive, timezone))

    return bound(clean_text(raw), read)


def iso_utc(ts: Column) -> Column:
    """ISO text with offset, microseconds only when present."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""),
        F.lit("+00:00"))


def article_id(uuid: Column, canonical_url: Column, url: Column, title: Column, published: Column) -> Column:
    """Provider id, or 24 hex digits of the SHA-256 over four newline-terminated parts."""
    text = F.concat(*[F.concat(F.coalesce(p, F.lit("")), F.lit("\n"))
                      for p in (canonical_url, url, title, iso_utc(published))])
    return F.coalesce(F.nullif(uuid, F.lit("")), F.substring(F.sha2(text, 256), 1, 24))
