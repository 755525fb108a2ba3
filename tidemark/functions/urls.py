"""URL validation, canonical form, domains and publisher names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import bound, clean_text, collapse, match_text

# Query parameters dropped when their lower-cased name starts with one of these.
TRACKING_PREFIXES = ("utm_", "ga_", "fbclid", "gclid", "mc_", "ref")

HOST = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"
DOTTED = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
# IPv4 blocks that are not globally routable, as (first address, prefix length).
LOCAL_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)


def _address(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def is_public_host(host: Column) -> Column:
    """Whether a lower-cased host name or IPv4 address looks public."""
    def is_local(number: Column) -> Column:
        local = F.lit(False)
        for first, bits in LOCAL_BLOCKS:
            low = _address(first)
            local = local | number.between(low, low + (1 << (32 - bits)) - 1)
        return local

    def is_public(name: Column) -> Column:
        octets = F.transform(F.split(name, r"\."), lambda x: x.try_cast("long"))
        number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + F.coalesce(x, F.lit(0)))
        last = F.element_at(F.split(name, r"\."), -1)
        named = name.rlike(HOST) & (F.length(name) <= 253) & ~last.rlike("^[0-9]+$")
        return F.when(name.rlike(DOTTED), ~bound(number, is_local)).otherwise(named)

    return bound(F.btrim(host, F.lit(" .")), is_public)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    """Form encoding that keeps `~` and escapes `*`."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def validate_url(raw: Column) -> Column:
    """Struct (url, reason): canonical URL, or null and why it was refused.

    Canonical means http/https, lower-cased public host, no default port, no trailing
    slash, no fragment, no tracking parameters, parameters sorted. A blank input gives
    two nulls.
    """
    def split(text: Column) -> Column:
        path = F.regexp_extract(text, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
        return F.struct(
            text.alias("text"),
            F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
            F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1).alias("netloc"),
            F.rtrim(F.regexp_replace(path, ";[^/]*$", ""), F.lit("/")).alias("path"),
            F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1).alias("query"))

    def with_host(p: Column) -> Column:
        hostport = F.substring_index(p["netloc"], "@", -1)
        return F.struct(
            p.alias("p"), F.lower(F.regexp_extract(hostport, r"^([^:]*)", 1)).alias("host"),
            F.regexp_extract(hostport, r"^[^:]*:(.*)$", 1).alias("port_text"))

    def refusal(h: Column) -> Column:
        text, scheme, netloc = h["p"]["text"], h["p"]["scheme"], h["p"]["netloc"]
        brackets = netloc.contains("[") != netloc.contains("]")
        at = F.length(netloc) - F.length(F.substring_index(netloc, "@", -1))
        userinfo = F.when(at > 0, F.substring(netloc, F.lit(1), at - 1)).otherwise("")
        port = h["port_text"].try_cast("int")
        bad_port = (h["port_text"] != "") & (~h["port_text"].rlike("^[0-9]+$") | port.isNull() | (port > 65535))
        return (
            F.when(text.isNull(), None)
            .when(brackets, "malformed_article_url")
            .when(~scheme.isin("http", "https") | (netloc == ""), "invalid_article_url")
            .when(~userinfo.isin("", ":"), "article_url_contains_credentials")
            .when(h["host"] == "", "invalid_article_url")
            .when(~is_public_host(h["host"]), "disallowed_article_url_host")
            .when(bad_port, "malformed_article_url"))

    def tracked(pair: Column) -> Column:
        def hit(name: Column) -> Column:
            found = F.lit(False)
            for prefix in TRACKING_PREFIXES:
                found = found | name.startswith(prefix)
            return found
        return bound(F.lower(F.trim(pair["k"])), hit)

    def canonical(h: Column) -> Column:
        scheme, path, port = h["p"]["scheme"], h["p"]["path"], h["port_text"].try_cast("int")
        pairs = F.transform(
            F.filter(F.split(h["p"]["query"], "&"), lambda x: x != ""),
            lambda x: F.struct(
                _decode(F.substring_index(x, "=", 1)).alias("k"),
                _decode(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v")))
        kept = F.array_sort(F.filter(pairs, lambda x: ~tracked(x)))
        encoded = F.array_join(F.transform(kept, lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"]))), "&")
        default_port = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
        shown = F.when((h["port_text"] != "") & (port > 0) & ~default_port, F.concat(
            h["host"], F.lit(":"), port.cast("string"))).otherwise(h["host"])
        return F.concat(
            scheme, F.lit("://"), shown, F.when(path == "", "/").otherwise(path),
            bound(encoded, lambda e: F.when(e != "", F.concat(F.lit("?"), e)).otherwise("")))

    def judged(h: Column) -> Column:
        return bound(refusal(h), lambda reason: F.struct(
            F.when(h["p"]["text"].isNotNull() & reason.isNull(), canonical(h)).alias("url"), reason.alias("reason")))

    return bound(bound(bound(clean_text(raw), split), with_host), judged)


def source_domain(raw: Column) -> Column:
    """Lower-cased host of a URL or bare domain."""
    def host(text: Column) -> Column:
        full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
        netloc = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
        return F.lower(F.regexp_extract(F.substring_index(netloc, "@", -1), r"^([^:]*)", 1))

    return bound(bound(clean_text(raw), host), lambda h: F.nullif(h, F.lit("")))


def publisher_from_domain(domain: Column) -> Column:
    """Readable publisher label of a host name."""
    def name(parts: Column) -> Column:
        first = F.get(parts, F.lit(0))
        # Leading labels that are suffixes rather than names.
        return F.when((F.size(parts) >= 3) & first.isin("co", "com", "net", "org"), F.element_at(parts, -3)).otherwise(first)

    host = F.regexp_replace(F.lower(clean_text(domain)), r"^www\.", "")
    root = bound(F.filter(F.split(host, r"\."), lambda x: x != ""), name)
    words = F.filter(F.split(F.regexp_replace(root, "[-_]", " "), r"\s+"), lambda x: x != "")
    label = F.array_join(F.transform(
        words, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))), " ")
    return bound(label, lambda x: F.nullif(x, F.lit("")))


def publisher_name(provider_source: Column, domain: Column) -> Column:
    """Provider label, or the domain label when the two say the same."""
    def chosen(p: Column) -> Column:
        source = match_text(p["source"])
        same = bound(source, lambda s: (s == match_text(p["domain"])) | (s == match_text(p["label"])))
        return F.when(p["source"].isNull() | same, p["label"]).otherwise(collapse(p["source"]))

    return bound(F.struct(
        clean_text(provider_source).alias("source"), domain.alias("domain"), publisher_from_domain(domain).alias("label")), chosen)
