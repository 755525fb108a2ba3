"""Text, enum, number and boolean normalization as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of booleans.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")

CONTROL = r"[\x00-\x1F\x7F]"
SPACE = r"\s+"
BLANKS = " \t\n\r\x0b\x0c"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where `value` is evaluated once however often `use` names it.

    A column named twice in an expression is evaluated twice, in nested ones many times, and the code
    generated for it soon is a method too large for the JVM to compile. A lambda's variable holds a value.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_text(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def collapse(c: Column) -> Column:
    """Trimmed text with single spaces inside."""
    return F.btrim(F.regexp_replace(c, SPACE, " "), F.lit(BLANKS))


def match_text(c: Column) -> Column:
    """Lower-cased collapsed text for comparisons; null becomes empty."""
    return F.coalesce(F.lower(collapse(c)), F.lit(""))


def safe_text(c: Column) -> Column:
    """Control characters become spaces, whitespace collapses, null becomes empty."""
    spaced = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), CONTROL, " ")
    return F.trim(F.regexp_replace(spaced, SPACE, " "))


def enum_text(c: Column) -> Column:
    """snake_case form of an enum value; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(safe_text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def to_bool(c: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is null."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_float(c: Column) -> Column:
    """Double or null; NaN is null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_int(c: Column) -> Column:
    """Whole part of a number or null."""
    return to_float(c).try_cast("long")


def literal_map(values: dict, key: Column, default=None) -> Column:
    """CASE lookup of a small fixed map."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)
