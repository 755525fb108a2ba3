"""Contracts inside a plan: rules counted or refused while the rows flow by, without a scan of their own.

A rule is a column that is true where a row breaks it; null counts as kept. Counting uses
observed metrics, which Spark gathers during whichever action runs the frame; refusing puts the
rule in a filter that raises, which column pruning cannot drop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

Rules = dict[str, Column]
COPIES = "_copies"


def _broken(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def with_copies(df: DataFrame, keys: list[str], name: str = COPIES) -> DataFrame:
    """Rank of each row among those of its key, 1 for a key's only or first row.

    The window's partitioning and sort are those that a join on the key needs anyway.
    """
    w = Window.partitionBy(*keys).orderBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(w))


def duplicate_rule(name: str = COPIES) -> Column:
    return F.col(name) > 1


def observed(df: DataFrame, rules: Rules, name: str | None = None) -> tuple[DataFrame, Observation]:
    """The frame unchanged, and the counts of broken rules and of rows, known after the first action on it.

    Read them with `observation.get`; a plan that runs no action leaves them open.
    """
    watch = Observation(name) if name else Observation()
    return df.observe(watch, F.count(F.lit(1)).alias("row_count"), *[
        F.count_if(_broken(rule)).alias(rule_name) for rule_name, rule in rules.items()]), watch


def guarded(df: DataFrame, rules: Rules, stage: str) -> DataFrame:
    """The frame, whose evaluation fails at the first row that breaks a rule; the error names stage and rule."""
    def refused(kept: Column, item: tuple[str, Column]) -> Column:
        name, rule = item
        return F.when(_broken(rule), F.raise_error(F.lit(f"{stage}: {name}")).cast("boolean")).otherwise(kept)

    return df.where(reduce(refused, reversed(list(rules.items())), F.lit(True)))


def one_row_per_key(df: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """The frame, whose evaluation fails if two rows share a key. Null keys are values like any other."""
    return guarded(with_copies(df, keys), {"duplicate_key": duplicate_rule()}, stage).drop(COPIES)


def as_rows(df: DataFrame, counts: dict[str, int], table: str) -> DataFrame:
    """Observed counts as (table_name, rule, violations) rows."""
    rows = [(table, name, int(n)) for name, n in counts.items()]
    return df.sparkSession.createDataFrame(rows, "table_name string, rule string, violations long")
