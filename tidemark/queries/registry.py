"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries.oracle import sql as compose

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `covers` lists the blueprint row ids it exercises."""

    def add(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, fn, compose(sql) if sql else None, tuple(covers.split()))
        return fn

    return add


def load_all() -> dict[str, Entry]:
    from tidemark.queries import (  # noqa: F401
        bar_queries,
        price_queries,
        news_queries,
        merge_queries,
        evaluation_queries,
        ingest_queries,
        scoring_queries,
        window_queries,
        log_queries,
        model_queries,
    )
    return ENTRIES
