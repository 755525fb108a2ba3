"""Instrument catalog: defaults overlaid by local entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOG_SCHEMA = (
    "symbol string, exchange string, company_name string, search_aliases array<string>, "
    "sector_name string, industry_name string, sector_query_terms array<string>, macro_query_terms array<string>")


def overlay_catalog(*layers: DataFrame) -> DataFrame:
    """Later layers win per (symbol, exchange); inside a layer the highest `position` wins."""
    union = None
    for i, layer in enumerate(layers):
        entry = layer.withColumns({
            "symbol": F.upper(F.trim("symbol")), "exchange": F.upper(F.trim("exchange")), "_layer": F.lit(i)})
        if "position" not in layer.columns:
            entry = entry.withColumn("position", F.lit(0).cast("long"))
        union = entry if union is None else union.unionByName(entry, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in ("symbol", "exchange", "_layer", "position")]
    return union.groupBy("symbol", "exchange").agg(
        F.max_by(F.struct(*rest), F.struct("_layer", "position")).alias("e")).select("symbol", "exchange", "e.*")


def read_catalog(spark, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=True)
