"""Nested candle JSON to provider-shaped bar rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "struct<status:string,data:struct<candles:array<array<string>>>>"


def candle_rows(payloads: DataFrame, order: str = "payload_order") -> DataFrame:
    """Rows of `data.candles` = [[ts, open, high, low, close, volume, …], …].

    Payloads that are not successful and candles with fewer than six fields are left
    out. The last candle of a timestamp wins: higher `order`, then later in the array.
    """
    carry = [c for c in payloads.columns if c not in ("payload", order)]
    parsed = payloads.withColumn("p", F.from_json("payload", SCHEMA)).where("p.status = 'success'")
    rows = parsed.select(*carry, order, F.posexplode("p.data.candles").alias("at", "c")).where(F.size("c") >= 6)

    def num(i: int):
        return F.element_at("c", i).try_cast("double")

    typed = rows.select(
        *carry, F.element_at("c", 1).alias("date"), order, "at",
        num(2).alias("open"), num(3).alias("high"), num(4).alias("low"), num(5).alias("close"),
        num(5).alias("adj_close"), num(6).alias("volume"))
    values = F.struct("open", "high", "low", "close", "adj_close", "volume")
    return typed.groupBy(*carry, "date").agg(F.max_by(values, F.struct(order, "at")).alias("v")).select(*carry, "date", "v.*")
