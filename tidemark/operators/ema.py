"""Exponential moving averages (`adjust=False`) as window expressions.

The recurrence e[t] = q*e[t-1] + a*x[t] is a sum of geometrically weighted inputs.
Inside a block of BLOCK rows that sum is a plain running sum of x[i] * q**-i, and the
blocks are chained by folding the few block ends before the current row. The cost is
linear in the series apart from the short list of block ends, and every window is
satisfied by the (ticker, exchange) shuffle that already exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128


def with_ema(df: DataFrame, specs: dict[str, tuple[str, float, int]],
             partition: tuple[str, ...], order: str = "date") -> DataFrame:
    """Add EMAs. `specs` maps output name to (input column, alpha, minimum observations).

    The average starts at the first non-null input; nulls are expected only before it.
    """
    w = Window.partitionBy(*partition).orderBy(order)
    inputs = sorted({source for source, _, _ in specs.values()})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = {f"_n_{c}": F.count(c).over(running) for c in inputs}
    numbered = df.withColumns({**seen, "_row": F.row_number().over(w) - 1})
    numbered = numbered.withColumns({
        "_block": F.floor(F.col("_row") / BLOCK), "_pos": F.pmod("_row", F.lit(BLOCK)).cast("double")})

    # The blocks are shared by all series, so they cost one local sort together.
    block = Window.partitionBy(*partition, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (source, alpha, _) in specs.items():
        gain = F.when(F.col(f"_n_{source}") == 1, 1.0).otherwise(alpha)
        scaled = F.col(source) * gain * F.pow(F.lit(1.0 - alpha), -F.col("_pos"))
        local[f"_l_{name}"] = F.pow(F.lit(1.0 - alpha), F.col("_pos")) * F.coalesce(F.sum(scaled).over(block), F.lit(0.0))
    partial = numbered.withColumns(local)

    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.col("_pos") == BLOCK - 1
    ends = {}
    for name, (_, alpha, _) in specs.items():
        closed = F.collect_list(F.when(is_end, F.col(f"_l_{name}"))).over(earlier)
        ends[f"_c_{name}"] = F.aggregate(closed, F.lit(0.0), _chain((1.0 - alpha) ** BLOCK))
    chained = partial.withColumns(ends)

    result = {}
    for name, (source, alpha, minimum) in specs.items():
        value = F.col(f"_l_{name}") + F.pow(F.lit(1.0 - alpha), F.col("_pos") + 1) * F.col(f"_c_{name}")
        result[name] = F.when((F.col(f"_n_{source}") >= minimum) & F.col(source).isNotNull(), value)
    return chained.withColumns(result).drop("_row", "_block", "_pos", *seen, *local, *ends)


def _chain(q_block: float):
    return lambda acc, end: acc * F.lit(q_block) + end


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)
