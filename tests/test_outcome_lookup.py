"""the wide log rows travel once to meet their outcomes."""

from pyspark.sql import functions as F

from tidemark.operators import prediction_log as P


def exchanges_of(node, column):
    """Shuffles in the plan whose rows carry `column`."""
    own = node.nodeName() == "Exchange" and any(
        node.output().apply(i).name() == column for i in range(node.output().size()))
    return own + sum(exchanges_of(node.children().apply(i), column) for i in range(node.children().size()))


def test_log_rows_are_shuffled_once(spark):
    log = spark.createDataFrame(
        [("a", "X", "NSE", "2026-03-09", "2026-03-10"), ("b", "X", "NSE", None, "2026-03-10"), ("c", "X", "NSE", "2026-03-10", None),
         ("d", "X", "NSE", "2026-03-10", "2026-03-12"), ("e", None, "NSE", "2026-03-09", "2026-03-10"), ("f", "X", "NSE", "2026-03-09", "2026-03-10")],
        "pilot_entry_id string, ticker string, exchange string, h string, p string").select(
        "pilot_entry_id", "ticker", "exchange", F.col("h").cast("date").alias("historical_date"), F.col("p").cast("date").alias("prediction_date"))
    bars = spark.createDataFrame(
        [("X", "NSE", "2026-03-09", 1.0), ("X", "NSE", "2026-03-10", 2.0)], "ticker string, exchange string, d string, close double").select(
        "ticker", "exchange", F.col("d").cast("date").alias("date"), "close")
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        found = P.outcomes(log, bars)
        assert exchanges_of(found._jdf.queryExecution().executedPlan(), "pilot_entry_id") == 1
        got = {r["pilot_entry_id"]: (r["historical_close"], r["prediction_close"]) for r in found.collect()}
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert got == {"a": (1.0, 2.0), "b": (None, 2.0), "c": (2.0, None), "d": (2.0, None), "e": (None, None), "f": (1.0, 2.0)}
    assert found.columns == [*log.columns, "historical_close", "prediction_close"]
