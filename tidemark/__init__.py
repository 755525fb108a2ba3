"""Market-signal analytics on Spark: bars, scored news, models, prediction log."""

__version__ = "0.1.0"
