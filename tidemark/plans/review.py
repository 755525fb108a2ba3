"""Review of the log over a session window."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import review as R


def review(log: DataFrame, calendar: DataFrame, start: str, end: str, week: DataFrame | None = None) -> dict[str, DataFrame]:
    """Daily grid, missing pairs, summaries, issues and claims of every instrument in the log."""
    pairs = R.expected_pairs(log, calendar, start, end)
    summary = R.log_summary(log, pairs)
    return {
        "daily": R.daily_grid(log, pairs),
        "missing": R.missing_pairs(log, pairs),
        "summary": summary,
        "issues": R.operational_issues(summary, week),
        "claims": R.claim_checks(summary),
    }
