"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.queries.registry import load_all  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "bar_dedupe", "bar_gap_fill", "price_features", "news_session_aggregates", "news_features",
    "news_lags_and_crosses", "article_ranking", "page_article_text", "response_validation",
    "prediction_metrics", "variant_metric_table", "outcome_backfill", "log_summary", "as_of_features",
    "prediction_run",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
        # Window work is heavy per byte: do not merge small shuffle partitions below the core count.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k")
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        entries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
