"""Landed news feeds: every source is read, parsed and staged on its own, so a broken one costs only itself.

A source's files are JSON lines (ticker, exchange, payload). One job per source parses them and
writes the judged articles to the run's staging folder; metrics observed on the way count its payloads
and the broken ones. A source that is absent, whose files cannot be read to the end, or that has more
broken payloads than its budget allows leaves a warning and no rows. The union then reads only what was staged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.contracts import observed
from tidemark.operators.news_ingest import matches_scope, with_terms
from tidemark.settings import MarketSettings
from tidemark.sources import news_feeds as feeds

LINE = "ticker string, exchange string, payload string, _corrupt string"
STATUS = ("provider string, status string, warning string, payload_count long, broken_count long, article_count long, "
          "refused_count long")


@dataclass(frozen=True)
class Feed:
    """One source: where it lands, how its payloads become judged articles, what a whole payload looks like, and
    the share of broken payloads it may have."""

    provider: str
    path: str
    parse: Callable[[DataFrame], DataFrame]
    whole: Callable[[Column], Column]
    budget: float = 0.05


def whole_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()


def whole_rss(payload: Column) -> Column:
    return F.rtrim(payload).endswith("</rss>")


def parsers(catalog: DataFrame | None = None, market: MarketSettings = MarketSettings()) -> dict[str, tuple]:
    """(parse, whole) of the seven known providers. The exchanges' own feeds keep only articles about their instrument,
    by the terms of `catalog`."""
    def rss(rows: DataFrame) -> DataFrame:
        return feeds.rss_articles(feeds.rss_items(rows.withColumnRenamed("payload", "feed")), market)

    def official(provider: str) -> Callable[[DataFrame], DataFrame]:
        def parse(rows: DataFrame) -> DataFrame:
            judged = feeds.official_rss(rss(rows), provider)
            if catalog is None:
                return judged
            known = with_terms(judged, catalog)
            return known.where(matches_scope(F.col("article_title"), F.col("summary_snippet"), F.col("terms"))).select(*judged.columns)
        return parse

    return {
        "nse_rss": (official("nse_rss"), whole_rss), "bse_rss": (official("bse_rss"), whole_rss),
        "nse_announcements": (lambda rows: feeds.announcements(feeds.announcement_rows(rows), market), whole_json),
        "google_news_rss": (rss, whole_rss),
        "economic_times": (lambda rows: rss(rows).withColumn("provider", F.lit("economic_times")), whole_rss),
        "alphavantage": (lambda rows: feeds.ticker_feed(rows, market), whole_json),
        "marketaux": (lambda rows: feeds.company_news(rows, "marketaux", market=market), whole_json),
    }


def land(rows: DataFrame, path: str) -> None:
    """Write payload rows (ticker, exchange, payload) as a source would land them.

    Gzip, since its files tell when they end early (block codecs do not), at its fastest level.
    """
    rows.select("ticker", "exchange", "payload").write.option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").json(path)


def stage_feed(spark: SparkSession, feed: Feed, folder: str) -> tuple[DataFrame | None, tuple]:
    """(judged articles as staged, or None; the status row). One pass over the source."""
    path = f"{folder}/{feed.provider}"
    try:
        lines = spark.read.schema(LINE).option("columnNameOfCorruptRecord", "_corrupt").json(feed.path)
        broken = F.col("_corrupt").isNotNull() | F.col("payload").isNull() | ~F.coalesce(feed.whole(F.col("payload")), F.lit(False))
        marked, seen = observed(lines.withColumn("_broken", broken), {"broken": F.col("_broken")})
        judged, found = observed(
            feed.parse(marked.where("NOT _broken").select("ticker", "exchange", "payload")), {"refused": F.size("reasons") > 0})
        judged.write.parquet(path)
    except AnalysisException as failed:
        if "PATH_NOT_FOUND" not in (failed.getCondition() or ""):
            raise  # a mistake in the plan, not in the data
        return None, (feed.provider, "failed", f"{feed.provider}_unavailable", 0, 0, 0, 0)
    except (Py4JJavaError, PySparkException):  # a file that ends early or is no such file
        return None, (feed.provider, "failed", f"{feed.provider}_unreadable", 0, 0, 0, 0)
    payloads, bad = seen.get["row_count"], seen.get["broken"]
    if bad > feed.budget * payloads:
        return None, (feed.provider, "failed", f"{feed.provider}_broken_payloads", payloads, bad, 0, 0)
    refused = found.get["refused"]
    warning = f"{feed.provider}_empty" if not payloads else f"{feed.provider}_some_broken_payloads" if bad else None
    return spark.read.schema(judged.schema).parquet(path), (
        feed.provider, "ok", warning, payloads, bad, found.get["row_count"] - refused, refused)


def union_feeds(spark: SparkSession, found: Iterable[Feed], folder: str) -> tuple[DataFrame | None, DataFrame]:
    """(articles and quarantined records of all sources that could be staged, status per source).

    `folder` must be shared by all executors; each run stages under a name of its own.
    """
    run = f"{folder.rstrip('/')}/feeds-{uuid4().hex[:12]}"
    staged = [stage_feed(spark, feed, run) for feed in found]
    frames = [frame for frame, _ in staged if frame is not None]
    union = reduce(lambda a, b: a.unionByName(b), frames) if frames else None
    return union, spark.createDataFrame([status for _, status in staged], STATUS)
