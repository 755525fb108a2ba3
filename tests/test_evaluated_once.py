"""Costly text work is evaluated once per row: patterns in the optimized plan are counted."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import times as T
from tidemark.functions import urls as U
from tidemark.operators import news_ingest as G
from tidemark.operators import scoring as C
from tidemark.sources import news_feeds


@pytest.fixture
def patterns(spark):
    """Number of regular expressions in the plan that runs."""
    def count(df):
        old = spark.conf.get("spark.sql.debug.maxToStringFields")
        spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
        try:
            plan = df._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.set("spark.sql.debug.maxToStringFields", old)
        return sum(plan.count(name) for name in ("regexp_replace(", "regexp_extract(", "RLIKE"))
    return count


def text_rows(spark, rows, columns):
    """Rows behind an RDD, so that the optimizer does not evaluate them itself."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), columns)


def test_feed_articles(spark, patterns):
    """a URL is taken apart once for the url, the reason, the domain and the id."""
    pages = text_rows(spark, [("N1", "NSE", "{}")], "ticker string, exchange string, payload string")
    assert patterns(news_feeds.company_news(pages, "marketaux")) <= 45
    assert patterns(news_feeds.ticker_feed(pages)) <= 45
    assert patterns(news_feeds.announcements(news_feeds.announcement_rows(pages))) <= 45


def test_urls_keep_their_form(spark):
    """refusals, ports, parameters and blanks come out as before."""
    given = [None, " ", "https://WWW.a.com:443/p/1/?utm_source=x&b=2&a=1#f", "http://a.com:8080", "javascript:alert(1)",
             "http://u:p@a.com/", "http://10.1.2.3/x", "http://8.8.8.8/x;y", "http://[a.com/", "http://a.com:99999/", "http://@a.com",
             "http://localhost/", "http://a.com/?q=a%20b&q=*~&x", "https:///p"]
    df = text_rows(spark, [(i, u) for i, u in enumerate(given)], "i int, u string")
    got = [tuple(r["v"]) for r in df.withColumn("v", U.validate_url(F.col("u"))).orderBy("i").collect()]
    assert got == [
        (None, None), (None, None), ("https://www.a.com/p/1?a=1&b=2", None), ("http://a.com:8080/", None),
        (None, "invalid_article_url"), (None, "article_url_contains_credentials"), (None, "disallowed_article_url_host"),
        ("http://8.8.8.8/x", None), (None, "malformed_article_url"), (None, "malformed_article_url"), ("http://a.com/", None),
        (None, "disallowed_article_url_host"), ("http://a.com/?q=%2A~&q=a+b&x=", None), (None, "invalid_article_url")]


def test_scope_text_is_normalized_once(spark):
    """not once per term of the instrument."""
    df = text_rows(spark, [("The  Infy\nResult", None, ["x", "infy result"]), ("a", "b", None), (None, "b c", ["b c"])],
                   "title string, snippet string, terms array<string>")
    out = df.withColumn("hit", G.matches_scope(F.col("title"), F.col("snippet"), F.col("terms")))
    assert [r["hit"] for r in out.collect()] == [True, False, True]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace(") < plan.index("exists(")


def test_provider_times(spark):
    given = ["20260310T081500", "20260310T0815", "Tue, 10 Mar 2026 08:15:00 GMT", "2026-03-10T08:15:00Z", "soon", "20260199T000000", None, " "]
    df = text_rows(spark, [(i, g) for i, g in enumerate(given)], "i int, g string")
    got = [r["t"] for r in df.select("i", F.date_format(T.provider_timestamp(F.col("g")), "yyyy-MM-dd HH:mm").alias("t")).orderBy("i").collect()]
    assert got == ["2026-03-10 08:15"] * 4 + [None] * 4


def test_text_acquisition(spark, patterns):
    """F8: fetched text and baseline are normalized once for all five outcome columns."""
    df = text_rows(spark, [("a", "t", "s", "x")], "article_id string, article_title string, summary_snippet string, fetched string")
    out = G.acquire_text(df, "fetched")
    assert patterns(out) == 2 and "_refused" not in out.columns


def test_response_validation(spark, patterns):
    """every response field is normalized once for its checks and its output."""
    df = text_rows(spark, [("1", "{}", "T", "Co", "full_article", 1.0, False)],
                   "article_id string, payload string, ticker string, company_name string, extraction_mode string, "
                   "content_quality_score double, warning_flag boolean")
    assert patterns(C.validate_responses(df)) <= 30
