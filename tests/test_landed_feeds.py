"""Landed feeds: each source alone; absent, empty, cut-off and broken ones cost only themselves."""

import gzip
import json

import pytest

from tidemark.sources.landed import Feed, land, parsers, union_feeds


def company(i):
    return json.dumps({"data": [{"uuid": f"u{i}", "title": f"Title {i}", "published_at": "2026-01-05T10:00:00.000000Z",
                                 "url": f"https://example.com/{i}", "source": "example.com"}]})


def rss(i):
    return (f"<rss><channel><item><title>Title {i}</title><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate>"
            f'<link>https://example.com/{i}</link><source url="https://example.com">Example</source></item></channel></rss>')


def notice(i):
    return json.dumps([{"subject": f"Title {i}", "exchdisstime": "05-Jan-2026 10:00:00", "attchmntFile": f"/n{i}.pdf"}])


@pytest.fixture
def feeds(spark, tmp_path):
    known = parsers()
    make = {"marketaux": company, "nse_announcements": notice}

    def feed(provider, payloads, budget=0.05):
        path = str(tmp_path / "landed" / provider)
        rows = [("INFY", "NSE", p) for p in payloads]
        land(spark.createDataFrame(rows, "ticker string, exchange string, payload string").coalesce(1), path)
        return Feed(provider, path, *known[provider], budget)

    return feed, lambda p, n: [make.get(p, rss)(i) for i in range(n)]


def test_seven_feeds_of_which_four_fail(spark, tmp_path, feeds):
    feed, payloads = feeds
    found = [
        feed("marketaux", payloads("marketaux", 30) + ['{"data": [{"uuid"']),  # one broken page inside its budget
        feed("nse_announcements", payloads("nse_announcements", 5)), feed("google_news_rss", payloads("google_news_rss", 6)),
        feed("nse_rss", payloads("nse_rss", 4) + ["<rss><channel><item>"] * 3),  # too many broken ones
        feed("bse_rss", []), feed("economic_times", payloads("economic_times", 400)),
        Feed("alphavantage", str(tmp_path / "nowhere"), *parsers()["alphavantage"])]
    part = next(p for p in (tmp_path / "landed" / "economic_times").iterdir() if p.name.endswith(".gz"))
    part.write_bytes(part.read_bytes()[:-200])  # the file ends early
    for crc in (tmp_path / "landed" / "economic_times").glob("*.crc"):
        crc.unlink()
    union, status = union_feeds(spark, found, str(tmp_path))
    got = {r["provider"]: tuple(r)[1:] for r in status.collect()}
    assert got == {
        "marketaux": ("ok", "marketaux_some_broken_payloads", 31, 1, 30, 0), "nse_announcements": ("ok", None, 5, 0, 5, 0),
        "google_news_rss": ("ok", None, 6, 0, 6, 0), "nse_rss": ("failed", "nse_rss_broken_payloads", 7, 3, 0, 0),
        "bse_rss": ("ok", "bse_rss_empty", 0, 0, 0, 0), "economic_times": ("failed", "economic_times_unreadable", 0, 0, 0, 0),
        "alphavantage": ("failed", "alphavantage_unavailable", 0, 0, 0, 0)}
    assert {r["provider"]: r["count"] for r in union.groupBy("provider").count().collect()} == {
        "marketaux": 30, "nse_announcements": 5, "google_news_rss": 6}


def test_lines_that_are_no_json_count_as_broken(spark, tmp_path, feeds):
    feed, payloads = feeds
    one = feed("marketaux", payloads("marketaux", 3), budget=0.5)
    with gzip.open(tmp_path / "landed" / "marketaux" / "extra.json.gz", "wt") as f:
        f.write('{"ticker": "INFY", "payl\n')
    union, status = union_feeds(spark, [one], str(tmp_path))
    assert tuple(status.collect()[0])[1:] == ("ok", "marketaux_some_broken_payloads", 4, 1, 3, 0) and union.count() == 3


def test_nothing_landed(spark, tmp_path):
    union, status = union_feeds(spark, [Feed("marketaux", str(tmp_path / "x"), *parsers()["marketaux"])], str(tmp_path))
    assert union is None and status.collect()[0]["warning"] == "marketaux_unavailable"
