"""Contracts that run inside the plan: counted in the pass that writes, refused where a guard stands."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import merge as G
from tidemark.operators import news_features as N

def rules():
    return {"negative": F.col("x") < 0, "too_large": F.col("x") > 100, "empty": F.col("x").isNull()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 5.0), (2, -1.0), (2, 200.0), (None, None), (None, -7.0)], "k int, x double")


def test_counts_come_with_the_pass(spark, rows, tmp_path):

    frame, watch = C.observed(rows, rules())
    frame.write.parquet(str(tmp_path / "out"))
    assert watch.get == {"row_count": 5, "negative": 2, "too_large": 1, "empty": 1}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    empty, nothing = C.observed(rows.limit(0), rules())
    empty.collect()
    assert nothing.get == {"row_count": 0, "negative": 0, "too_large": 0, "empty": 0}


def test_guards_refuse_and_name_the_rule(rows):
    kept = C.guarded(rows.where("x > 0 AND x < 100"), rules(), "prices")
    assert kept.select("k").collect()[0]["k"] == 1  # the rule's column need not be selected
    with pytest.raises(Exception, match="prices: negative"):
        C.guarded(rows.where("x < 0"), rules(), "prices").select("k").collect()
    assert C.guarded(rows, {}, "none").count() == 5


def test_one_row_per_key(rows):
    assert C.one_row_per_key(rows.where("x > 0"), ["k"], "t").count() == 2
    with pytest.raises(Exception, match="t: duplicate_key"):
        C.one_row_per_key(rows, ["k"], "t").select("k").collect()
    with pytest.raises(Exception, match="duplicate_key"):  # null keys too
        C.one_row_per_key(rows.where("k IS NULL"), ["k"], "t").count()


def test_duplicate_news_key_fails_the_join(spark):
    price = spark.createDataFrame([("A", "NSE", "2026-01-05", "2026-01-06", "pre_market")],
                                  "ticker string, exchange string, historical_date string, prediction_date string, prediction_mode string")
    columns = ["news_article_count", "news_avg_sentiment"]
    news = spark.createDataFrame([("2026-01-06", "A", "NSE", "pre_market", "fresh_news", 2, 0.5)],
                                 f"date string, ticker string, exchange string, prediction_mode string, {N.STATE} string, {columns[0]} int, {columns[1]} double")
    assert G.join_news(price, news, tuple(columns)).collect()[0]["news_article_count"] == 2
    with pytest.raises(Exception, match="news rows: duplicate_key"):
        G.join_news(price, news.unionByName(news), tuple(columns)).select("news_avg_sentiment").collect()


def test_baseline_partner_is_required(spark):
    from tidemark.operators import evaluation as EV

    frame = spark.createDataFrame([(1, 1), (0, 1), (1, None)], "target_next_day_direction int, baseline_label int")
    for i, message in ((0, None), (1, "label_mismatch"), (2, "unmatched")):
        one = frame.where(["baseline_label = target_next_day_direction", "target_next_day_direction = 0", "baseline_label IS NULL"][i])
        checked = C.guarded(one, EV.alignment_rules(), "baseline rows")
        if message:
            with pytest.raises(Exception, match=message):
                checked.collect()
        else:
            assert checked.count() == 1
