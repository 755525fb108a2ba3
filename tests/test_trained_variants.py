"""The trained variants: every column, lag and mode, calibrated baseline and enhanced, plain ablations, and the comparison."""

import pytest

from tidemark.operators import evaluation as EV
from tidemark.operators import merge as G
from tidemark.operators import news_features as N
from tidemark.operators.merge import MERGE_KEYS
from tidemark.plans import training
from tidemark.queries import model_queries as Q
from tidemark.settings import MODES, NewsSettings, PriceSettings


@pytest.fixture
def calls(spark, monkeypatch):
    """What the query asks of the steps it is made of, which are not run."""
    seen = {"merged": [], "baseline": [], "enhanced": [], "ablations": [], "compared": []}
    rows = spark.createDataFrame([], ", ".join(f"{k} string" for k in MERGE_KEYS))

    def noted(name, result, *picked):
        return lambda *a, **kw: (seen[name].append([a[i] for i in picked] + list(kw.values())), result)[1]

    monkeypatch.setattr(Q, "price_rows", lambda *a: rows)
    monkeypatch.setattr(Q, "merged", lambda _spark, _sf, settings=None, price=None, spec=None: (
        seen["merged"].append((settings or NewsSettings(), spec)), rows)[1])
    monkeypatch.setattr(training, "train_baseline", noted("baseline", "b", 1, 2))
    monkeypatch.setattr(training, "train", noted("baseline", "b", 1, 2))
    monkeypatch.setattr(training, "train_enhanced", noted("enhanced", "e", 1, 2, 3))
    monkeypatch.setattr(training, "ablation_scores", noted("ablations", rows, 1, 2, 3))
    monkeypatch.setattr(training, "compare", noted("compared", rows, 0, 1))
    monkeypatch.setattr(EV, "comparison_summary", lambda _: spark.createDataFrame(
        [(m, 7) for m in MODES], "prediction_mode string, row_count long"))
    monkeypatch.setattr(training, "evaluate", lambda *a: (None, spark.createDataFrame(
        [(m, "all_rows") for m in MODES], "prediction_mode string, subset_name string")))
    seen["out"] = sorted(tuple(r) for r in Q.trained_variants(spark, "").collect())
    return seen


def test_models_see_every_column_and_are_calibrated(calls):
    price, spec = PriceSettings().feature_columns, G.default_spec()
    (features, s), = calls["baseline"]
    assert features == price and s.calibrate and s.logistic_max_iter == 1000
    assert {(f, m) for f, m, _ in calls["enhanced"]} == {(spec.all, m) for m in MODES}
    assert all(s.calibrate for _, _, s in calls["enhanced"])
    assert set(N.NEWS_COLUMNS) | {f"{c}_lag{k}" for c in N.NEWS_COLUMNS for k in (1, 2)} <= set(spec.all)


def test_each_ablation_is_trained_for_each_mode(calls):
    spec = G.default_spec()
    wanted = {EV.SENTIMENT_ONLY, EV.EVENTS_ONLY, EV.NO_CONFIDENCE, EV.NO_FALLBACK}
    columns = [training.ablation_columns(v, spec.price, spec.extended_news) for v in wanted]
    assert sorted((c, m) for c, m, _ in calls["ablations"]) == sorted((c, m) for c in columns for m in MODES)
    # The lags of event counts are event counts.
    assert "news_event_count_earnings_lag2" in training.ablation_columns(EV.EVENTS_ONLY, spec.price, spec.extended_news)
    assert [spec for _, spec in calls["merged"]] == [spec] * 3
    assert [(s.use_confidence, set(s.quality_weights.values()) == {1.0}) for s, _ in calls["merged"]] == [
        (True, False), (False, False), (True, True)]


def test_the_comparison_is_part_of_the_table(calls):
    assert calls["compared"] == [["e", "b"]] * len(MODES)
    assert calls["out"] == [(m, "all_rows", 7) for m in sorted(MODES)]


def test_side_by_side_keeps_names_and_raises(spark):
    assert training.side_by_side(spark, {i: (lambda i=i: spark.range(i).count()) for i in range(12)}) == {i: i for i in range(12)}
    with pytest.raises(ValueError, match="no rows"):
        training.side_by_side(spark, {"a": lambda: 1, "b": lambda: (_ for _ in ()).throw(ValueError("no rows"))})
