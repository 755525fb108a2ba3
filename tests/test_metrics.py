import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.functions import decisions as D
from tidemark.operators import evaluation as EV
from tidemark.operators import metrics as M
from tidemark.operators import models as L
from tidemark.operators.price_features import LABEL
from tidemark.operators.running import positions, running_sums, time_levels, unit_levels

SMALL = "g string, d date, target_next_day_direction int, pred int, p double"


def small(spark, labels, preds, probs):
    return spark.createDataFrame(
        [("x", None, y, q, p) for y, q, p in zip(labels, preds, probs)], SMALL).withColumn("d", F.lit("2026-01-05").cast("date"))


def test_golden_metrics(spark):
    r = rows(M.prediction_metrics(small(spark, [0, 1, 1, 0], [0, 1, 0, 0], [.1, .9, .4, .2]), ["g"], LABEL, "pred", "d", "p"))[0]
    assert (r["accuracy"], r["precision"], r["recall"], r["roc_auc"]) == (.75, 1.0, .5, 1.0)
    assert r["f1"] == pytest.approx(2 / 3)
    assert (r["true_negative"], r["false_positive"], r["false_negative"], r["true_positive"]) == (2, 0, 1, 1)


def test_scores_are_null_on_one_class_or_missing_probability(spark):
    one = rows(M.prediction_metrics(small(spark, [1, 1], [1, 0], [.9, .2]), ["g"], LABEL, "pred", "d", "p"))[0]
    gap = rows(M.prediction_metrics(small(spark, [1, 0], [1, 0], [.9, None]), ["g"], LABEL, "pred", "d", "p"))[0]
    for r in (one, gap):
        assert r["roc_auc"] is None and r["log_loss"] is None and r["brier_score"] is None
    assert one["has_probability_scores"] and not gap["has_probability_scores"]


def test_calibration_bin_edges(spark):
    df = small(spark, [1, 1, 0, 0, 1], [1] * 5, [.9, .8, .1, .2, .85])
    bins = {r["bin_index"]: r for r in rows(M.calibration_bins(df, ["g"], LABEL, "p"))}
    # Ten bins: 0.1 is in bin 0, 0.2 in bin 1, 0.8 in bin 7, 0.85 and 0.9 in bin 8.
    assert {k: v["row_count"] for k, v in bins.items()} == {0: 1, 1: 1, 7: 1, 8: 2}
    five = {r["bin_index"]: (r["row_count"], r["actual_frequency"]) for r in rows(M.calibration_bins(df, ["g"], LABEL, "p", 5))}
    assert five == {0: (2, 0.0), 3: (1, 1.0), 4: (2, 1.0)}
    odd = rows(M.calibration_bins(small(spark, [1, 0], [1, 1], [0.1 + 0.2, 0.0]), ["g"], LABEL, "p"), "bin_index")
    assert [r["bin_index"] for r in odd] == [0, 2]


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_against_pairs_with_ties_and_close_scores(spark):
    rng = random.Random(2)
    made = [("hot", rng.random() < 0.4, 0.5 + rng.randint(0, 400) * 1e-9) for _ in range(600)]
    made += [("flat", rng.random() < 0.4, rng.choice([0.2, 0.4, 1.0, 0.0])) for _ in range(200)]
    df = spark.createDataFrame([(g, int(y), p) for g, y, p in made], "g string, y int, p double")
    got = {r["g"]: r["roc_auc"] for r in rows(M.roc_auc(df, ["g"], "y", "p"))}
    for g in ("hot", "flat"):
        assert got[g] == pytest.approx(brute_auc([(y, p) for h, y, p in made if h == g]))


def test_running_sums_and_positions(spark):
    rng = random.Random(4)
    made = [("a" if rng.random() < 0.8 else "b", rng.random(), rng.randint(1, 9), i) for i in range(500)]
    df = spark.createDataFrame(made, "g string, x double, w int, i int")
    got = {r["i"]: r["s"] for r in rows(running_sums(df, ["g"], [F.col("x")], unit_levels(F.col("x")), {"s": F.col("w")}))}
    for g, x, _, i in made:
        assert got[i] == sum(w2 for g2, x2, w2, _ in made if g2 == g and x2 < x)
    timed = df.withColumn("t", F.timestamp_seconds((F.col("x") * 1000).cast("long")))
    ranked = rows(positions(timed, ["g"], [F.col("t"), F.col("i")], time_levels(F.col("t")), "n"))
    for g in ("a", "b"):
        part = sorted((r for r in ranked if r["g"] == g), key=lambda r: (r["t"], r["i"]))
        assert [r["n"] for r in part] == list(range(1, len(part) + 1))


def test_threshold_and_blend_search(spark):
    rng = random.Random(9)
    made = [("x", rng.random() < 0.5, rng.random(), rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(g, int(y), a, b) for g, y, a, b in made], "g string, target_next_day_direction int, p double, q double")

    def f1(t):
        tp = sum(y and p >= t for _, y, p, _ in made)
        wrong = sum((p >= t) != y for _, y, p, _ in made)
        return 2 * tp / (2 * tp + wrong)

    best = max(M.THRESHOLDS, key=lambda t: (f1(t), -t))
    got = rows(M.best_threshold(df, ["g"], LABEL, "p"))[0]
    assert got["threshold"] == best and got["f1"] == pytest.approx(f1(best))
    assert rows(M.best_blend(df, ["g"], LABEL, "p", "q"))[0]["status"] == "fitted"
    tiny = rows(M.best_blend(df.limit(3), ["g"], LABEL, "p", "q"))[0]
    assert (tiny["status"], tiny["best_alpha"]) == ("insufficient_data", 0.5)


def test_evidence_tie_note(spark):
    def row(variant, value):
        return ("pre_market", "all_rows", variant, 12, *[value] * 7)
    df = spark.createDataFrame([row(EV.ENHANCED, 0.51), row(EV.BASELINE, 0.50)],
                               "prediction_mode string, subset_name string, model_variant string, row_count long, " + ", ".join(
                                   f"{m} double" for m in M.METRIC_ORDER))
    r = rows(EV.evidence(df))[0]
    assert r["unchanged_metrics"] == list(M.METRIC_ORDER) and "effectively tied at the 0.02" in r["note"]
    moved = df.withColumn("log_loss", F.when(F.col("model_variant") == EV.ENHANCED, 0.4).otherwise(F.col("log_loss")))
    assert rows(EV.evidence(moved))[0]["improved_metrics"] == ["log_loss"]


def test_news_weight_and_decision(spark):
    one = spark.range(1)

    def weight(n, conf, fresh, heavy, carried):
        return rows(one.select(D.news_context_weight(*[F.lit(v) for v in (n, conf, fresh, heavy, carried)]).alias("w")))[0]["w"]

    assert weight(0, 0.9, 0, 0, 0) == 0.0
    assert weight(3, 1.0, 1, 0, 0) == pytest.approx(0.8)
    assert weight(3, 1.0, 1, 1, 0) == pytest.approx(0.48)
    assert weight(0, 1.0, 0, 0, 1) == pytest.approx(0.12)

    def decide(p, state, quality=80.0):
        return rows(one.select(D.selective_decision(F.lit(p), 0.5, F.lit(state), F.lit(quality)).alias("d")))[0]["d"]

    assert decide(0.6, "fresh_news").action == "up" and decide(0.4, "fresh_news").action == "down"
    assert decide(0.56, "carried_forward_only").reasons == ["low_conviction_margin", "carried_forward_only"]
    assert decide(0.9, "fallback_heavy").reasons == ["fallback_heavy"]
    assert decide(0.9, "fresh_news", 10.0).reasons == ["data_quality_below_floor"]


def test_data_quality_limits_and_grade(spark):
    q = rows(spark.range(1).select(D.data_quality(
        F.lit("zero_news"), F.lit(0), F.lit(0.0), gap_count=F.lit(9), synthetic=F.lit(True)).alias("q")))[0]["q"]
    assert q.market_data == 65.0 and q.source_coverage == 40.0 and q.extraction_quality == 70.0 and q.signal_state == 50.0
    assert q.score == pytest.approx(54.8, abs=0.06) and q.grade == "E" and len(q.reasons) == 6


def test_logistic_fit_matches_closed_objective(spark):
    """The regularization of the linear model is that of C times the summed loss plus |w|^2 / 2."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(int(l), float(a), float(b)) for l, (a, b) in zip(y, x)], f"{LABEL} int, a double, b double")
    from tidemark.settings import ModelSettings

    model = L.fit_classifier(df, ("a", "b"), ModelSettings(model_type="logistic_regression", logistic_c=0.05, balanced_weights=False))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.05 * ((z.T @ (p - y)) / 400 + w / (0.05 * 400))
        b -= 0.05 * (p - y).mean()
    assert np.allclose(model.estimator.coefficients.toArray(), w, atol=1e-3)


def test_calibrators_and_model_roundtrip(spark, tmp_path):
    from tidemark.settings import ModelSettings

    rng = random.Random(3)
    made = [(int(rng.random() < 0.2 + 0.6 * (i % 10) / 10), (i % 10) / 10.0, f"2026-01-{1 + i // 20:02d}", i) for i in range(400)]
    df = spark.createDataFrame(made, f"{LABEL} int, x double, d string, i int").withColumn("d", F.col("d").cast("date"))
    model = L.fit_classifier(df, ("x",), ModelSettings(model_type="logistic_regression"))
    raw = model.score(df).withColumn("_all", F.lit(0))
    folded = L.fold_of_rows(raw, ["_all"], "d", ["i"])
    assert {r["fold"]: r["count"] for r in rows(folded.groupBy("fold").count())} == {0: 100, 1: 100, 2: 100, 3: 100}
    calibrator, info = L.choose_calibrator(folded)
    assert info["status"] == "fitted" and info["selected"] in ("isotonic", "sigmoid")
    assert set(info["folds"]) == {"isotonic", "sigmoid"}
    iso = L.fit_isotonic(raw).apply(raw, L.RAW).select(L.CALIBRATED).distinct().orderBy(L.CALIBRATED)
    assert all(0.0 <= r[0] <= 1.0 for r in iso.collect())
    from dataclasses import replace

    full = replace(model, calibrator=calibrator, threshold=0.41)
    full.save(spark, str(tmp_path / "m"))
    back = L.Classifier.load(spark, str(tmp_path / "m"))
    assert back.threshold == 0.41 and back.features == ("x",)
    a = [r[0] for r in full.score(df).orderBy("i").select(L.CALIBRATED).collect()]
    b = [r[0] for r in back.score(df).orderBy("i").select(L.CALIBRATED).collect()]
    assert a == pytest.approx(b)
    none, reason = L.choose_calibrator(raw.limit(5))
    assert none is None and reason["status"] == "insufficient_validation_data"
