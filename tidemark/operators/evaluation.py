"""Held-out evaluation: aligned frames, variants, subsets and the metric table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.functions import vocab as V
from tidemark.operators import metrics as M
from tidemark.operators.contracts import guarded, one_row_per_key
from tidemark.operators.merge import MERGE_KEYS
from tidemark.operators.news_features import signal_state
from tidemark.operators.price_features import LABEL
from tidemark.operators.running import running_sums, unit_levels
from tidemark.settings import KEYS, EvaluationSettings, PilotSettings

# Names of the compared variants.
BASELINE, ENHANCED, BLENDED = "baseline_historical_only", "enhanced_full", "blended_enhanced"
MAJORITY, PREVIOUS_DAY = "naive_majority_class", "naive_previous_day_direction"
SENTIMENT_ONLY, EVENTS_ONLY = "ablation_sentiment_only", "ablation_event_counts_only"
NO_CONFIDENCE, NO_FALLBACK = "ablation_full_without_confidence", "ablation_full_without_fallback_penalties"
VARIANTS = (BASELINE, ENHANCED, BLENDED, MAJORITY, PREVIOUS_DAY, SENTIMENT_ONLY, EVENTS_ONLY,
            NO_CONFIDENCE, NO_FALLBACK)
# Variants that give a label but no probability.
LABEL_ONLY = (PREVIOUS_DAY,)

CONTEXT = (
    "news_article_count", "news_fallback_article_ratio", "news_warning_article_count",
    "news_weighted_sentiment_score", "news_avg_confidence", "has_fresh_news",
    "is_carried_forward", "is_fallback_heavy",
)
PRICE_KEYS = ("historical_date", "prediction_date", *KEYS)

# News columns of the sentiment ablation and columns the no-confidence one drops.
SENTIMENT_COLUMNS = (
    "news_avg_sentiment", "news_bullish_article_count", "news_bearish_article_count",
    "news_neutral_article_count", "news_weighted_sentiment_score",
    "news_weighted_bullish_score", "news_weighted_bearish_score",
)
CONFIDENCE_COLUMNS = ("news_avg_confidence", "news_weighted_confidence_score")


def subset_rules() -> dict[str, Column]:
    """Membership of each named row subset."""
    state = F.col("news_signal_state")
    good = F.col("data_quality_grade").isin("A", "B")
    return {
        "all_rows": F.lit(True),
        "news_heavy_rows": F.col("news_heavy_flag"),
        "zero_news_rows": state == V.ZERO,
        "fresh_news_rows": state == V.FRESH,
        "no_fresh_news_rows": state != V.FRESH,
        "carried_forward_rows": state == V.CARRIED,
        "not_carried_forward_rows": state != V.CARRIED,
        "fallback_heavy_rows": state == V.FALLBACK,
        "not_fallback_heavy_rows": state != V.FALLBACK,
        "has_news_rows": F.col("news_article_count") > 0,
        "abstain_eliminated_rows": ~F.col("abstain_flag"),
        "high_confidence_rows": F.col("high_confidence_flag"),
        "quality_grade_a_or_b_rows": good,
        "quality_grade_c_or_worse_rows": ~good,
    }


SUBSETS = (
    "all_rows", "news_heavy_rows", "zero_news_rows", "fresh_news_rows", "no_fresh_news_rows",
    "carried_forward_rows", "not_carried_forward_rows", "fallback_heavy_rows",
    "not_fallback_heavy_rows", "has_news_rows", "abstain_eliminated_rows",
    "high_confidence_rows", "quality_grade_a_or_b_rows", "quality_grade_c_or_worse_rows",
)


def align_baseline(enhanced: DataFrame, baseline: DataFrame) -> DataFrame:
    """Left-join baseline test rows onto enhanced test rows, keeping both labels."""
    side = baseline.where("split = 'test'").select(
        F.col("date").alias("historical_date"), F.col("target_date").alias("prediction_date"), *KEYS,
        F.col(LABEL).alias("baseline_label"),
        F.col("predicted_next_day_direction").alias(f"{BASELINE}_predicted_next_day_direction"),
        F.col("raw_predicted_probability_up").alias(f"{BASELINE}_raw_predicted_probability_up"),
        F.col("calibrated_predicted_probability_up").alias(f"{BASELINE}_predicted_probability_up"),
    )
    left = enhanced.where("split = 'test'").select(
        *MERGE_KEYS, LABEL, *CONTEXT,
        F.col("predicted_next_day_direction").alias(f"{ENHANCED}_predicted_next_day_direction"),
        F.col("raw_predicted_probability_up").alias(f"{ENHANCED}_raw_predicted_probability_up"),
        F.col("calibrated_predicted_probability_up").alias(f"{ENHANCED}_predicted_probability_up"),
    )
    return left.join(one_row_per_key(side, list(PRICE_KEYS), "baseline rows"), list(PRICE_KEYS), "left")


def alignment_rules() -> dict:
    """What a row without exactly its own baseline partner breaks."""
    return {"unmatched": F.col("baseline_label").isNull(), "label_mismatch": F.col("baseline_label") != F.col(LABEL)}


def alignment_violations(aligned: DataFrame) -> DataFrame:
    """Per mode: rows, rows without a baseline partner, rows whose labels disagree."""
    return aligned.groupBy("prediction_mode").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("baseline_label").isNull()).alias("unmatched_count"),
        F.count_if(F.col("baseline_label") != F.col(LABEL)).alias("label_mismatch_count"),
    )


def align_candidate(reference: DataFrame, candidate: DataFrame, columns: list[str]) -> DataFrame:
    """Candidate columns for the reference rows on the five-part key."""
    side = candidate.select(*MERGE_KEYS, F.col(LABEL).alias("candidate_label"), *columns)
    return reference.select(*MERGE_KEYS, LABEL).join(side, list(MERGE_KEYS), "left")


def candidate_violations(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("prediction_mode").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("candidate_label").isNull()).alias("unmatched_count"),
        F.count_if(F.col("candidate_label") != F.col(LABEL)).alias("label_mismatch_count"),
    )


def evaluation_frame(enhanced: DataFrame, baseline: DataFrame, threshold: float = 0.5,
                     s: PilotSettings = PilotSettings(), e: EvaluationSettings = EvaluationSettings()) -> DataFrame:
    """One wide row per held-out (session, mode) with blend, quality and decision.

    The blend is labelled at 0.5 here. Content quality and gap counts are not part of
    this frame, so they count as absent in the quality score.
    """
    joined = guarded(align_baseline(enhanced, baseline), alignment_rules(), "baseline rows").drop("baseline_label")
    weight = D.news_context_weight(
        "news_article_count", "news_avg_confidence", "has_fresh_news", "is_fallback_heavy", "is_carried_forward")
    out = joined.withColumn("news_context_weight", weight)
    blended = {
        f"{BLENDED}_{kind}": D.blend(F.col(f"{BASELINE}_{kind}"), F.col(f"{ENHANCED}_{kind}"), F.col("news_context_weight"))
        for kind in ("raw_predicted_probability_up", "predicted_probability_up")
    }
    out = out.withColumns({
        **blended,
        "news_heavy_flag": F.col("news_article_count") >= e.news_heavy_min_articles,
        "zero_news_flag": F.col("news_article_count") == 0,
        "degraded_news_context": F.lit(0),
    }).withColumn("news_signal_state", signal_state()).drop("degraded_news_context")
    p = F.col(f"{BLENDED}_predicted_probability_up")
    out = out.withColumn("_quality", D.data_quality(
        F.col("news_signal_state"), F.col("news_article_count"), F.col("news_avg_confidence")))
    out = out.withColumn("_decision", D.selective_decision(
        p, threshold, F.col("news_signal_state"), F.col("_quality.score"), s))
    return out.withColumns({
        f"{BLENDED}_predicted_next_day_direction": (p >= 0.5).cast("int"),
        "data_quality_score": F.col("_quality.score"),
        "data_quality_grade": F.col("_quality.grade"),
        "blended_selective_action": F.col("_decision.action"),
        "abstain_flag": F.col("_decision.abstain"),
        "selective_probability_margin": F.col("_decision.margin"),
        "selective_required_margin": F.col("_decision.required_margin"),
        "abstain_reasons": F.col("_decision.reasons"),
        "high_confidence_flag": F.col("_decision.margin")
        >= F.greatest(F.col("_decision.required_margin"), F.lit(s.high_confidence_margin)),
    }).drop("_quality", "_decision")


def majority_rate(train: DataFrame) -> DataFrame:
    """Positive rate of the training rows per mode, the majority-class predictor."""
    return train.groupBy("prediction_mode").agg(F.avg(F.col(LABEL).cast("double")).alias("positive_rate"))


def add_majority(frame: DataFrame, train: DataFrame) -> DataFrame:
    # One row per mode.
    return frame.join(F.broadcast(majority_rate(train)), "prediction_mode", "left").withColumns({
        f"{MAJORITY}_predicted_next_day_direction": (F.col("positive_rate") >= 0.5).cast("int"),
        f"{MAJORITY}_predicted_probability_up": F.col("positive_rate"),
    }).drop("positive_rate")


def add_previous_day(frame: DataFrame, test_rows: DataFrame) -> DataFrame:
    side = test_rows.select(*MERGE_KEYS, (F.col("ret_1d") >= 0).cast("int").alias(f"{PREVIOUS_DAY}_predicted_next_day_direction"))
    return frame.join(side, list(MERGE_KEYS), "left")


def add_variant(frame: DataFrame, scored: DataFrame, variant: str) -> DataFrame:
    """Attach the scored rows of a trained variant under its name."""
    side = scored.select(
        *MERGE_KEYS,
        F.col("predicted_next_day_direction").alias(f"{variant}_predicted_next_day_direction"),
        F.col("raw_predicted_probability_up").alias(f"{variant}_raw_predicted_probability_up"),
        F.col("calibrated_predicted_probability_up").alias(f"{variant}_predicted_probability_up"))
    return frame.join(side, list(MERGE_KEYS), "left")


def metric_table(frame: DataFrame, modes: tuple[str, ...], variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """Metrics of every mode, subset and variant.

    A row's subset memberships form one bit mask. Rows are first aggregated per (mode,
    mask) with the sums of all variants side by side, so each row is read once and never
    multiplied; only the few mask rows are then spread over the subsets. The exact AUC is
    ranked over distinct scores.
    """
    rules = subset_rules()
    mask = reduce(lambda a, b: a + b, [
        F.when(F.coalesce(rules[name], F.lit(False)), 2**i).otherwise(0) for i, name in enumerate(SUBSETS)])
    y = F.col(LABEL)
    base = frame.withColumn("_mask", mask)
    have = set(frame.columns)

    def col(variant: str, kind: str) -> Column:
        name = f"{variant}_{kind}"
        return F.col(name) if name in have else F.lit(None).cast("double")

    def sums(variant: str) -> dict[str, Column]:
        return {
            **M.count_sums(y, col(variant, "predicted_next_day_direction")),
            **M.score_sums(y, col(variant, "predicted_probability_up")),
            **M.score_sums(y, col(variant, "raw_predicted_probability_up"), "raw_"),
        }

    names = list(sums(variants[0]))
    wide = base.groupBy("prediction_mode", "_mask").agg(
        F.min("prediction_date").alias("date_start"), F.max("prediction_date").alias("date_end"),
        F.sum(F.col("abstain_flag").cast("long")).alias("abstained_row_count"),
        *[F.sum(expr).alias(f"{v}__{n}") for v in variants for n, expr in sums(v).items()])
    by_variant = wide.withColumn("_v", F.explode(F.array(*[
        F.struct(F.lit(v).alias("model_variant"), *[F.col(f"{v}__{n}").alias(n) for n in names]) for v in variants
    ]))).select("prediction_mode", "_mask", "date_start", "date_end", "abstained_row_count", "_v.*")

    def spread(df: DataFrame) -> DataFrame:
        bits = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(2**i).alias("b")) for i, n in enumerate(SUBSETS)])
        member = F.filter(bits, lambda x: F.col("_mask").bitwiseAND(x["b"]) > 0)
        return df.withColumn("subset_name", F.explode(F.transform(member, lambda x: x["n"]))).drop("_mask")

    keys = ["prediction_mode", "subset_name", "model_variant"]
    totals = spread(by_variant).groupBy(*keys).agg(
        F.min("date_start").alias("date_start"), F.max("date_end").alias("date_end"),
        F.sum("abstained_row_count").alias("abstained_row_count"), *[F.sum(n).alias(n) for n in names])

    scores = base.select("prediction_mode", "_mask", y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(v).alias("model_variant"), F.lit(kind).alias("kind"), col(v, column).alias("score"))
        for v in variants if v not in LABEL_ONLY
        for kind, column in (("cal", "predicted_probability_up"), ("raw", "raw_predicted_probability_up"))
        if f"{v}_{column}" in have
    ])).alias("s")).select("prediction_mode", "_mask", "y", "s.*").where("score is not null")
    counted = scores.groupBy("prediction_mode", "_mask", "model_variant", "kind", "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    auc_keys = [*keys, "kind"]
    tied = spread(counted).groupBy(*auc_keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = running_sums(tied, auc_keys, [F.col("score")], unit_levels(F.col("score")), {"below": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    auc = ranked.groupBy(*auc_keys).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), area / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    auc = auc.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "cal", F.col("auc"))).alias("_auc"),
        F.max(F.when(F.col("kind") == "raw", F.col("auc"))).alias("_raw_auc"))

    grid = frame.sparkSession.createDataFrame(
        [(m, s, v) for m in modes for s in SUBSETS for v in variants], ", ".join(f"{k} string" for k in keys))
    full = grid.join(totals, keys, "left").join(auc, keys, "left").fillna(0, ["row_count", "abstained_row_count", *names[1:]])
    scored = F.col("row_count") > 0
    out = full.withColumns(M.finish_counts()).withColumns(M.finish_scores())
    out = out.withColumns(M.finish_scores("raw_", F.col("usable")))
    no_label = F.col("model_variant").isin(*LABEL_ONLY)
    return out.withColumns({
        "has_probability_scores": scored & ~no_label & (F.col("missing") == 0),
        "roc_auc": F.when(F.col("usable"), F.col("_auc")),
        "raw_roc_auc": F.when(F.col("raw_usable"), F.col("_raw_auc")),
        "selective_coverage": F.when(scored, 1.0 - F.col("abstained_row_count") / F.col("row_count")),
    }).select(
        *keys, "row_count", "date_start", "date_end", "target_positive_count", "target_negative_count",
        "predicted_positive_count", "predicted_negative_count", "true_positive", "false_positive",
        "false_negative", "true_negative", *M.METRIC_ORDER, "raw_roc_auc", "raw_log_loss", "raw_brier_score",
        "has_probability_scores", "abstained_row_count", "selective_coverage")


def evidence(table: DataFrame, materiality: float = 0.02) -> DataFrame:
    """Enhanced against baseline per mode and subset: verdict lists and the evidence note."""
    keys = ["prediction_mode", "subset_name"]
    long = table.where(F.col("model_variant").isin(BASELINE, ENHANCED)).groupBy(*keys).agg(
        F.max(F.when(F.col("model_variant") == ENHANCED, F.col("row_count"))).alias("row_count"),
        *[F.max(F.when(F.col("model_variant") == v, F.col(m))).alias(f"{m}__{side}")
          for m in M.METRIC_ORDER for v, side in ((ENHANCED, "enhanced"), (BASELINE, "baseline"))])
    verdicts = []
    for i, m in enumerate(M.METRIC_ORDER):
        delta = F.col(f"{m}__enhanced") - F.col(f"{m}__baseline")
        gain = -delta if m in M.LOWER_IS_BETTER else delta
        verdicts.append((m, delta, F.when(delta.isNull(), None).when(gain >= materiality, "improved")
                         .when(gain <= -materiality, "worsened").otherwise("unchanged")))

    def names(kind: str) -> Column:
        return F.array_compact(F.array(*[F.when(v == kind, m) for m, _, v in verdicts]))

    out = long.select(
        *keys, "row_count", *[d.alias(f"{m}_delta") for m, d, _ in verdicts],
        *[names(k).alias(f"{k}_metrics") for k in ("improved", "worsened", "unchanged")])

    def text(kind: str) -> Column:
        return F.when(F.size(f"{kind}_metrics") > 0, F.concat_ws(", ", f"{kind}_metrics")).otherwise("none")

    at = f"{materiality:.2f}"
    note = (
        F.when(F.col("row_count") == 0, F.format_string("No rows were available for the %s subset.", "subset_name"))
        .when((F.size("improved_metrics") == 0) & (F.size("worsened_metrics") == 0), F.format_string(
            f"On %d %s rows, enhanced and baseline were effectively tied at the {at} materiality threshold.",
            "row_count", "subset_name"))
        .otherwise(F.format_string(
            "On %d %s rows, enhanced improved on %s, worsened on %s, and stayed within the "
            f"{at} materiality threshold on %s.",
            "row_count", "subset_name", text("improved"), text("worsened"), text("unchanged")))
    )
    return out.withColumn("note", note)


def modes_identical(table: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Whether the modes have the same metrics in every subset and variant."""
    values = F.to_json(F.struct("row_count", *M.METRIC_ORDER, "abstained_row_count"), {"ignoreNullFields": "false"})
    per = table.groupBy("subset_name", "model_variant").agg(F.countDistinct(values).alias("n"))
    return per.agg(((F.max("n") == 1) & F.lit(len(modes) > 1)).alias("modes_identical"))


def comparison_frame(enhanced: DataFrame, baseline_scored: DataFrame, threshold: float) -> DataFrame:
    """Baseline, enhanced and blended side by side with correctness and disagreement.

    The blend is labelled at the baseline model's own threshold here.
    """
    side = baseline_scored.select(
        *MERGE_KEYS,
        F.col("predicted_next_day_direction").alias("baseline_predicted_next_day_direction"),
        F.col("raw_predicted_probability_up").alias("baseline_raw_predicted_probability_up"),
        F.col("calibrated_predicted_probability_up").alias("baseline_calibrated_predicted_probability_up"))
    out = enhanced.select(
        "split", *MERGE_KEYS, LABEL, *CONTEXT,
        F.col("predicted_next_day_direction").alias("enhanced_predicted_next_day_direction"),
        F.col("raw_predicted_probability_up").alias("enhanced_raw_predicted_probability_up"),
        F.col("calibrated_predicted_probability_up").alias("enhanced_calibrated_predicted_probability_up"),
    ).join(side, list(MERGE_KEYS))
    weight = D.news_context_weight(
        "news_article_count", "news_avg_confidence", "has_fresh_news", "is_fallback_heavy", "is_carried_forward")
    out = out.withColumn("news_context_weight", weight)
    out = out.withColumns({
        f"blended_{k}_predicted_probability_up": D.blend(
            F.col(f"baseline_{k}_predicted_probability_up"), F.col(f"enhanced_{k}_predicted_probability_up"),
            F.col("news_context_weight")) for k in ("raw", "calibrated")})
    out = out.withColumn("blended_predicted_next_day_direction",
                         (F.col("blended_calibrated_predicted_probability_up") >= threshold).cast("int"))
    return out.withColumns({
        "disagreement_flag": F.col("enhanced_predicted_next_day_direction") != F.col("baseline_predicted_next_day_direction"),
        **{f"{m}_correct": F.col(f"{m}_predicted_next_day_direction") == F.col(LABEL)
           for m in ("baseline", "enhanced", "blended")},
    })


def comparison_summary(comparison: DataFrame) -> DataFrame:
    b, e, x = (F.col(f"{m}_correct") for m in ("baseline", "enhanced", "blended"))
    d = F.col("disagreement_flag")
    return comparison.groupBy("prediction_mode").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(d).alias("disagreement_count"),
        (F.count_if(d) / F.count(F.lit(1))).alias("disagreement_rate"),
        F.count_if(e).alias("enhanced_correct_count"),
        F.count_if(b).alias("baseline_correct_count"),
        F.count_if(x).alias("blended_correct_count"),
        F.count_if(e & ~b).alias("enhanced_better_count"),
        F.count_if(b & ~e).alias("baseline_better_count"),
        F.count_if(x & ~b).alias("blended_better_than_baseline_count"),
        F.count_if(b == e).alias("tied_count"),
        F.count_if(d & (F.col("news_article_count") > 0)).alias("news_heavy_disagreement_count"),
    )
