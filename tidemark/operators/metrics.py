"""Classification metrics as aggregates; one row per group, any number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running_sums, unit_levels

# Probability clip of the log-loss, machine epsilon of a double.
EPSILON = 2.220446049250313e-16
THRESHOLDS = tuple(step / 100.0 for step in range(30, 71))
# Metric order and the direction in which a metric improves.
METRIC_ORDER = ("accuracy", "precision", "recall", "f1", "roc_auc", "log_loss", "brier_score")
LOWER_IS_BETTER = ("log_loss", "brier_score")


def row_log_loss(label: Column, p: Column, clip: float = EPSILON) -> Column:
    bounded = F.least(F.greatest(p, F.lit(clip)), F.lit(1.0 - clip))
    return -F.when(label == 1, F.ln(bounded)).otherwise(F.ln(1.0 - bounded))


def ratio(top: Column, bottom: Column) -> Column:
    """0 on zero division."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def roc_auc(df: DataFrame, keys: list[str], label: str, score: str, weight: tuple[str, str] | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve per group; null when a class is missing.

    Equal scores are combined first, then ranked by running sums, so neither a frequent
    score nor a hot group is gathered. `weight` names (positives, negatives) columns
    when the rows are already counted.
    """
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)) if weight is None else F.sum(weight[0])
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)) if weight is None else F.sum(weight[1])
    tied = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_score")).agg(
        pos.alias("_pos"), neg.alias("_neg"))
    ranked = running_sums(tied, keys, [F.col("_score")], unit_levels(F.col("_score")), {"_below": F.col("_neg")})
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return ranked.groupBy(*keys).agg(
        F.when((F.sum("_pos") > 0) & (F.sum("_neg") > 0), area / (F.sum("_pos") * F.sum("_neg"))).alias("roc_auc"))


def count_sums(label: Column, predicted: Column) -> dict[str, Column]:
    """Additive counts behind accuracy, precision, recall and F1."""
    return {
        "row_count": F.lit(1).cast("long"),
        "true_positive": ((label == 1) & (predicted == 1)).cast("long"),
        "false_positive": ((label == 0) & (predicted == 1)).cast("long"),
        "false_negative": ((label == 1) & (predicted == 0)).cast("long"),
        "true_negative": ((label == 0) & (predicted == 0)).cast("long"),
    }


def score_sums(label: Column, p: Column, prefix: str = "") -> dict[str, Column]:
    """Additive sums behind log-loss and Brier score, and the count of missing scores."""
    return {
        f"{prefix}missing": p.isNull().cast("long"),
        f"{prefix}log_loss_sum": F.coalesce(row_log_loss(label, p), F.lit(0.0)),
        f"{prefix}brier_sum": F.coalesce(F.pow(p - label, 2.0), F.lit(0.0)),
    }


def finish_counts() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    n = F.col("row_count")
    # An empty group has no scores at all, not zero scores.
    return {
        "target_positive_count": tp + fn,
        "target_negative_count": tn + fp,
        "predicted_positive_count": tp + fp,
        "predicted_negative_count": tn + fn,
        "accuracy": F.when(n > 0, (tp + tn) / n),
        "precision": F.when(n > 0, ratio(tp, tp + fp)),
        "recall": F.when(n > 0, ratio(tp, tp + fn)),
        "f1": F.when(n > 0, ratio(2 * tp, 2 * tp + fp + fn)),
    }


def finish_scores(prefix: str = "", gate: Column | None = None) -> dict[str, Column]:
    """Log-loss and Brier score; null when a score is missing or a class is absent."""
    n = F.col("row_count")
    both = (F.col("true_positive") + F.col("false_negative") > 0) & (
        F.col("true_negative") + F.col("false_positive") > 0)
    usable = (F.col(f"{prefix}missing") == 0) & both
    if gate is not None:
        usable = usable & gate
    return {
        f"{prefix}log_loss": F.when(usable, F.col(f"{prefix}log_loss_sum") / n),
        f"{prefix}brier_score": F.when(usable, F.col(f"{prefix}brier_sum") / n),
        f"{prefix}usable": usable,
    }


def prediction_metrics(df: DataFrame, keys: list[str], label: str, predicted: str, date: str,
                       probability: str | None = None, raw_probability: str | None = None) -> DataFrame:
    """Counts, accuracy family, AUC, log-loss and Brier score per group."""
    y = F.col(label)
    sums = count_sums(y, F.col(predicted))
    scored = {"": probability, "raw_": raw_probability}
    for prefix, c in scored.items():
        if c:
            sums |= score_sums(y, F.col(c), prefix)
    out = df.groupBy(*keys).agg(
        F.min(date).alias("date_start"), F.max(date).alias("date_end"),
        *[F.sum(v).alias(k) for k, v in sums.items()])
    out = out.withColumns(finish_counts())
    if probability:
        out = out.withColumns(finish_scores())
        out = out.withColumn("has_probability_scores", F.col("missing") == 0)
        auc = roc_auc(df, keys, label, probability)
        out = out.join(auc, keys, "left").withColumn("roc_auc", F.when(F.col("usable"), F.col("roc_auc")))
        if raw_probability:
            out = out.withColumns(finish_scores("raw_", F.col("usable")))
            raw = roc_auc(df, keys, label, raw_probability).withColumnRenamed("roc_auc", "raw_roc_auc")
            out = out.join(raw, keys, "left").withColumn(
                "raw_roc_auc", F.when(F.col("raw_usable"), F.col("raw_roc_auc")))
    else:
        out = out.withColumn("has_probability_scores", F.lit(False))
        out = out.withColumns({m: F.lit(None).cast("double") for m in ("roc_auc", "log_loss", "brier_score")})
    drop = [c for p in ("", "raw_") for c in (f"{p}missing", f"{p}log_loss_sum", f"{p}brier_sum", f"{p}usable")]
    return out.drop(*drop)


def bin_edges(bins: int) -> list[float]:
    """Evenly spaced edges as doubles; 3 * 0.1 is 0.30000000000000004, and a score is compared with that."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def calibration_bins(df: DataFrame, keys: list[str], label: str, probability: str, bins: int = 10) -> DataFrame:
    """Non-empty right-closed bins; 0 belongs to the first bin."""
    p = F.col(probability)
    below = F.size(F.filter(F.array(*[F.lit(e) for e in bin_edges(bins)]), lambda e: e < p))
    bin_index = F.when(p == 0, 0).when(p.between(0.0, 1.0), below - 1)
    return (
        df.withColumn("bin_index", bin_index).where("bin_index is not null")
        .groupBy(*keys, "bin_index").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg(probability).alias("avg_probability"),
            F.avg(F.col(label).cast("double")).alias("actual_frequency"))
        .withColumns({"bin_start": F.col("bin_index") / float(bins), "bin_end": (F.col("bin_index") + 1) / float(bins)})
    )


def best_threshold(df: DataFrame, keys: list[str], label: str, probability: str) -> DataFrame:
    """Threshold of the fixed grid with the highest F1; the lowest one wins a tie.

    Rows are counted by how many grid values they reach, 42 counts per group; the F1 of
    every threshold follows from suffix sums of those counts.
    """
    grid = F.array(*[F.lit(t) for t in THRESHOLDS])
    reached = F.size(F.filter(grid, lambda t: t <= F.col(probability)))
    counts = df.groupBy(*keys, reached.alias("reached")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    per = counts.groupBy(*keys).agg(
        F.collect_list(F.struct("reached", "pos", "neg")).alias("c"), F.sum("pos").alias("all_pos"))

    def passed(i: Column, field: str) -> Column:
        kept = F.filter(F.col("c"), lambda x: x["reached"] > i)
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    grid_rows = per.select(
        *keys, "all_pos", "c", F.posexplode(grid).alias("i", "threshold"))
    tp, fp = passed(F.col("i"), "pos"), passed(F.col("i"), "neg")
    f1 = ratio(2.0 * tp, tp + fp + F.col("all_pos"))
    return grid_rows.withColumn("f1", f1).groupBy(*keys).agg(
        F.max(F.struct("f1", (-F.col("threshold")).alias("minus"))).alias("best")
    ).select(*keys, (-F.col("best.minus")).alias("threshold"), F.col("best.f1").alias("f1"))


def best_blend(df: DataFrame, keys: list[str], label: str, baseline: str, enhanced: str, steps: int = 21) -> DataFrame:
    """Blend weight with the lowest log-loss, first minimum wins; all steps in one aggregate."""
    step = 1.0 / (steps - 1)
    alphas = [1.0 if i == steps - 1 else i * step for i in range(steps)]
    y = F.col(label)
    losses = F.array(*[
        F.avg(row_log_loss(y, (1.0 - a) * F.col(baseline) + a * F.col(enhanced), 1e-7)) for a in alphas])
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"), losses.alias("losses"))
    fit = (F.col("n") >= 4) & (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    best = F.array_min("losses")
    at = F.array_position("losses", best).cast("int")
    return out.select(
        *keys,
        F.when(fit, "fitted").otherwise("insufficient_data").alias("status"),
        F.when(fit, F.element_at(F.array(*[F.lit(a) for a in alphas]), at)).otherwise(0.5).alias("best_alpha"),
        F.when(fit, best).alias("best_log_loss"),
    )


def balanced_weights(df: DataFrame, keys: list[str], label: str, name: str = "class_weight") -> DataFrame:
    """Weight n / (2 * n_class) per row; counts come from a groupBy of two rows per group."""
    per_class = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    weights = per_class.select(
        *keys, label, (F.sum("_nc").over(w) / (2.0 * F.col("_nc"))).alias(name))
    return df.join(weights, [*keys, label])


def compare_metrics(long_metrics: DataFrame, keys: list[str], materiality: float) -> DataFrame:
    """Improved, worsened or unchanged per metric; `long_metrics` has metric, enhanced, baseline."""
    delta = F.col("enhanced") - F.col("baseline")
    gain = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -delta).otherwise(delta)
    return long_metrics.select(
        *keys, "metric", delta.alias("delta"),
        F.when(delta.isNull(), None).when(gain >= materiality, "improved").when(gain <= -materiality, "worsened")
        .otherwise("unchanged").alias("verdict"),
    )
