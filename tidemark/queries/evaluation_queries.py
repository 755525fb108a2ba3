"""Evaluation: alignment, decisions, metrics, variants, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import decisions as D
from tidemark.operators import evaluation as EV
from tidemark.operators import metrics as M
from tidemark.operators import models as L
from tidemark.operators.merge import MERGE_KEYS
from tidemark.operators.price_features import LABEL
from tidemark.queries import evaluation_inputs as E
from tidemark.queries.inputs import r
from tidemark.queries.oracle import cte, rnd
from tidemark.queries.registry import query
from tidemark.settings import KEYS, MODES

ID = ", ".join(MERGE_KEYS)


def frame(spark, sf):
    return EV.evaluation_frame(E.enhanced_predictions(spark, sf), E.baseline_predictions(spark, sf))


@query("baseline_alignment", "J5", """
SELECT prediction_mode, count(*) AS row_count, count(*) FILTER (day_part % 5 = 0) AS unmatched_count,
       count(*) FILTER (day_part % 5 <> 0 AND day_part % 7 = 0) AS label_mismatch_count
FROM (SELECT *, h % 35 AS day_part FROM enh_pred WHERE split = 'test') GROUP BY prediction_mode""")
def baseline_alignment(spark, sf):
    """Baseline rows with some partners removed and some labels flipped."""
    h = F.round(F.col("raw_predicted_probability_up") * 1000).cast("long")
    enhanced = E.enhanced_predictions(spark, sf)
    part = enhanced.where("prediction_mode = 'pre_market'").select(
        F.col("historical_date").alias("date"), *KEYS, (F.col("x") % 35).alias("part"))
    base = E.baseline_predictions(spark, sf).join(part, ["date", *KEYS]).where("part % 5 <> 0").withColumn(
        LABEL, F.when(F.col("part") % 7 == 0, 1 - F.col(LABEL)).otherwise(F.col(LABEL)))
    return EV.alignment_violations(EV.align_baseline(enhanced, base))


@query("candidate_alignment", "J6", """
SELECT prediction_mode, count(*) AS row_count, count(*) FILTER (x % 11 = 0) AS unmatched_count,
       count(*) FILTER (x % 11 <> 0 AND x % 13 = 0) AS label_mismatch_count
FROM enh_pred WHERE split = 'test' GROUP BY prediction_mode""")
def candidate_alignment(spark, sf):
    reference = E.enhanced_predictions(spark, sf).where("split = 'test'")
    candidate = reference.where("x % 11 <> 0").withColumn(
        LABEL, F.when(F.col("x") % 13 == 0, 1 - F.col(LABEL)).otherwise(F.col(LABEL)))
    return EV.candidate_violations(EV.align_candidate(reference, candidate, ["raw_predicted_probability_up"]))


@query("news_weight_and_blend", "X17 X18", f"""
SELECT {ID}, {rnd('w')} AS news_context_weight, {rnd('raw_x')} AS blended_raw, {rnd('cal_x')} AS blended_calibrated
FROM evaluated WHERE split = 'test'""")
def news_weight_and_blend(spark, sf):
    return frame(spark, sf).select(
        *MERGE_KEYS, r("news_context_weight").alias("news_context_weight"),
        r(f"{EV.BLENDED}_raw_predicted_probability_up").alias("blended_raw"),
        r(f"{EV.BLENDED}_predicted_probability_up").alias("blended_calibrated"))


@query("selective_decision", "X19", f"""
SELECT {ID}, state AS news_signal_state, action, abstain, {rnd('margin')} AS margin, {rnd('required')} AS required_margin, reasons
FROM evaluated WHERE split = 'test'""")
def selective_decision(spark, sf):
    return frame(spark, sf).select(
        *MERGE_KEYS, "news_signal_state", F.col("blended_selective_action").alias("action"),
        F.col("abstain_flag").alias("abstain"), r("selective_probability_margin").alias("margin"),
        r("selective_required_margin").alias("required_margin"), F.concat_ws(",", "abstain_reasons").alias("reasons"))


_gap, _prov, _dom = "x % 6", "x % 3", "(x // 2) % 3"
cte("quality_parts", """
SELECT *, x % 6 AS gaps, x % 3 AS providers, (x // 2) % 3 AS domains, x % 7 = 0 AS degraded, x % 5 AS retries, x % 9 AS fetches,
       x % 8 AS s6_retries, x % 10 = 0 AS s6_warn, x % 13 = 0 AS s7_warn, x % 17 = 0 AS synthetic, ((x // 3) % 4) / 4.0::DOUBLE AS content
FROM ev_blend""")
cte("quality_scores", """
SELECT *, greatest(0, 100 - CASE WHEN gaps > 0 THEN least(35, 10 + gaps * 8) ELSE 0 END) AS market_data,
  greatest(0, 100 - CASE WHEN news_article_count = 0 THEN 60 WHEN news_article_count = 1 THEN 20 ELSE 0 END
    - CASE WHEN news_article_count > 0 AND providers = 1 THEN 10 ELSE 0 END - CASE WHEN news_article_count > 0 AND domains = 1 THEN 10 ELSE 0 END
    - CASE WHEN degraded THEN 10 ELSE 0 END - CASE WHEN retries > 0 THEN 5 ELSE 0 END - CASE WHEN fetches > 0 THEN 5 ELSE 0 END) AS source_coverage,
  greatest(0, 100 - CASE WHEN news_avg_confidence < 0.55 THEN 15 ELSE 0 END - CASE WHEN content < 0.75 THEN 15 ELSE 0 END
    - CASE WHEN s6_retries > 0 THEN 5 ELSE 0 END - CASE WHEN s6_warn THEN 5 ELSE 0 END) AS extraction_quality,
  greatest(0, 100 - CASE state WHEN 'fallback_heavy' THEN 55 WHEN 'carried_forward_only' THEN 25 WHEN 'zero_news' THEN 40 ELSE 0 END
    - CASE WHEN synthetic THEN 10 ELSE 0 END - CASE WHEN s7_warn THEN 5 ELSE 0 END) AS signal_state,
  array_to_string(list_slice(list_filter([
    CASE WHEN gaps > 0 THEN 'recent market-data gap fill count ' || gaps END,
    CASE WHEN news_article_count = 0 THEN 'no fresh source articles' END, CASE WHEN news_article_count = 1 THEN 'only one source article' END,
    CASE WHEN news_article_count > 0 AND providers = 1 THEN 'single news provider' END,
    CASE WHEN news_article_count > 0 AND domains = 1 THEN 'single source domain' END,
    CASE WHEN degraded THEN 'degraded stage5 source mix' END, CASE WHEN retries > 0 THEN 'stage5 provider retries' END,
    CASE WHEN fetches > 0 THEN 'stage5 article fetch retries' END,
    CASE WHEN news_avg_confidence < 0.55 THEN printf('low average extraction confidence %.2f', news_avg_confidence) END,
    CASE WHEN content < 0.75 THEN printf('low content quality score %.2f', content) END,
    CASE WHEN s6_retries > 0 THEN 'stage6 retries' END, CASE WHEN s6_warn THEN 'stage6 extraction warnings' END,
    CASE state WHEN 'fallback_heavy' THEN 'fallback-heavy news state' WHEN 'carried_forward_only' THEN 'carried-forward-only news state'
               WHEN 'zero_news' THEN 'zero-news state' END,
    CASE WHEN synthetic THEN 'synthetic zero-news Stage 7 row' END, CASE WHEN s7_warn THEN 'stage7 feature warnings' END],
    lambda x: x IS NOT NULL), 1, 6), '; ') AS reasons
FROM quality_parts""")
cte("quality_final", """
SELECT *, round_even(market_data * 0.25::DOUBLE + source_coverage * 0.30::DOUBLE + extraction_quality * 0.20::DOUBLE + signal_state * 0.25::DOUBLE, 1) AS score
FROM quality_scores""")


@query("data_quality", "X20 U5", f"""
SELECT {ID}, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D'
       WHEN score >= 50 THEN 'E' ELSE 'F' END AS grade, reasons,
       CAST(market_data AS DOUBLE) AS market_data, CAST(source_coverage AS DOUBLE) AS source_coverage,
       CAST(extraction_quality AS DOUBLE) AS extraction_quality, CAST(signal_state AS DOUBLE) AS signal_state
FROM quality_final""")
def data_quality(spark, sf):
    x = F.col("x")
    rows = E.enhanced_predictions(spark, sf).withColumn("degraded_news_context", F.lit(0))
    state = EV.signal_state()
    q = D.data_quality(
        state, F.col("news_article_count"), F.col("news_avg_confidence"),
        content_quality=(F.floor(x / 3) % 4) / 4.0, gap_count=x % 6, provider_count=x % 3,
        domain_count=F.floor(x / 2) % 3, degraded_sources=x % 7 == 0, request_retries=x % 5, fetch_retries=x % 9,
        scoring_retries=x % 8, scoring_warnings=x % 10 == 0, feature_warnings=x % 13 == 0, synthetic=x % 17 == 0)
    return rows.withColumn("q", q).select(
        *MERGE_KEYS, "q.score", "q.grade", F.concat_ws("; ", "q.reasons").alias("reasons"),
        "q.market_data", "q.source_coverage", "q.extraction_quality", "q.signal_state")


@query("evaluation_frame", "M13 J5", f"""
SELECT {ID}, y AS target_next_day_direction, pred_x AS blended_predicted_next_day_direction, quality AS data_quality_score,
       grade AS data_quality_grade, action, abstain AS abstain_flag, confident AS high_confidence_flag,
       news_article_count >= 1 AS news_heavy_flag, news_article_count = 0 AS zero_news_flag, cal_b, cal_e
FROM evaluated WHERE split = 'test'""")
def evaluation_frame(spark, sf):
    return frame(spark, sf).select(
        *MERGE_KEYS, LABEL,
        F.col(f"{EV.BLENDED}_predicted_next_day_direction").alias("blended_predicted_next_day_direction"),
        "data_quality_score", "data_quality_grade", F.col("blended_selective_action").alias("action"),
        "abstain_flag", "high_confidence_flag", "news_heavy_flag", "zero_news_flag",
        F.col(f"{EV.BASELINE}_predicted_probability_up").alias("cal_b"),
        F.col(f"{EV.ENHANCED}_predicted_probability_up").alias("cal_e"))


def _metric_sql(source: str, keys: str, y: str = "y", pred: str = "pred", p: str = "p") -> str:
    """Metrics of long rows by the rank-sum form of the AUC."""
    return f"""
SELECT {keys}, count(*) AS row_count, min(d) AS date_start, max(d) AS date_end,
  count(*) FILTER ({y} = 1 AND {pred} = 1) AS tp, count(*) FILTER ({y} = 0 AND {pred} = 1) AS fp,
  count(*) FILTER ({y} = 1 AND {pred} = 0) AS fn, count(*) FILTER ({y} = 0 AND {pred} = 0) AS tn,
  count(*) FILTER ({p} IS NULL) AS missing,
  -avg(ln(CASE WHEN {y} = 1 THEN least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
               ELSE 1 - least(greatest({p}, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END)) AS ll,
  avg(({p} - {y}) * ({p} - {y})) AS brier,
  sum(CASE WHEN {y} = 1 THEN rk + (ties - 1) / 2.0::DOUBLE END) AS rank_sum
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {p}) AS rk, count(*) OVER (PARTITION BY {keys}, {p}) AS ties FROM {source})
GROUP BY {keys}"""


def _finish_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    both = f"({a}tp + {a}fn > 0 AND {a}tn + {a}fp > 0 AND {a}missing = 0)"
    return f"""
  {rnd(f'({a}tp + {a}tn) / {a}row_count')} AS accuracy,
  {rnd(f'CASE WHEN {a}tp + {a}fp > 0 THEN {a}tp / ({a}tp + {a}fp) ELSE 0 END')} AS precision,
  {rnd(f'CASE WHEN {a}tp + {a}fn > 0 THEN {a}tp / ({a}tp + {a}fn) ELSE 0 END')} AS recall,
  {rnd(f'CASE WHEN {a}row_count > 0 THEN CASE WHEN 2 * {a}tp + {a}fp + {a}fn > 0 THEN 2 * {a}tp / (2 * {a}tp + {a}fp + {a}fn) ELSE 0 END END')} AS f1,
  CASE WHEN {both} THEN {rnd(f'({a}rank_sum - ({a}tp + {a}fn) * ({a}tp + {a}fn + 1) / 2) / (({a}tp + {a}fn) * ({a}tn + {a}fp))')} END AS roc_auc,
  CASE WHEN {both} THEN {rnd(f'{a}ll')} END AS log_loss,
  CASE WHEN {both} THEN {rnd(f'{a}brier')} END AS brier_score"""


cte("m8_rows", """
SELECT ticker, prediction_mode, split, prediction_date AS d, y, CAST(cal_e >= 0.5 AS INTEGER) AS pred, cal_e AS p FROM enh_pred""")
cte("m8_metrics", _metric_sql("m8_rows", "ticker, prediction_mode, split"))


@query("prediction_metrics", "M8", f"""
SELECT ticker, prediction_mode, split, row_count, date_start, date_end, tp + fn AS target_positive_count, tn + fp AS target_negative_count,
       tp + fp AS predicted_positive_count, tn + fn AS predicted_negative_count, {_finish_sql()} FROM m8_metrics""")
def prediction_metrics(spark, sf):
    out = M.prediction_metrics(
        E.enhanced_predictions(spark, sf), ["ticker", "prediction_mode", "split"], LABEL,
        "predicted_next_day_direction", "prediction_date", "calibrated_predicted_probability_up",
        "raw_predicted_probability_up")
    return out.select(
        "ticker", "prediction_mode", "split", "row_count", "date_start", "date_end", "target_positive_count",
        "target_negative_count", "predicted_positive_count", "predicted_negative_count",
        *[r(m).alias(m) for m in M.METRIC_ORDER])


@query("calibration_bins", "M9", f"""
SELECT prediction_mode, split, bin_index, count(*) AS row_count, {rnd('avg(cal_e)')} AS avg_probability, {rnd('avg(y)')} AS actual_frequency
FROM (SELECT *, CASE WHEN cal_e = 0 THEN 0 ELSE CAST(len(list_filter(
  [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]::DOUBLE[], lambda e: e < cal_e)) - 1 AS INTEGER) END AS bin_index
  FROM enh_pred) GROUP BY ALL""")
def calibration_bins(spark, sf):
    out = M.calibration_bins(
        E.enhanced_predictions(spark, sf), ["prediction_mode", "split"], LABEL, "calibrated_predicted_probability_up")
    return out.select("prediction_mode", "split", "bin_index", "row_count",
                      r("avg_probability").alias("avg_probability"), r("actual_frequency").alias("actual_frequency"))


@query("threshold_search", "M6", f"""
WITH t AS (SELECT ticker, prediction_mode, s / 100.0::DOUBLE AS t, count(*) FILTER (cal_e >= s / 100.0::DOUBLE AND y = 1) AS tp,
             count(*) FILTER (cal_e >= s / 100.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (cal_e < s / 100.0::DOUBLE AND y = 1) AS fn
           FROM enh_pred CROSS JOIN generate_series(30, 70) g(s) WHERE split = 'validation' GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM t)
SELECT ticker, prediction_mode, t AS threshold, {rnd('f1')} AS f1 FROM f
QUALIFY row_number() OVER (PARTITION BY ticker, prediction_mode ORDER BY f1 DESC, t) = 1""")
def threshold_search(spark, sf):
    rows = E.enhanced_predictions(spark, sf).where("split = 'validation'")
    return M.best_threshold(rows, ["ticker", "prediction_mode"], LABEL, "calibrated_predicted_probability_up").select(
        "ticker", "prediction_mode", "threshold", r("f1").alias("f1"))


@query("blend_search", "M7", f"""
WITH a AS (SELECT ticker, prediction_mode, s, CASE WHEN s = 20 THEN 1.0::DOUBLE ELSE s * 0.05::DOUBLE END AS alpha,
  least(greatest((1 - CASE WHEN s = 20 THEN 1.0::DOUBLE ELSE s * 0.05::DOUBLE END) * cal_b + CASE WHEN s = 20 THEN 1.0::DOUBLE ELSE s * 0.05::DOUBLE END * cal_e, 1e-7), 1 - 1e-7) AS p, y
  FROM enh_pred CROSS JOIN generate_series(0, 20) g(s) WHERE split = 'validation'),
l AS (SELECT ticker, prediction_mode, s, alpha, -avg(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS ll FROM a GROUP BY ALL)
SELECT ticker, prediction_mode, 'fitted' AS status, alpha AS best_alpha, {rnd('ll')} AS best_log_loss FROM l
QUALIFY row_number() OVER (PARTITION BY ticker, prediction_mode ORDER BY ll, s) = 1""")
def blend_search(spark, sf):
    base = E.baseline_predictions(spark, sf).where("split = 'validation'").select(
        F.col("date").alias("historical_date"), *KEYS, F.col("calibrated_predicted_probability_up").alias("b"))
    rows = E.enhanced_predictions(spark, sf).where("split = 'validation'").join(base, ["historical_date", *KEYS])
    out = M.best_blend(rows, ["ticker", "prediction_mode"], LABEL, "b", "calibrated_predicted_probability_up")
    return out.withColumn("best_log_loss", r("best_log_loss"))


cte("majority", "SELECT prediction_mode, avg(y) AS rate FROM enh_pred WHERE split = 'train' GROUP BY prediction_mode")


@query("naive_variants", "M11", f"""
SELECT {', '.join('e.' + k for k in MERGE_KEYS)}, CAST(m.rate >= 0.5 AS INTEGER) AS majority_label, {rnd('m.rate')} AS majority_probability,
       CAST(e.ret_1d >= 0 AS INTEGER) AS previous_day_label
FROM enh_pred e JOIN majority m USING (prediction_mode) WHERE e.split = 'test'""")
def naive_variants(spark, sf):
    enhanced = E.enhanced_predictions(spark, sf)
    test = enhanced.where("split = 'test'")
    out = EV.add_previous_day(EV.add_majority(test.select(*MERGE_KEYS), enhanced.where("split = 'train'")), test)
    return out.select(
        *MERGE_KEYS, F.col(f"{EV.MAJORITY}_predicted_next_day_direction").alias("majority_label"),
        r(f"{EV.MAJORITY}_predicted_probability_up").alias("majority_probability"),
        F.col(f"{EV.PREVIOUS_DAY}_predicted_next_day_direction").alias("previous_day_label"))


ABLATIONS = {EV.SENTIMENT_ONLY: 29, EV.EVENTS_ONLY: 37, EV.NO_CONFIDENCE: 43, EV.NO_FALLBACK: 53}


def full_frame(spark, sf):
    """The evaluation frame with the naive variants and four given ablations, computed once."""
    enhanced = L.materialize(E.enhanced_predictions(spark, sf))
    test = enhanced.where("split = 'test'")
    out = EV.evaluation_frame(enhanced, E.baseline_predictions(spark, sf))
    out = EV.add_previous_day(EV.add_majority(out, enhanced.where("split = 'train'")), test)
    return L.materialize(out.join(E.ablation_columns(test, ABLATIONS), list(MERGE_KEYS), "left"))


def _abl(divisor: int, variant: str) -> str:
    p = f"((x // {divisor + 2}) % 1000) / 1000.0::DOUBLE"
    return (f"SELECT *, '{variant}' AS model_variant, CAST({p} >= 0.5 AS INTEGER) AS pred, {p} AS p, "
            f"((x // {divisor}) % 1000) / 1000.0::DOUBLE AS rawp FROM ev_test")


cte("ev_test", """
SELECT e.*, m.rate, list_filter([
  'all_rows', CASE WHEN news_article_count >= 1 THEN 'news_heavy_rows' END, CASE WHEN state = 'zero_news' THEN 'zero_news_rows' END,
  CASE WHEN state = 'fresh_news' THEN 'fresh_news_rows' ELSE 'no_fresh_news_rows' END,
  CASE WHEN state = 'carried_forward_only' THEN 'carried_forward_rows' ELSE 'not_carried_forward_rows' END,
  CASE WHEN state = 'fallback_heavy' THEN 'fallback_heavy_rows' ELSE 'not_fallback_heavy_rows' END,
  CASE WHEN news_article_count > 0 THEN 'has_news_rows' END, CASE WHEN NOT abstain THEN 'abstain_eliminated_rows' END,
  CASE WHEN confident THEN 'high_confidence_rows' END,
  CASE WHEN grade IN ('A', 'B') THEN 'quality_grade_a_or_b_rows' ELSE 'quality_grade_c_or_worse_rows' END], lambda s: s IS NOT NULL) AS subsets
FROM evaluated e JOIN majority m USING (prediction_mode) WHERE split = 'test'""")
cte("ev_long", " UNION ALL ".join([
    f"SELECT *, '{EV.BASELINE}' AS model_variant, pred_b AS pred, cal_b AS p, raw_b AS rawp FROM ev_test",
    f"SELECT *, '{EV.ENHANCED}' AS model_variant, pred_e AS pred, cal_e AS p, raw_e AS rawp FROM ev_test",
    f"SELECT *, '{EV.BLENDED}' AS model_variant, pred_x AS pred, cal_x AS p, raw_x AS rawp FROM ev_test",
    f"SELECT *, '{EV.MAJORITY}' AS model_variant, CAST(rate >= 0.5 AS INTEGER) AS pred, rate AS p, NULL AS rawp FROM ev_test",
    f"SELECT *, '{EV.PREVIOUS_DAY}' AS model_variant, CAST(ret_1d >= 0 AS INTEGER) AS pred, NULL AS p, NULL AS rawp FROM ev_test",
    *[_abl(d, v) for v, d in ABLATIONS.items()]]))
cte("ev_subset", "SELECT prediction_mode, model_variant, unnest(subsets) AS subset_name, prediction_date AS d, y, pred, p, rawp, abstain FROM ev_long")
cte("ev_metrics", _metric_sql("ev_subset", "prediction_mode, subset_name, model_variant"))
cte("ev_raw", _metric_sql("(SELECT * FROM ev_subset WHERE rawp IS NOT NULL)", "prediction_mode, subset_name, model_variant", p="rawp"))
cte("ev_abstain", "SELECT prediction_mode, subset_name, model_variant, count(*) FILTER (abstain) AS abstained FROM ev_subset GROUP BY ALL")
_names = ", ".join(f"'{s}'" for s in EV.SUBSETS)
_variants = ", ".join(f"'{v}'" for v in EV.VARIANTS)
cte("ev_grid", f"""
SELECT * FROM (SELECT unnest(['pre_market', 'after_close']) AS prediction_mode), (SELECT unnest([{_names}]) AS subset_name),
     (SELECT unnest([{_variants}]) AS model_variant)""")
cte("ev_table", f"""
SELECT g.prediction_mode, g.subset_name, g.model_variant, coalesce(m.row_count, 0) AS row_count, m.date_start, m.date_end,
  coalesce(m.tp + m.fn, 0) AS target_positive_count, coalesce(m.tp + m.fp, 0) AS predicted_positive_count, {_finish_sql('m')},
  CASE WHEN m.missing = 0 AND m.tp + m.fn > 0 AND m.tn + m.fp > 0 AND w.ll IS NOT NULL THEN {rnd('w.ll')} END AS raw_log_loss,
  CASE WHEN m.missing = 0 AND m.tp + m.fn > 0 AND m.tn + m.fp > 0 AND w.ll IS NOT NULL
    THEN {rnd('(w.rank_sum - (w.tp + w.fn) * (w.tp + w.fn + 1) / 2) / ((w.tp + w.fn) * (w.tn + w.fp))')} END AS raw_roc_auc,
  coalesce(m.missing = 0, false) AS has_probability_scores, coalesce(a.abstained, 0) AS abstained_row_count,
  {rnd('1 - a.abstained / m.row_count')} AS selective_coverage
FROM ev_grid g LEFT JOIN ev_metrics m USING (prediction_mode, subset_name, model_variant)
LEFT JOIN ev_raw w USING (prediction_mode, subset_name, model_variant)
LEFT JOIN ev_abstain a USING (prediction_mode, subset_name, model_variant)""")


@query("variant_metric_table", "M10 M8 M11", "SELECT * FROM ev_table")
def variant_metric_table(spark, sf):
    out = EV.metric_table(full_frame(spark, sf), MODES)
    return out.select(
        "prediction_mode", "subset_name", "model_variant", "row_count", "date_start", "date_end",
        "target_positive_count", "predicted_positive_count", *[r(m).alias(m) for m in M.METRIC_ORDER],
        r("raw_log_loss").alias("raw_log_loss"), r("raw_roc_auc").alias("raw_roc_auc"),
        "has_probability_scores", "abstained_row_count", r("selective_coverage").alias("selective_coverage"))


def _verdict(m: str) -> str:
    sign = "b.{0} - e.{0}" if m in M.LOWER_IS_BETTER else "e.{0} - b.{0}"
    d = sign.format(m)
    return f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} >= 0.02 THEN 'improved' WHEN {d} <= -0.02 THEN 'worsened' ELSE 'unchanged' END"


def _list(kind: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN v_{m} = '{kind}' THEN '{m}' END" for m in M.METRIC_ORDER) + ")"


cte("ev_pairs", f"""
SELECT e.prediction_mode, e.subset_name, e.row_count, {', '.join(f'{_verdict(m)} AS v_{m}' for m in M.METRIC_ORDER)}
FROM ev_table e JOIN ev_table b USING (prediction_mode, subset_name)
WHERE e.model_variant = '{EV.ENHANCED}' AND b.model_variant = '{EV.BASELINE}'""")
cte("ev_lists", f"SELECT *, {_list('improved')} AS improved, {_list('worsened')} AS worsened, {_list('unchanged')} AS unchanged FROM ev_pairs")


@query("metric_evidence", "M14", """
SELECT prediction_mode, subset_name, row_count, improved, worsened, unchanged,
  CASE WHEN row_count = 0 THEN 'No rows were available for the ' || subset_name || ' subset.'
       WHEN improved = '' AND worsened = '' THEN 'On ' || row_count || ' ' || subset_name || ' rows, enhanced and baseline were effectively tied at the 0.02 materiality threshold.'
       ELSE 'On ' || row_count || ' ' || subset_name || ' rows, enhanced improved on ' || coalesce(nullif(improved, ''), 'none') || ', worsened on '
         || coalesce(nullif(worsened, ''), 'none') || ', and stayed within the 0.02 materiality threshold on ' || coalesce(nullif(unchanged, ''), 'none') || '.' END AS note
FROM ev_lists""")
def metric_evidence(spark, sf):
    table = EV.metric_table(full_frame(spark, sf), MODES)
    return EV.evidence(table).select(
        "prediction_mode", "subset_name", "row_count",
        *[F.concat_ws(", ", f"{k}_metrics").alias(k) for k in ("improved", "worsened", "unchanged")], "note")


@query("mode_separation", "M14", """
SELECT count(DISTINCT prediction_mode) > 1 AND max(n) = 1 AS modes_identical FROM (
  SELECT subset_name, model_variant, count(DISTINCT row(row_count, accuracy, precision, recall, f1, roc_auc, log_loss, brier_score, abstained_row_count)) AS n
  FROM ev_table GROUP BY ALL), (SELECT DISTINCT prediction_mode FROM ev_table)""")
def mode_separation(spark, sf):
    return EV.modes_identical(EV.metric_table(full_frame(spark, sf), MODES), MODES)


def compared(spark, sf):
    enhanced = E.enhanced_predictions(spark, sf).where("split <> 'train'")
    base = E.baseline_predictions(spark, sf).select(
        F.col("date").alias("historical_date"), F.col("target_date").alias("prediction_date"), *KEYS,
        "predicted_next_day_direction", "raw_predicted_probability_up", "calibrated_predicted_probability_up")
    per_mode = base.withColumn("prediction_mode", F.explode(F.array(*[F.lit(m) for m in MODES])))
    return EV.comparison_frame(enhanced, per_mode, 0.45)


cte("compared", """
SELECT *, CAST(cal_x >= 0.45 AS INTEGER) AS pred_t, pred_e <> pred_b AS disagreement,
       pred_b = y AS ok_b, pred_e = y AS ok_e, CAST(cal_x >= 0.45 AS INTEGER) = y AS ok_x FROM evaluated WHERE split <> 'train'""")


@query("model_comparison", "M15 X18", f"""
SELECT split, {ID}, pred_b AS baseline, pred_e AS enhanced, pred_t AS blended, {rnd('cal_x')} AS blended_probability,
       disagreement AS disagreement_flag, ok_b AS baseline_correct, ok_e AS enhanced_correct, ok_x AS blended_correct FROM compared""")
def model_comparison(spark, sf):
    return compared(spark, sf).select(
        "split", *MERGE_KEYS, *[F.col(f"{m}_predicted_next_day_direction").alias(m) for m in ("baseline", "enhanced", "blended")],
        r("blended_calibrated_predicted_probability_up").alias("blended_probability"), "disagreement_flag",
        "baseline_correct", "enhanced_correct", "blended_correct")


@query("comparison_summary", "A13", f"""
SELECT prediction_mode, count(*) AS row_count, count(*) FILTER (disagreement) AS disagreement_count,
       {rnd('count(*) FILTER (disagreement) / count(*)')} AS disagreement_rate,
       count(*) FILTER (ok_e) AS enhanced_correct_count, count(*) FILTER (ok_b) AS baseline_correct_count, count(*) FILTER (ok_x) AS blended_correct_count,
       count(*) FILTER (ok_e AND NOT ok_b) AS enhanced_better_count, count(*) FILTER (ok_b AND NOT ok_e) AS baseline_better_count,
       count(*) FILTER (ok_x AND NOT ok_b) AS blended_better_than_baseline_count, count(*) FILTER (ok_b = ok_e) AS tied_count,
       count(*) FILTER (disagreement AND news_article_count > 0) AS news_heavy_disagreement_count
FROM compared GROUP BY prediction_mode""")
def comparison_summary(spark, sf):
    return EV.comparison_summary(compared(spark, sf)).withColumn("disagreement_rate", r("disagreement_rate"))


cte("iso_tied", """
SELECT prediction_mode, raw_e AS x, count(*) AS w, sum(y) AS s
FROM enh_pred WHERE split = 'validation' GROUP BY ALL""")
cte("iso_sums", """
SELECT *, sum(w) OVER m AS n1, sum(s) OVER m AS s1, row_number() OVER m AS i FROM iso_tied
WINDOW m AS (PARTITION BY prediction_mode ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
# The fit at i: over all starts a <= i the largest of the least mean of a..b, b >= i.
cte("iso_means", """
SELECT a.prediction_mode, a.i AS a, b.i AS b, (b.s1 - a.s1 + a.s)::DOUBLE / (b.n1 - a.n1 + a.w) AS mean
FROM iso_sums a JOIN iso_sums b ON a.prediction_mode = b.prediction_mode AND a.i <= b.i""")
cte("iso_least", """
SELECT prediction_mode, a, b AS i, min(mean) OVER (PARTITION BY prediction_mode, a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS least
FROM iso_means""")
cte("iso_fit", "SELECT prediction_mode, i, max(least) AS fitted FROM iso_least GROUP BY ALL")


@query("isotonic_blocks", "M5", f"""
SELECT prediction_mode, {rnd('min(x)')} AS low, {rnd('max(x)')} AS high, {rnd('max(fitted)')} AS fitted, sum(w)::BIGINT AS weight
FROM iso_fit JOIN iso_sums USING (prediction_mode, i) GROUP BY prediction_mode, iso_fit.fitted""")
def isotonic_blocks(spark, sf):
    """The isotonic fit of validation labels on raw probabilities, by mode."""
    from tidemark.operators.isotonic import isotonic_blocks as fitted

    rows = E.enhanced_predictions(spark, sf).where("split = 'validation'")
    return fitted(rows, ["prediction_mode"], "raw_predicted_probability_up", LABEL).select(
        "prediction_mode", r("low").alias("low"), r("high").alias("high"), r("fitted").alias("fitted"), "weight")
