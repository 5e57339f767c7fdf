"""Evaluation of scores and predictions. Everything is counted; no prediction comes to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import attach_group_stats, one_row, prefix_sums, with_scalars


def _with_rates(counts: DataFrame) -> DataFrame:
    """Rates from the four counts n, tp, fp, fn, tn."""
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": rate(tp + tn, F.col("n")), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn),
        "class_0_correct_pct": rate(tn, tn + fp) * 100, "class_1_correct_pct": rate(tp, tp + fn) * 100})


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four cases and the rates made from them; the positive class is 1."""
    pos, said = F.col(actual) == 1, F.col(predicted) == 1
    return _with_rates(df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pos & said).alias("tp"), F.count_if(~pos & said).alias("fp"),
        F.count_if(pos & ~said).alias("fn"), F.count_if(~pos & ~said).alias("tn")))


def _score_counts(df: DataFrame, actual: str, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    return df.where(s.isNotNull()).groupBy(s.alias("score")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) != 1).alias("neg"))


def roc_points(df: DataFrame, actual: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct score, from the highest score down.

    Equal scores are folded first, then cumulated in ordered buckets, so neither many equal scores
    nor many distinct ones meet in one task.
    """
    counts = _score_counts(df, actual, score).withColumn("_desc", -F.col("score"))
    ends = one_row(counts, F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    run = prefix_sums(counts, ["_desc"], {"tp": F.col("pos"), "fp": F.col("neg")})
    rows = with_scalars(run, ends)
    return rows.select("score", F.try_divide("fp", "_n").alias("fpr"), F.try_divide("tp", "_p").alias("tpr"), "pos", "neg")


def auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Area under the ROC curve: share of positive-negative pairs in the right order, ties as half."""
    counts = _score_counts(df, actual, score)
    run = prefix_sums(counts, ["score"], {"_below": F.col("neg")})
    pairs = F.sum(F.col("pos").cast("double") * (F.col("_below") - F.col("neg") + F.col("neg") / 2.0))
    return run.agg(F.coalesce(F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")), F.lit(0.0)).alias("auc"))


def threshold_search(df: DataFrame, actual: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """Quality at 29 thresholds from 0.15 to 0.85, at 0.5 and at the base rate, with the ranking score.

    A row is counted once, under the number of thresholds it reaches; the 31 tables of counts are
    then made from those at most 32 x 2 numbers per group.
    """
    rate = df.groupBy(*by).agg(F.avg((F.col(actual) == 1).cast("double")).alias("_rate"), F.count("*").alias("_w"))
    grid = sorted({*(round(0.15 + i * 0.025, 4) for i in range(29)), 0.5})
    rows = attach_group_stats(df, rate, by, "_w") if by else with_scalars(df, rate.drop("_w"))
    marks = F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, grid)), F.array(F.round("_rate", 4)))))
    reached = F.size(F.filter(marks, lambda m: m <= F.col(probability)))
    folded = rows.groupBy(*by, "_rate", reached.alias("_reached")).agg(
        F.count_if(F.col(actual) == 1).alias("_pos"), F.count_if(F.col(actual) != 1).alias("_neg"))
    cases = folded.select(*by, "_pos", "_neg", "_reached", F.posexplode(marks).alias("_i", "threshold"))
    said = F.col("_reached") > F.col("_i")
    total = lambda c, keep: F.sum(F.when(keep, F.col(c)).otherwise(0)).cast("bigint")
    table = _with_rates(cases.groupBy(*by, "threshold").agg(
        F.sum(F.col("_pos") + F.col("_neg")).cast("bigint").alias("n"), total("_pos", said).alias("tp"), total("_neg", said).alias("fp"),
        total("_pos", ~said).alias("fn"), total("_neg", ~said).alias("tn")))
    gap = F.abs((F.col("tp") + F.col("fp")) / F.col("n") - (F.col("tp") + F.col("fn")) / F.col("n"))
    return table.withColumn("calibration_gap", gap)


def best_threshold(search: DataFrame, area: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the best ranking score; ties by accuracy, precision, recall, small gap, small threshold.

    ``area`` carries ``auc`` per group; the search has 31 rows per group.
    """
    rows = search.join(area, list(by)) if by else with_scalars(search, area)
    rank = (F.col("accuracy") * 0.45 + F.col("precision") * 0.25 + F.col("auc") * 0.20 + F.col("recall") * 0.10 - F.col("calibration_gap") * 0.05)
    r = lambda c: F.round(c, 10)
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(
        F.desc("ranking_score"), r("accuracy").desc(), r("precision").desc(), r("recall").desc(), r("calibration_gap").asc(), F.asc("threshold"))
    ranked = rows.withColumn("ranking_score", r(rank)).withColumn("_i", F.row_number().over(order))
    return ranked.where("_i = 1").select(*by, "threshold", "ranking_score", "accuracy", "precision", "recall", "auc", "calibration_gap")


ALPHAS = [0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4, 1.5]


def score_rule(df: DataFrame, score: str, outcome: str, good=1, bad=0, alphas: Sequence[float] = tuple(ALPHAS)) -> DataFrame:
    """Rule "score above alpha times its mean": which class high scores get, and accuracy per alpha.

    High scores get the bad class where good outcomes are more frequent overall than above the mean.
    """
    base = one_row(df, F.avg(score).alias("_mean"), (F.avg((F.col(outcome) == good).cast("double")) * 100).alias("_rate"))
    above = with_scalars(df, base)
    high_share = above.agg(F.avg(F.when(F.col(score) > F.col("_mean"), (F.col(outcome) == good).cast("double"))).alias("_h"))
    rows = with_scalars(above, high_share)
    high = F.when(F.col("_rate") > F.coalesce(F.col("_h") * 100, F.col("_rate")), F.lit(bad)).otherwise(F.lit(good))
    low = F.when(high == bad, F.lit(good)).otherwise(F.lit(bad))
    rows = rows.select(F.col(outcome).alias("_y"), F.col(score).alias("_s"), high.alias("high_label"), low.alias("_low"), "_mean")
    cells = []
    for alpha in alphas:
        said = F.when(F.col("_s") > F.lit(float(alpha)) * F.col("_mean"), F.col("high_label")).otherwise(F.col("_low"))
        cells.append(F.struct(
            F.lit(float(alpha)).alias("alpha"), F.first("high_label").alias("high_label"), (F.first("_mean") * F.lit(float(alpha))).alias("threshold"),
            F.count("*").alias("n"), F.count_if(F.col("_y") == said).alias("correct"),
            F.count_if((said == good) & (F.col("_y") == good)).alias("good_correct"), F.count_if((said == bad) & (F.col("_y") == bad)).alias("bad_correct")))
    # All alphas are counted side by side in one pass.
    return rows.agg(F.array(*cells).alias("_a")).select(F.inline("_a")).withColumn("accuracy", F.try_divide("correct", "n"))


def rule_probability(df: DataFrame, score: str, threshold: float, spread: float, high_is_bad: bool = True):
    """Probability of the bad class from the distance to the rule's threshold."""
    from ..functions.scalars import sigmoid

    signed = (F.col(score) - F.lit(threshold)) / F.lit(spread if abs(spread) > 1e-9 else 1.0)
    return df.withColumn("rule_probability", sigmoid(signed if high_is_bad else -signed))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MAPE, SMAPE, R2 and the share of predictions within 10% (20% for positive actuals)."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    miss = F.abs(y - p)
    agg = df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(miss).alias("mae"), F.avg(F.when(y != 0, miss / F.abs(y))).alias("mape"),
        F.avg(F.coalesce(F.try_divide(2 * miss, F.abs(y) + F.abs(p)), F.lit(0.0))).alias("smape"),
        F.sum(miss * miss).alias("_sq"), F.var_pop(y).alias("_v"),
        F.avg((miss <= F.abs(y) * 0.10).cast("double")).alias("within_10pct"),
        F.avg(F.when(y > 0, (miss <= y * 0.20).cast("double"))).alias("within_20pct_positive"),
        F.avg(F.when(y == 0, (p == 0).cast("double"))).alias("zero_matched"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sq"), F.col("_v") * F.col("n"))
    return agg.withColumn("r2", r2).drop("_sq", "_v")


def prediction_table(scored: DataFrame, key: Sequence[str], actual: str, predicted: str, labels: dict | None = None,
                     tolerance: float = 0.10) -> DataFrame:
    """Actual against predicted per row, with class names or with a tolerance flag."""
    if labels:
        names = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (str(k), v)])
        shown = lambda c: F.try_element_at(names, F.col(c).cast("int").cast("string"))
        return scored.select(*key, shown(actual).alias("actual"), shown(predicted).alias("predicted"),
                             (F.col(actual) == F.col(predicted)).cast("int").alias("hit"))
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return scored.select(*key, y.alias("actual"), p.alias("predicted"), (F.abs(p - y) <= F.abs(y) * tolerance).cast("int").alias("hit"))
