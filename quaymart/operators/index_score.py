"""Composite experience index: directions, weights, score, quadrants, outcome line and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import clustered
from .penalised import penalised
from .scale import attach_group_stats, one_row, with_scalars
from .selection import correlation_pairs, mutual_information, target_correlations

LOW, HIGH = "MIN", "MAX"


def correlation_directions(df: DataFrame, target: str, features: Sequence[str]) -> dict[str, str]:
    """MIN for features that move against the target, by the sign of their correlation."""
    rows = target_correlations(df, target, features).collect()
    return {r["feature"]: LOW if (r["corr"] or 0.0) < 0 else HIGH for r in rows}


def lasso_directions(df: DataFrame, target: str, features: Sequence[str], penalty: float = 0.2) -> dict[str, str]:
    """MIN for features whose penalised coefficient is negative."""
    return {f: LOW if c < 0 else HIGH for f, c in penalised(df, target, features, penalty).items()}


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features whose maximum is not 0; the others cannot be normalised."""
    tops = df.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in features]).first()
    return [f for f in features if tops[f] not in (None, 0.0)]


def normalised(df: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """x / max, or (max - x) / max for features that are better low. Rows with a gap are left out."""
    tops = one_row(df, *[F.max(F.col(f).cast("double")).alias(f"_top_{f}") for f in directions])
    rows = with_scalars(df.dropna(subset=list(directions)), tops)
    share = {f: (F.col(f).cast("double") if way == HIGH else F.col(f"_top_{f}") - F.col(f).cast("double")) / F.col(f"_top_{f}")
             for f, way in directions.items()}
    return rows.select(*[share[c].alias(c) if c in share else F.col(c) for c in df.columns])


def redundancy_weights(norm: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """1 - b/2 where b is half the mean absolute correlation with the other features."""
    pairs = correlation_pairs(norm, features)
    both = pairs.select(F.col("left").alias("feature"), "corr").unionByName(pairs.select(F.col("right").alias("feature"), "corr"))
    rows = both.where("corr IS NOT NULL").groupBy("feature").agg(F.avg(F.abs("corr")).alias("m")).collect()
    mean = {r["feature"]: r["m"] for r in rows}
    return {f: 1.0 - mean.get(f, 0.0) / 4.0 for f in features}


def score(weights: Mapping[str, float]) -> Column:
    """100 times the weighted sum of normalised features over their number."""
    total: Column = F.lit(0.0)
    for f, w in weights.items():
        total = total + F.col(f) * F.lit(float(w))
    return total * F.lit(100.0) / F.lit(float(max(len(weights), 1)))


def with_label(df: DataFrame, column: str, name: str) -> DataFrame:
    """0 above the mean score, 1 otherwise."""
    mean = one_row(df, F.avg(column).alias("_mean"))
    return with_scalars(df, mean).withColumn(name, F.when(F.col(column) > F.col("_mean"), 0).otherwise(1)).drop("_mean")


def category_scores(norm: DataFrame, weights: Mapping[str, float], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One sub-index per group of features, as further columns."""
    return norm.withColumns({f"index_{g}": score({f: weights[f] for f in fs}) for g, fs in groups.items()})


def learned_weights(norm: DataFrame, label: str, features: Sequence[str], seed: int = 42) -> dict[str, dict[str, float]]:
    """Five views on how much a feature matters for the label: penalised regression, mutual
    information, first principal component, complement naive Bayes, boosted trees."""
    from pyspark.ml.classification import GBTClassifier, NaiveBayes
    from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler

    features = list(features)
    rows = VectorAssembler(inputCols=features, outputCol="_vec").transform(norm).withColumn("_y", F.col(label).cast("double")).select("_vec", "_y")
    mi = {r["feature"]: r["mutual_information"] for r in mutual_information(norm, label, features).collect()}
    component = PCA(k=1, inputCol="_vec", outputCol="_pc").fit(rows).pc.toArray()[:, 0]
    scaled = MinMaxScaler(inputCol="_vec", outputCol="_pos").fit(rows).transform(rows)
    bayes = NaiveBayes(featuresCol="_pos", labelCol="_y", modelType="complement").fit(scaled)
    mean_log = np.asarray(bayes.theta.toArray()).mean(axis=0)
    share = np.exp(mean_log) / np.exp(mean_log).sum()
    trees = GBTClassifier(featuresCol="_vec", labelCol="_y", maxIter=20, maxDepth=4, seed=seed).fit(rows)
    return {
        "lasso": {f: abs(c) for f, c in penalised(norm, label, features, 0.01).items()},
        "mutual_information": {f: (v if v >= 0.1 else 0.0) for f, v in ((f, mi.get(f, 0.0)) for f in features)},
        "component": dict(zip(features, map(float, component))),
        "bayes": dict(zip(features, map(float, share))),
        "trees": dict(zip(features, map(float, trees.featureImportances.toArray())))}


def feature_means(norm: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return norm.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()


def pruned_weights(weights: Mapping[str, float], means: Mapping[str, float], base_mean: float) -> dict[str, float]:
    """Drop the weakest features while the mean score stays within 10% of ``base_mean``.

    The mean score of any subset follows from the feature means, so no further pass over the data
    is needed.
    """
    order = sorted((f for f, w in weights.items() if w != 0), key=lambda f: -weights[f])
    kept = list(order)
    while kept and 0.9 * base_mean <= 100.0 * sum(weights[f] * means[f] for f in kept) / len(kept) <= 1.1 * base_mean:
        kept.pop()
    return {f: (w if f in kept else 0.0) for f, w in weights.items()}


def blended_weights(views: Sequence[Mapping[str, float]]) -> dict[str, float]:
    """Mean of the non-zero views of a feature, raised by a tenth for every further view that agrees."""
    out = {}
    for f in views[0]:
        values = [v[f] for v in views]
        n = max(sum(1 for v in values if v != 0), 1)
        out[f] = sum(values) * (1 + 0.1 * (n - 1)) / n
    return out


def consensus_features(weights: DataFrame, top: int = 5) -> DataFrame:
    """Features in the top list of at least two views and their boost 1 + count / features found.

    ``weights`` is long: view, feature, weight; its size is views x features.
    """
    rank = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("weight"), "feature"))
    counts = weights.withColumn("_r", rank).where(F.col("_r") <= top).groupBy("feature").agg(F.count("*").alias("times"))
    repeated = counts.where("times > 1")
    size = repeated.agg(F.count("*").alias("_k"))
    return with_scalars(repeated, size).select("feature", "times", (F.lit(1.0) + F.col("times") / F.col("_k")).alias("boost"))


def top_weights(weights: DataFrame, limit: int) -> DataFrame:
    """Strongest features per view with their place; feature tables are small by construction."""
    rank = F.row_number().over(Window.partitionBy("view").orderBy(F.desc("weight"), "feature"))
    return weights.withColumn("place", rank).where(F.col("place") <= limit)


def weight_sweep(norm: DataFrame, outcome: str, weights: Mapping[str, float], boost: Mapping[str, float],
                 percents: Sequence[int]) -> DataFrame:
    """Score quality when the boost vector is mixed in at several strengths, all side by side.

    A diagnostic of how stable the index is; it looks at the true outcome and is no accuracy.
    """
    def mixed(p):
        return score({f: w * (1 + p / 100.0 * (boost.get(f, 1.0) - 1)) for f, w in weights.items()})

    scored = norm.select(F.col(outcome).alias("_y"), *[mixed(p).alias(f"_s{i}") for i, p in enumerate(percents)])
    rows = with_scalars(scored, scored.agg(*[F.avg(f"_s{i}").alias(f"_m{i}") for i in range(len(percents))]))
    good, cells = F.col("_y") == 1, []
    for i, p in enumerate(percents):
        above = F.col(f"_s{i}") >= F.col(f"_m{i}")
        cells.append(F.struct(
            F.lit(p).alias("percent"), F.first(f"_m{i}").alias("mean_score"), F.count_if(above & good).alias("good_above"),
            F.count_if(above & ~good).alias("bad_above"), F.count_if(~above & good).alias("good_below"), F.count_if(~above & ~good).alias("bad_below")))
    return rows.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))


def quadrants(df: DataFrame, score_column: str, outcome: str, good=1, bad=0, by: Sequence[str] = ()) -> DataFrame:
    """Good and bad outcomes above and below the mean score, with the shares of good."""
    means = df.groupBy(*by).agg(F.avg(score_column).alias("_mean"), F.count("*").alias("_w"))
    rows = attach_group_stats(df, means, by, "_w") if by else with_scalars(df, means.drop("_w"))
    above, below = F.col(score_column) > F.col("_mean"), F.col(score_column) < F.col("_mean")
    is_good, is_bad = F.col(outcome) == F.lit(good), F.col(outcome) == F.lit(bad)
    agg = rows.groupBy(*by).agg(
        F.first("_mean").alias("mean_score"), F.max(score_column).alias("top_score"), F.min(score_column).alias("low_score"), F.count("*").alias("n_rows"),
        F.count_if(above & is_good).alias("good_above"), F.count_if(above & is_bad).alias("bad_above"),
        F.count_if(below & is_good).alias("good_below"), F.count_if(below & is_bad).alias("bad_below"),
        F.count_if(is_good).alias("good_total"), F.count_if(is_bad).alias("bad_total"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)) * 100
    return agg.withColumns({"good_above_pct": share("good_above", "bad_above"), "good_below_pct": share("good_below", "bad_below"),
                            "good_pct": F.coalesce(F.try_divide("good_total", "n_rows"), F.lit(0.0)) * 100})


def movement(quadrant_row: DataFrame) -> DataFrame:
    """Which class is the smaller one and whether it sits above or below the mean score."""
    q = quadrant_row
    good_small = F.col("good_total") <= F.col("bad_total")
    up = F.when(good_small, F.col("good_above_pct")).otherwise(100 - F.col("good_above_pct"))
    down = F.when(good_small, F.col("good_below_pct")).otherwise(100 - F.col("good_below_pct"))
    return q.withColumns({"smaller_class": F.when(good_small, "good").otherwise("bad"), "side": F.when(up >= down, "above").otherwise("below")})


def outcome_line(df: DataFrame, score_column: str, outcome: str) -> DataFrame:
    """Straight line of the outcome over the score with its measured R2; flat where either is constant."""
    x, y = F.col(score_column).cast("double"), F.col(outcome).cast("double")
    agg = df.agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"), F.regr_r2(y, x).alias("_r"), F.avg(y).alias("current_outcome"),
                 F.avg(x).alias("current_score"), F.min(x).alias("score_min"), F.max(x).alias("score_max"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    usable = F.col("_vx") > 0
    slope = F.when(usable, F.col("_s")).otherwise(F.lit(0.0))
    return agg.select(
        slope.alias("slope"), F.when(usable, F.col("_i")).otherwise(F.col("current_outcome")).alias("intercept"),
        F.when(usable & (F.col("_vy") > 0), F.coalesce("_r", F.lit(0.0))).otherwise(F.lit(1.0)).alias("r2"),
        F.when(slope < 0, "Negative").otherwise("Positive").alias("direction"), "current_outcome", "current_score", "score_min", "score_max")


def bin_curve(df: DataFrame, score_column: str, outcome: str, bins: int = 5) -> DataFrame:
    """Mean score and outcome rate (percent) in bins of equal frequency."""
    from .scale import exact_quantiles

    names = [f"q{i}" for i in range(1, bins)]
    cuts = exact_quantiles(df, score_column, {n: (i + 1) / bins for i, n in enumerate(names)})
    rows = with_scalars(df.select(F.col(score_column).cast("double").alias("_s"), F.col(outcome).cast("double").alias("_y")).where("_s IS NOT NULL"), cuts)
    place: Column = F.lit(0)
    for n in names:
        place = place + (F.col("_s") > F.col(n)).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("_s").alias("mean_score"), (F.avg("_y") * 100).alias("outcome_rate"))


def cluster_curve(df: DataFrame, score_column: str, outcome: str, clusters: int = 5) -> DataFrame:
    """Mean score and outcome rate (percent) in the clusters of the score that ``clusters.clustered`` cuts, in ascending order of the score."""
    rows = df.select(F.col(score_column).cast("double").alias("_s"), F.col(outcome).cast("double").alias("_y"))
    return clustered(rows, "_s", clusters).groupBy("cluster").agg(F.avg("_s").alias("mean_score"), (F.avg("_y") * 100).alias("outcome_rate"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Goal:
    """A wanted change of the outcome in percent, its direction, and which way the score moves."""
    percent: float
    decrease: bool = False
    score_up: bool = True


def improvement_targets(line: DataFrame, goal: Goal, keys: Sequence[str] = ()) -> DataFrame:
    """Immediate, midterm and long-term outcome and the score each needs, in closed form.

    The line is shifted through the current point. Immediate is the current outcome changed by the
    goal; long term is the best outcome on the line between the smallest and largest score, drawn a
    quarter back towards immediate; midterm lies halfway. A score that the line cannot reach is
    held at the end of the line.
    """
    slope, x0, y0 = F.col("slope"), F.col("current_score"), F.round("current_outcome", 2)
    at = lambda x: y0 + slope * (x - x0)
    left, right = F.greatest("score_min", F.lit(0.0)), F.col("score_max")
    best = F.least(at(left), at(right)) if goal.decrease else F.greatest(at(left), at(right))
    best = F.greatest(best, F.lit(0.0))
    staged = line.withColumns({"_y0": y0, "_imm": y0 * (1 + (-1 if goal.decrease else 1) * abs(goal.percent) / 100.0), "_best": F.round(best, 2),
                               "_left": left, "_right": right})
    long = F.col("_best") + 0.25 * (F.col("_imm") - F.col("_best"))
    staged = staged.withColumn("_long", long).withColumn("_mid", (F.col("_imm") + F.col("_long")) / 2)
    reach = lambda y: F.when(slope != 0, x0 + (y - F.col("_y0")) / slope).otherwise(x0)
    hold = lambda x: F.round(F.least(F.greatest(x, F.col("_left")), F.col("_right")), 2)
    change = lambda y: F.abs(F.try_divide(F.col("_y0") - y, F.col("_y0"))) * 100
    return staged.select(
        *keys, F.round(x0, 2).alias("current_score"), F.col("_y0").alias("current_outcome"),
        F.col("_imm").alias("immediate_outcome"), hold(reach(F.col("_imm"))).alias("immediate_score"),
        F.col("_mid").alias("midterm_outcome"), hold(reach(F.col("_mid"))).alias("midterm_score"), change(F.col("_mid")).alias("midterm_change_pct"),
        F.col("_long").alias("longterm_outcome"), hold(reach(F.col("_long"))).alias("longterm_score"), change(F.col("_long")).alias("longterm_change_pct"))


def curve_scores(curve: DataFrame, wanted: DataFrame, score: str = "mean_score", outcome: str = "outcome_rate") -> DataFrame:
    """All columns of ``wanted`` plus ``score``: where a curve meets the outcome that is wanted.

    ``curve`` has one row per bin, ``wanted`` one per goal with ``wanted_outcome``, ``current_score`` and
    ``score_up``; both are bounded by their definition. Each pair of neighbouring bins is a segment,
    and every segment that meets the outcome offers a score. Offers are ranked: scores of at least
    zero first, then those in the direction of movement, then the nearest. If no segment meets it,
    the bin with the nearest outcome is the only offer. The score is held within the curve.
    """
    along = Window.partitionBy(F.lit(0)).orderBy("_x1")
    points = curve.select(F.col(score).cast("double").alias("_x1"), F.col(outcome).cast("double").alias("_y1"))
    drawn = points.select("*", F.lead("_x1").over(along).alias("_x2"), F.lead("_y1").over(along).alias("_y2"))
    ends = points.agg(F.min("_x1").alias("_left"), F.max("_x1").alias("_right"))
    goals = wanted.withColumn("_goal", F.monotonically_increasing_id())
    y = F.col("wanted_outcome")
    pairs = goals.join(F.broadcast(with_scalars(drawn, ends)))
    meets = F.col("_x2").isNotNull() & ((y - F.col("_y1")) * (y - F.col("_y2")) <= 0)
    flat = F.col("_y1") == F.col("_y2")
    on = F.when(flat, (F.col("_x1") + F.col("_x2")) / 2).otherwise(F.col("_x1") + (y - F.col("_y1")) * (F.col("_x2") - F.col("_x1")) / (F.col("_y2") - F.col("_y1")))
    x = F.when(meets, on).otherwise(F.col("_x1"))
    behind = F.when(F.col("score_up"), x < F.col("current_score")).otherwise(x > F.col("current_score"))
    rank = F.struct((~meets).alias("a"), F.when(meets, 0.0).otherwise(F.abs(F.col("_y1") - y)).alias("b"), (x < 0).alias("c"), behind.alias("d"),
                    F.abs(x - F.col("current_score")).alias("e"), x.alias("x"))
    best = pairs.groupBy("_goal").agg(F.min(rank)["x"].alias("_x"), F.first("_left").alias("_left"), F.first("_right").alias("_right"))
    held = F.least(F.greatest("_x", F.greatest(F.lit(0.0), "_left")), "_right")
    return goals.join(F.broadcast(best), "_goal").select(*wanted.columns, F.round(held, 2).alias("score"))


def split_at_mean(df: DataFrame, target: str, name: str) -> DataFrame:
    """Continuous outcome as above (0) or below (1) its mean; a missing value counts as the mean.

    The codes follow the sorted class names Above_mean and Below_mean.
    """
    mean = one_row(df, F.avg(F.col(target).cast("double")).alias("_mean"))
    value = F.coalesce(F.col(target).cast("double"), F.col("_mean"))
    return with_scalars(df, mean).withColumn(name, F.when(value >= F.col("_mean"), 0).otherwise(1)).drop("_mean")


def traction(df: DataFrame, score_columns: Mapping[str, str], outcome: str) -> DataFrame:
    """Per category: buyers and non-buyers with a high score, traction, friction, net, status and rank.

    All categories are counted in one pass.
    """
    means = one_row(df, *[F.avg(c).alias(f"_mean_{k}") for k, c in score_columns.items()])
    rows = with_scalars(df, means)
    buyer = F.col(outcome) == 1
    counts = []
    for k, c in score_columns.items():
        high = F.col(c) > F.col(f"_mean_{k}")
        counts.append(F.struct(F.lit(k).alias("category"), F.first(f"_mean_{k}").alias("current_score"), F.count_if(high).alias("high_users"),
                               F.count_if(high & buyer).alias("traction_users"), F.count_if(high & ~buyer).alias("friction_users"),
                               F.count("*").alias("overall_users"), F.count_if(buyer).alias("buyer_count")))
    sections = rows.agg(F.array(*counts).alias("_a")).select(F.inline("_a"))
    pct = lambda c: F.round(F.coalesce(F.try_divide(c, "high_users"), F.lit(0.0)) * 100, 2)
    sections = sections.withColumns({"traction_pct": pct("traction_users"), "friction_pct": pct("friction_users")})
    net = F.round(F.col("traction_pct") - F.col("friction_pct"), 2)
    status = F.when(net >= 20, "Strong Traction").when(net >= 0, "Balanced").when(net >= -20, "Friction Risk").otherwise("High Friction")
    sections = sections.withColumns({"net_traction": net, "status": status})
    # One row per category from here on.
    rank = F.row_number().over(Window.orderBy(F.desc("traction_pct"), F.desc("net_traction"), "category"))
    opportunity = F.row_number().over(Window.orderBy(F.when(F.col("high_users") > 0, 0).otherwise(1), "net_traction", "category"))
    return sections.withColumns({"rank": rank, "is_opportunity": (opportunity == 1).cast("int")})
