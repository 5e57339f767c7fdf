"""Importances, what-if rows, tree paths, rule ranking and linear attributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import exact_quantiles, one_row, with_scalars


def importance_by_base(importances: DataFrame, encoding: DataFrame) -> DataFrame:
    """Importance of encoded columns summed per base column, with the categories listed by weight.

    Both inputs have one row per feature; the encoding table is ``OneHot.table``.
    """
    named = importances.join(F.broadcast(encoding.select(F.col("encoded").alias("feature"), "base", "category")), "feature", "left")
    named = named.withColumn("base", F.coalesce("base", "feature"))
    part = F.concat(F.col("category"), F.lit(" -> "), F.format_number("importance", 2), F.lit("%"))
    listed = F.sort_array(F.collect_list(F.when(F.col("category").isNotNull(), F.struct((-F.col("importance")).alias("o"), F.col("category").alias("c"), part.alias("t")))))
    return named.groupBy("base").agg(F.sum("importance").alias("importance"), F.array_join(F.transform(listed, lambda s: s["t"]), "; ").alias("category_breakdown"))


def contribution_table(importances: DataFrame, limit: int = 5) -> DataFrame:
    """Strongest features and their percent of what is listed."""
    top = importances.orderBy(F.desc("importance"), "feature").limit(limit)
    total = top.agg(F.sum("importance").alias("_t"))
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
    return with_scalars(top, total).select("feature", "importance", (F.col("importance") / F.col("_t") * 100).alias("contribution_pct"), place.alias("place"))


def cumulative_importance(importances: DataFrame, share: float = 0.8, fallback: int = 10) -> DataFrame:
    """Features by importance with their running share; ``selected`` are those within ``share``, or the
    first few where even the first feature exceeds it. One row per feature."""
    order = Window.orderBy(F.desc("importance"), "feature")
    whole = Window.partitionBy()
    upto = F.coalesce(F.try_divide(F.sum("importance").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("importance").over(whole)), F.lit(0.0))
    rows = importances.select("feature", "importance", upto.alias("cumulative"), F.row_number().over(order).alias("place"))
    any_inside = F.max((F.round("cumulative", 12) <= share).cast("int")).over(whole)
    chosen = F.when(any_inside == 1, F.round("cumulative", 12) <= share).otherwise(F.col("place") <= fallback)
    return rows.withColumn("selected", chosen.cast("int"))


def scenario(df: DataFrame, coefficients: Mapping[str, float], percent: float, raise_outcome: bool = True) -> DataFrame:
    """Features moved by ``percent`` in the direction that their coefficient asks for."""
    step = percent / 100.0
    def factor(c):
        up = (c >= 0) == raise_outcome
        return 1 + step if up else 1 - step
    return df.withColumns({f: F.col(f).cast("double") * F.lit(factor(c)) for f, c in coefficients.items()})


def shift_weights(base: DataFrame, moved: DataFrame, keys: Sequence[str], features: Sequence[str], strength: float = 1.0) -> DataFrame:
    """Row weight 1 + strength x shift / largest shift between a row and its scenario."""
    both = base.select(*keys, *features).join(moved.select(*keys, *[F.col(f).alias(f"_m_{f}") for f in features]), list(keys))
    shift = sum((F.abs(F.col(f"_m_{f}") - F.col(f)) for f in features), F.lit(0.0))
    rows = both.select(*keys, shift.alias("_shift"))
    top = one_row(rows, F.max("_shift").alias("_top"))
    return with_scalars(rows, top).select(*keys, (F.lit(1.0) + F.coalesce(F.try_divide("_shift", "_top"), F.lit(0.0)) * strength).alias("row_weight"))


def class_weights(df: DataFrame, outcome: str, bad=None, boost: float = 1.75) -> DataFrame:
    """Balanced class weights, with the bad class raised further."""
    counts = df.groupBy(outcome).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weight = F.col("_all") / (F.col("_k") * F.col("_n"))
    if bad is not None:
        weight = weight * F.when(F.col(outcome) == bad, F.lit(boost)).otherwise(F.lit(1.0))
    return with_scalars(counts, total).select(outcome, weight.alias("class_weight"))


@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str
    threshold: float


@dataclass(frozen=True)
class Path:
    """A way from the root of a tree to one of its leaves."""
    leaf: int
    conditions: tuple[Condition, ...]
    prediction: float
    samples: float
    purity: float = 1.0


def tree_paths(model, features: Sequence[str]) -> list[Path]:
    """Paths of a fitted Spark decision tree. The tree is read node by node; its size is bounded by
    its depth and does not depend on the data."""
    root = model._call_java("rootNode")
    out: list[Path] = []

    def walk(node, taken):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = node.impurityStats()
            count = float(stats.count())
            values = [float(x) for x in stats.stats()]
            purity = max(values) / sum(values) if model.__class__.__name__.startswith("DecisionTreeClass") and sum(values) else 1.0
            out.append(Path(len(out), tuple(taken), float(node.prediction()), count, purity))
            return
        split = node.split()
        name, mark = features[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), [*taken, Condition(name, "<=", mark)])
        walk(node.rightChild(), [*taken, Condition(name, ">", mark)])

    walk(root, [])
    return out


def region_coverage(df: DataFrame, paths: Sequence[Path], target: str) -> DataFrame:
    """Rows, share, mean and 10th and 90th percentile of the target inside each path, from one pass
    that sends each row to the paths it satisfies (one per tree)."""
    def test(path):
        hit = F.lit(True)
        for c in path.conditions:
            value = F.col(c.feature).cast("double")
            hit = hit & (value <= c.threshold if c.operator == "<=" else value > c.threshold)
        return F.coalesce(hit, F.lit(False))

    inside = F.array_compact(F.array(*[F.when(test(p), F.lit(p.leaf)) for p in paths]))
    rows = df.select(F.col(target).cast("double").alias("_y"), F.explode(inside).alias("leaf"))
    stats = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.avg("_y").alias("mean_target"))
    marks = exact_quantiles(rows, "_y", {"target_p10": 0.10, "target_p90": 0.90}, ["leaf"], few_groups=True)
    total = df.agg(F.count("*").alias("_all"))
    return with_scalars(stats.join(F.broadcast(marks), "leaf", "left"), total).select(
        "leaf", "n", (F.col("n") / F.col("_all")).alias("coverage"), "mean_target", "target_p10", "target_p90")


def tightest_bounds(conditions: DataFrame, encoding: DataFrame | None = None) -> DataFrame:
    """What the conditions of each leaf amount to: ``leaf``, ``feature``, ``operator`` and ``threshold``
    or ``category``.

    Of several conditions on one side of a feature the narrowest counts. ``encoding`` (feature, base,
    category) names the columns that stand for one category each, a table the schema bounds; a
    condition on such a column says that its base is, or is not, that category.
    """
    plain = conditions.select("leaf", "feature", "operator", "threshold", F.lit(None).cast("string").alias("category"))
    if encoding is not None:
        known = encoding.select(F.col("feature").alias("_f"), F.col("base").alias("_base"), F.col("category").alias("_category"))
        joined = conditions.join(F.broadcast(known), F.col("feature") == F.col("_f"), "left")
        is_category = F.col("_f").isNotNull() & F.col("threshold").between(0, 1)
        plain = joined.select("leaf", F.when(is_category, F.col("_base")).otherwise(F.col("feature")).alias("feature"),
                              F.when(~is_category, F.col("operator")).when(F.col("operator") == ">", "=").otherwise("!=").alias("operator"),
                              F.when(~is_category, F.col("threshold")).alias("threshold"), F.when(is_category, F.col("_category")).alias("category"))
    return plain.groupBy("leaf", "feature", "operator", "category").agg(F.min("threshold").alias("_low"), F.max("threshold").alias("_high")) \
        .select("leaf", "feature", "operator", F.when(F.col("operator") == "<=", F.col("_low")).otherwise(F.col("_high")).alias("threshold"), "category")


def contradictions(bounds: DataFrame) -> DataFrame:
    """``leaf``, ``feature`` and ``reason`` where the conditions of a leaf leave no value."""
    pick = lambda o, c: F.when(F.col("operator") == o, F.col(c))
    sides = bounds.groupBy("leaf", "feature").agg(
        F.max(pick(">", "threshold")).alias("above"), F.min(pick("<=", "threshold")).alias("upto"),
        F.collect_set(pick("=", "category")).alias("wanted"), F.collect_set(pick("!=", "category")).alias("excluded"))
    reason = (F.when(F.col("above") >= F.col("upto"), "empty interval").when(F.size("wanted") > 1, "several categories at once")
              .when(F.arrays_overlap("wanted", "excluded"), "category wanted and excluded"))
    return sides.select("leaf", "feature", reason.alias("reason")).where("reason IS NOT NULL")


# What a region gains and loses as an example.
SHARE_CAP, SHARE_GAIN, TOP_FEATURE_GAIN, TOP_FEATURES = 0.25, 4.0, 0.35, 3
REPEAT_LOSS, FOCUS_FREE, CONTRADICTION_LOSS, SHORT_LOSS, SHORT_BELOW = 0.15, 0.60, 2.0, 0.5, 2


def region_scores(conditions: DataFrame, total: float, top_features: Sequence[str] = (), high: bool = True, encoding: DataFrame | None = None) -> DataFrame:
    """How well each leaf serves as an example of a high (or low) region: ``leaf`` and ``region_score``.

    Size and leading features speak for a leaf; repeated features, one feature that makes up most
    of the way, contradictions and a way of hardly any condition speak against it.
    """
    uses = conditions.groupBy("leaf", "feature").agg(F.count("*").alias("n"))
    ways = uses.groupBy("leaf").agg(F.sum("n").alias("steps"), F.count("*").alias("features"), F.max("n").alias("most"))
    leaves = conditions.groupBy("leaf").agg(F.max("prediction").alias("prediction"), F.max("samples").alias("samples"))
    bounds = tightest_bounds(conditions, encoding)
    leading = F.col("feature").isin(list(top_features)[:TOP_FEATURES])
    tidy = bounds.groupBy("leaf").agg(F.count("*").alias("left"), F.count_distinct(F.when(leading, F.col("feature"))).alias("leading"))
    wrong = contradictions(bounds).select("leaf").distinct().withColumn("wrong", F.lit(True))
    rows = leaves.join(ways, "leaf").join(tidy, "leaf").join(wrong, "leaf", "left")
    gain = F.least(F.col("samples") / max(total, 1), F.lit(SHARE_CAP)) * SHARE_GAIN + F.col("leading") * TOP_FEATURE_GAIN
    loss = (F.col("steps") - F.col("features")) * REPEAT_LOSS + F.greatest(F.col("most") / F.col("steps") - FOCUS_FREE, F.lit(0.0)) \
        + F.when(F.col("wrong"), CONTRADICTION_LOSS).otherwise(0.0) + F.when(F.col("left") < SHORT_BELOW, SHORT_LOSS).otherwise(0.0)
    return rows.select("leaf", (F.col("prediction") * (1 if high else -1) + gain - loss).alias("region_score"))


def extreme_leaves(conditions: DataFrame) -> DataFrame:
    """One row: the leaves with the lowest and the highest prediction whose conditions can be met (ties
    to the lower and the higher number) and the share of conditions that both have."""
    usable = conditions.join(contradictions(tightest_bounds(conditions)).select("leaf").distinct(), "leaf", "left_anti")
    ends = usable.agg(F.min(F.struct("prediction", "leaf"))["leaf"].alias("low"), F.max(F.struct("prediction", "leaf"))["leaf"].alias("high"))
    marked = usable.join(F.broadcast(ends), F.col("leaf").isin(F.col("low"), F.col("high")))
    shared = marked.groupBy("low", "high", "feature", "operator", "threshold").agg(F.count_distinct("leaf").alias("n"))
    return shared.groupBy("low", "high").agg((F.count_if((F.col("n") == 2) | (F.col("low") == F.col("high"))) / F.count("*")).alias("similarity"))


def path_costs(paths: Sequence[Path], weights: Mapping[str, float], alpha: float = 0.5) -> list[tuple[Path, float, float]]:
    """Paths by rising cost: feature weights on the way minus ``alpha`` times the shares of samples
    passed. Returns path, cost and weight sum. Sample counts of inner nodes are those of their leaves."""
    total = sum(p.samples for p in paths) or 1.0

    def passed(prefix):
        return sum(p.samples for p in paths if p.conditions[: len(prefix)] == prefix)

    out = []
    for p in paths:
        sums = sum(weights.get(c.feature, 0.0) for c in p.conditions)
        shares = sum(passed(p.conditions[:i]) for i in range(len(p.conditions) + 1)) / total
        out.append((p, sums - alpha * shares, sums))
    return sorted(out, key=lambda x: (x[1], x[0].leaf))


def path_table(spark, paths: Sequence[Path]) -> DataFrame:
    rows = [(p.leaf, i + 1, c.feature, c.operator, float(c.threshold), float(p.prediction), float(p.samples), float(p.purity)) for p in paths for i, c in enumerate(p.conditions)]
    return spark.createDataFrame(rows, "leaf int, step int, feature string, operator string, threshold double, prediction double, samples double, purity double")


def ranked_rules(rules: DataFrame, per_class: int = 3) -> DataFrame:
    """Best rules per class, one direction per feature, and no rule that both classes claim.

    ``rules``: class, feature, direction, samples, depth, purity, impurity_reduction; a table of
    tree conditions, small by construction.
    """
    reward = F.col("samples") * 0.6 + F.col("depth") * 0.2 + F.col("purity") * 0.2 + F.coalesce("impurity_reduction", F.lit(0.0)) * 0.2
    rows = rules.withColumn("score", reward)
    best = [F.desc("score"), F.desc("samples"), F.desc("depth"), "direction"]
    one = F.row_number().over(Window.partitionBy("class", "feature").orderBy(*best))
    kept = rows.withColumn("_i", one).where("_i = 1").drop("_i")
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), F.desc("samples"), "feature"))
    kept = kept.withColumn("_p", place).where(F.col("_p") <= per_class).drop("_p")
    owner = F.row_number().over(Window.partitionBy("feature", "direction").orderBy(F.desc("score"), "class"))
    kept = kept.withColumn("_o", owner).where("_o = 1").drop("_o")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), F.desc("samples"), "feature")))


def linear_attributions(df: DataFrame, coefficients: Mapping[str, float], intercept: float, keys: Sequence[str]) -> DataFrame:
    """Share of each feature in a logistic prediction per row: coef x (x - mean), turned to probability
    by p(1 - p)."""
    means = one_row(df, *[F.avg(F.col(f).cast("double")).alias(f"_mean_{f}") for f in coefficients])
    rows = with_scalars(df, means)
    logit = sum((F.col(f).cast("double") * F.lit(c) for f, c in coefficients.items()), F.lit(float(intercept)))
    rows = rows.withColumn("probability", 1.0 / (1.0 + F.exp(-logit)))
    slope = F.col("probability") * (1.0 - F.col("probability"))
    return rows.select(*keys, "probability", *[(F.lit(c) * (F.col(f).cast("double") - F.col(f"_mean_{f}")) * slope).alias(f"attr_{f}")
                                               for f, c in coefficients.items()])


def global_attributions(local: DataFrame) -> DataFrame:
    """Signed mean attribution per feature, strongest first."""
    names = [c for c in local.columns if c.startswith("attr_")]
    cells = [F.struct(F.lit(n[5:]).alias("feature"), F.avg(n).alias("mean_attribution")) for n in names]
    rows = local.agg(F.array(*cells).alias("_a")).select(F.inline("_a"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("mean_attribution")), "feature")))


def prefixed(paths: Sequence[Path], start: int) -> list[Path]:
    """Renumber leaves so that paths of several trees can share a table."""
    return [replace(p, leaf=p.leaf + start) for p in paths]
