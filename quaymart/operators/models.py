"""Candidate models, the leakage-safe logistic model and the weighted tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import audit_leakage
from ..session import shared
from .attribution import class_weights
from .cleaning import filled_with_medians
from .columns import is_numeric
from .evaluation import auc, best_threshold, confusion, threshold_search
from .sampling import stratified_split
from .scale import with_scalars

SEED = 42


def _packed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def _probability(scored: DataFrame) -> DataFrame:
    return scored.withColumn("p", vector_to_array("probability")[1])


def candidate_classifiers(seed: int = SEED) -> dict:
    """Two boosted ensembles, a forest and a logistic model, the last two with class weights."""
    return {
        "boosted_primary": GBTClassifier(labelCol="y", maxIter=30, maxDepth=4, stepSize=0.1, subsamplingRate=0.9, seed=seed),
        "boosted_compact": GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, stepSize=0.15, subsamplingRate=0.95, seed=seed + 7),
        "forest_balanced": RandomForestClassifier(labelCol="y", weightCol="class_weight", numTrees=60, maxDepth=8, minInstancesPerNode=2, seed=seed),
        "logistic_balanced": LogisticRegression(labelCol="y", weightCol="class_weight", maxIter=100)}


def compare_classifiers(df: DataFrame, outcome: str, features: Sequence[str], keys: Sequence[str], good=1,
                        names: Sequence[str] | None = None) -> tuple[DataFrame, dict]:
    """Fit the candidates on 70%, choose threshold and model on 10%, report on the held-out 20%.

    Column names that betray the outcome are left out; gaps take training medians. Returns one row
    per candidate and the fitted models.
    """
    banned = set(audit_leakage(list(features), outcome).suspected)
    features = [f for f in features if f not in banned]
    # Every round of the split reads the rows, and every measure of a model its scores: both are computed once.
    rows = shared(df.select(*keys, *features, (F.col(outcome) != good).cast("double").alias("y")))
    split = stratified_split(rows, "y", keys).persist()
    train, medians = filled_with_medians(split.where("part = 0"), features)
    weights = class_weights(train, "y")
    train = _packed(train.join(F.broadcast(weights), "y"), features).persist()
    held = {part: _packed(filled_with_medians(split.where(f"part = {part}"), features, medians)[0], features).persist() for part in (1, 2)}
    chosen = {n: c for n, c in candidate_classifiers().items() if names is None or n in names}
    fitted, report = {}, None
    for name, estimator in chosen.items():
        model = estimator.fit(train)
        checked, tested = (shared(_probability(model.transform(held[part])).select("y", "p")) for part in (1, 2))
        pick = best_threshold(threshold_search(checked, "y", "p"), auc(checked, "y", "p"))
        judged = with_scalars(tested, pick.select(F.col("threshold").alias("_t"))).withColumn("hat", (F.col("p") >= F.col("_t")).cast("double"))
        test = with_scalars(confusion(judged, "y", "hat").select(*[F.col(c).alias(f"test_{c}") for c in ("accuracy", "precision", "recall")]),
                            auc(tested, "y", "p").select(F.col("auc").alias("test_auc")))
        row = with_scalars(pick, test).withColumn("model", F.lit(name))
        report = row if report is None else report.unionByName(row)
        fitted[name] = model
    return report, fitted


def importance_table(spark, model, features: Sequence[str]) -> DataFrame:
    """Importance per feature of a fitted model; coefficients count by size."""
    raw = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, raw.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double")


def regression_predictions(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str], rounds: int = 20,
                           seed: int = SEED) -> DataFrame:
    """Boosted trees on log1p of a non-negative target; predictions for the held-out fifth."""
    rows = df.select(*keys, *features, F.log1p(F.col(target).cast("double")).alias("label"), F.col(target).cast("double").alias("actual"), F.lit(0).alias("_all"))
    split = stratified_split(rows, "_all", keys, (0.8, 0.2), seed)
    packed = _packed(split, features)
    model = GBTRegressor(labelCol="label", maxIter=rounds, maxDepth=5, seed=seed).fit(packed.where("part = 0"))
    return model.transform(packed.where("part = 1")).select(*keys, "actual", F.expm1("prediction").alias("predicted"))


def safe_logistic(df: DataFrame, outcome: str, features: Sequence[str], keys: Sequence[str], seed: int = SEED) -> tuple[DataFrame, object]:
    """Logistic model behind imputation, scaling and encoding fitted on the training part only."""
    banned = set(audit_leakage(list(features), outcome, keys[0] if keys else None).suspected)
    used = [f for f in features if f not in banned]
    numbers = [f for f in used if is_numeric(df, f)]
    texts = [f for f in used if f not in numbers]
    rows = df.where(F.col(outcome).isNotNull()).select(*keys, *texts, *[F.col(f).cast("double").alias(f) for f in numbers], F.col(outcome).cast("double").alias("y"))
    split = stratified_split(shared(rows), "y", keys, (0.8, 0.2), seed)
    stages = []
    if numbers:
        stages += [Imputer(inputCols=numbers, outputCols=[f"{f}_full" for f in numbers], strategy="median"),
                   VectorAssembler(inputCols=[f"{f}_full" for f in numbers], outputCol="numbers"),
                   StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    if texts:
        stages += [StringIndexer(inputCols=texts, outputCols=[f"{t}_i" for t in texts], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{t}_i" for t in texts], outputCols=[f"{t}_v" for t in texts], handleInvalid="keep")]
    stages += [VectorAssembler(inputCols=[*(["scaled"] if numbers else []), *[f"{t}_v" for t in texts]], outputCol="features"),
               LogisticRegression(labelCol="y", maxIter=100)]
    model = Pipeline(stages=stages).fit(split.where("part = 0"))
    scored = _probability(model.transform(split.where("part = 1"))).select(*keys, "y", "p", "prediction")
    return scored, model


def weighted_tree(df: DataFrame, target: str, features: Sequence[str], importance: dict[str, float], classification: bool = True,
                  weight: str | None = None, depth: int = 4, seed: int = SEED):
    """Single tree on features scaled by their importance. A path's threshold is in scaled units; use
    ``unscaled`` to read it in the units of the data."""
    scaled = df.withColumns({f: F.col(f).cast("double") * F.lit(float(importance.get(f, 1.0))) for f in features}).withColumn("y", F.col(target).cast("double"))
    kind = DecisionTreeClassifier if classification else DecisionTreeRegressor
    tree = kind(labelCol="y", maxDepth=depth, minInstancesPerNode=5, seed=seed)
    if weight:
        tree = tree.setWeightCol(weight)
    return tree.fit(_packed(scaled, features))


def unscaled(paths, importance: dict[str, float]):
    """Paths of a weighted tree with thresholds in the units of the data."""
    from dataclasses import replace

    back = lambda c: replace(c, threshold=c.threshold / (importance.get(c.feature, 1.0) or 1.0))
    return [replace(p, conditions=tuple(back(c) for c in p.conditions)) for p in paths]
