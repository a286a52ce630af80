"""Difficulty tiers with MLlib: features, training, selection, scoring, storage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnway import lexicon as lx
from cairnway.operators import quality
from cairnway.session import cut, stored

CONTRACT = "trail-tier-features-v1"
RARE = "<RARE>"
KEPT = ["contract", "model_name", "classes", "class_index", "numbers", "levels", "metrics", "majority_baseline_metrics"]
# How many rows a level needs, what is searched, what is dropped in turn.
LEVEL_ROWS = 5
SENT_LEVELS = 100_000
# Fits under way at once; each is many short jobs, so one alone leaves most cores idle.
FITS = 4
PRIOR_STRENGTHS = [0.0, 0.15, 0.25, 0.35, 0.5, 0.75, 1.0]
ESTIMATORS = ["logistic", "forest", "boosted"]
FEATURE_GROUPS = {
    "route_shape": ["mean_turn", "verts_per_km"],
    "terrain": ["elevation_gain_m", "elevation_loss_m", "elevation_range_m", "average_slope_pct", "max_slope_pct", "terrain_available"],
    "geometry": ["length_km", *lx.DERIVED],
    "tagging": lx.CATEGORICAL,
    "measured_attributes": ["incline_pct", "width_m", "incline_numeric_missing", "width_missing"],
}
NUMBERS = [*lx.NUMERIC, *lx.DERIVED]


def feature_rows(sample: DataFrame, tags: DataFrame, shape: DataFrame, terrain: DataFrame) -> DataFrame:
    """One row per way with every predictor; a source without the way leaves NULLs."""
    joined = (
        sample.select("feature_id", "tier", "sac_scale", "length_km", "latitude", "longitude", "grid_x", "grid_y")
        .join(tags, "feature_id")
        .join(shape, "feature_id", "left")
        .join(terrain, "feature_id", "left")
        .na.fill(0.0, ["terrain_available"])
    )
    return quality.derive(joined)


def tier_index(column: str = "tier") -> Column:
    return (F.array_position(F.array(*map(F.lit, lx.TIERS)), F.col(column)) - 1).cast("double")


def tier_name(index: str = "prediction") -> Column:
    return F.element_at(F.array(*map(F.lit, lx.TIERS)), F.col(index).cast("int") + 1)


def common_levels(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level) of the levels seen five times or more in training, counted in one pass."""
    levels = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns])))
    seen = levels.where("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("_n"))
    return cut(seen.where(F.col("_n") >= LEVEL_ROWS).select("column", "level"))


def pooled(common: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Levels that are not common in training become one level."""
    # A list that a task can hold goes to the rows; a longer one meets them in a shuffle.
    few = common.count() <= SENT_LEVELS
    for column in columns:
        known = common.where(F.col("column") == column).select(F.col("level").alias(column), F.lit(True).alias("_known"))
        rows = rows.join(F.broadcast(known) if few else known, column, "left").withColumn(
            column, F.when(F.col("_known"), F.col(column)).otherwise(RARE)
        ).drop("_known")
    return rows


def estimator(kind: str, weight: str):
    if kind == "logistic":
        return LogisticRegression(weightCol=weight, maxIter=50, family="multinomial")
    if kind == "forest":
        return RandomForestClassifier(weightCol=weight, numTrees=300, minInstancesPerNode=2, seed=20260927)
    if kind == "boosted":
        trees = GBTClassifier(maxIter=50, maxDepth=5, stepSize=0.1, subsamplingRate=0.9, seed=20260927)
        return OneVsRest(classifier=trees, weightCol=weight)
    raise ValueError(kind)


def pipeline(model, numbers: list[str], levels: list[str]) -> Pipeline:
    """Median fill and scaling for numbers, indexed one-hot levels, then the classifier."""
    filled = [f"{c}_f" for c in numbers]
    stages = [
        Imputer(strategy="median", inputCols=numbers, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]
    inputs = ["_scaled"]
    if levels:
        stages += [
            StringIndexer(inputCols=levels, outputCols=[f"{c}_i" for c in levels], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in levels], outputCols=[f"{c}_v" for c in levels]),
        ]
        inputs += [f"{c}_v" for c in levels]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages + ([model] if model is not None else []))


def usable(train: DataFrame, drop: list[str] = ()) -> tuple[list[str], list[str]]:
    """(numbers, levels) to train on, without the columns of ``drop``."""
    numbers = [c for c in NUMBERS if c not in drop]
    # A number that training never saw cannot be filled, so it is left out.
    seen = train.agg(*[F.count(c).alias(c) for c in numbers]).first()
    return [c for c in numbers if seen[c]], [c for c in lx.CATEGORICAL if c not in drop]


def fit(train: DataFrame, prior: DataFrame, strength: float, kind: str, drop: list[str] = ()) -> PipelineModel:
    """Train on graded rows weighted towards the natural shares."""
    numbers, levels = usable(train, drop)
    weighted = quality.row_weights(train, prior, strength).withColumn("label", tier_index())
    return pipeline(estimator(kind, "weight"), numbers, levels).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("predicted_tier", tier_name())


def metrics(model: PipelineModel, rows: DataFrame, weight: Column | None = None) -> DataFrame:
    scored = predict(model, rows).select(
        F.col("tier").alias("label"), F.col("predicted_tier").alias("prediction"),
        (F.lit(1.0) if weight is None else weight).alias("weight"),
    )
    return quality.weighted_metrics(scored)


def prior_weight(rows: DataFrame, prior: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(prior.withColumnRenamed("share", "natural_share")), "tier")


def prepared(train: DataFrame, held: DataFrame, drop: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with the predictor vector that ``train`` gives, written once for all that is fitted on it."""
    prep = pipeline(None, *usable(train, drop)).fit(train)
    both = [prep.transform(rows).select("tier", tier_index().alias("label"), "natural_share", "features") for rows in (train, held)]
    return stored(both[0], "train"), stored(both[1], "held")


def validated(train: DataFrame, held: DataFrame, prior: DataFrame, strength: float, kind: str) -> dict[str, float]:
    """Metrics on ``held`` of a classifier of ``prepared`` rows; three figures come back."""
    model = estimator(kind, "weight").fit(quality.row_weights(train, prior, strength))
    found = metrics(model, held, F.col("natural_share")).where("tier = 'all'").select("metric", "value")
    return {r["metric"]: r["value"] for r in found.collect()}


def side_by_side(run: Callable[..., dict], tasks: Iterable[tuple]) -> list[dict]:
    """``run`` of every task, some at once, in the order of the tasks."""
    with ThreadPool(FITS) as pool:
        return pool.starmap(inheritable_thread_target(run), tasks)


def search(rows: DataFrame, prior: DataFrame, kinds: list[str], strengths: list[float], folds: int) -> DataFrame:
    """Mean validation metrics per estimator and strength, and which candidate is chosen.

    ``rows`` carries its fold. Chosen is the best macro F1 among candidates that beat the
    weighted majority baseline; the loop runs over candidates, never over rows.
    """
    rows = stored(prior_weight(rows, prior), "searched")
    sides = [prepared(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)) for fold in range(folds)]
    tasks = [(kind, strength, fold) for kind in kinds for strength in strengths for fold in range(folds)]
    found = side_by_side(lambda kind, strength, fold: validated(*sides[fold], prior, strength, kind), tasks)
    result = rows.sparkSession.createDataFrame(
        [(kind, strength, fold, one["accuracy"], one["macro_f1"]) for (kind, strength, fold), one in zip(tasks, found)],
        "estimator string, strength double, fold int, accuracy double, macro_f1 double",
    )
    means = result.groupBy("estimator", "strength").agg(F.avg("accuracy").alias("accuracy"), F.avg("macro_f1").alias("macro_f1"))
    lead = F.max_by("tier", "share")
    majority = prior.agg(lead.alias("lead"))
    base = (
        rows.join(F.broadcast(majority))
        .groupBy("fold")
        .agg((F.sum(F.when(F.col("tier") == F.col("lead"), F.col("natural_share")).otherwise(0.0)) / F.sum("natural_share")).alias("a"))
        .agg(F.avg("a").alias("baseline"))
    )
    with_base = means.join(F.broadcast(base)).withColumn("eligible", F.col("accuracy") > F.col("baseline"))
    best = with_base.where("eligible").agg(F.max("macro_f1").alias("best"))
    return with_base.join(F.broadcast(best)).withColumn(
        "chosen", F.col("eligible") & F.coalesce(F.col("macro_f1") == F.col("best"), F.lit(False))
    ).drop("best")


def ablate(rows: DataFrame, prior: DataFrame, kind: str, strength: float, folds: int) -> DataFrame:
    """Macro F1 given up when each group of features is left out, on the same folds."""
    rows = stored(prior_weight(rows, prior), "searched")

    def one(left_out: str, fold: int) -> dict[str, float]:
        sides = prepared(rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold), groups[left_out])
        return validated(*sides, prior, strength, kind)

    groups = {"none": [], **FEATURE_GROUPS}
    tasks = [(name, fold) for name in groups for fold in range(folds)]
    result = rows.sparkSession.createDataFrame(
        [(name, found["macro_f1"]) for (name, _), found in zip(tasks, side_by_side(one, tasks))], "left_out string, value double"
    )
    means = result.groupBy("left_out").agg(F.avg("value").alias("macro_f1"))
    whole = means.where("left_out = 'none'").select(F.col("macro_f1").alias("whole"))
    return means.join(F.broadcast(whole)).withColumn("given_up", F.col("whole") - F.col("macro_f1")).drop("whole")


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Tier and probabilities per way; without a length there is no estimate."""
    usable = rows.where(F.col("length_km").isNotNull())
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in lx.NUMERIC]))
    ready = usable.withColumn("missing_features", missing)
    out = predict(model, ready)
    if "probability" in out.columns:
        chances = vector_to_array("probability")
        out = out.withColumns({f"p_{t}": F.round(chances[i], 4) for i, t in enumerate(lx.TIERS)})
    covered = 1.0 - F.size("missing_features") / F.lit(float(len(lx.NUMERIC)))
    return out.withColumn("coverage", F.round(covered, 4))


def majority(rows: DataFrame, prior: DataFrame, weight: Column) -> DataFrame:
    """Metrics of always saying the tier that is most common in nature."""
    lead = F.broadcast(prior.agg(F.max_by("tier", "share").alias("prediction")))
    return quality.weighted_metrics(rows.join(lead).select(F.col("tier").alias("label"), "prediction", weight.alias("weight")))


def report(model: DataFrame, baseline: DataFrame, prior: DataFrame, trained_rows: int) -> dict:
    """What is kept beside a model: its figures, the majority's, whether they are beaten, and what it was trained on."""
    figures = lambda found: {f"{r['metric']} {r['tier']}": r["value"] for r in found.collect()}
    a, b = figures(model), figures(baseline)
    return {
        "metrics": a,
        "majority_baseline_metrics": b,
        "usefulness_gate_passed": all((a[m] or 0.0) > (b[m] or 0.0) for m in ("accuracy all", "macro_f1 all")),
        "natural_tier_distribution": {r["tier"]: r["share"] for r in prior.collect()},
        "trained_rows": trained_rows,
    }


def save(model: PipelineModel, path: str, spark, kind: str, found: dict) -> None:
    """Model files and one metadata row beside them: what it serves, what it needs and how it did."""
    model.write().overwrite().save(f"{path}/model")
    document = json.dumps({
        "contract": CONTRACT, "model_name": f"{kind}_difficulty_tier", "classes": lx.TIERS,
        "class_index": {tier: i for i, tier in enumerate(lx.TIERS)}, "numbers": NUMBERS, "levels": lx.CATEGORICAL, **found,
    })
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load(path: str, spark) -> tuple[PipelineModel, dict]:
    """The model and its metadata; refuses one made for other classes, features or another contract, or without its figures."""
    found = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    absent = [key for key in KEPT if key not in found]
    if absent:
        raise ValueError(f"model lacks {absent}")
    if found["contract"] != CONTRACT or found["classes"] != lx.TIERS:
        raise ValueError(f"model was made for {found['contract']} / {found['classes']}")
    if found["class_index"] != {tier: i for i, tier in enumerate(lx.TIERS)}:
        raise ValueError(f"model numbers its classes otherwise: {found['class_index']}")
    if found["numbers"] != NUMBERS or found["levels"] != lx.CATEGORICAL:
        raise ValueError(f"model was made for the features {found['numbers']} / {found['levels']}")
    return PipelineModel.load(f"{path}/model"), found
