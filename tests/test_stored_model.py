"""A stored model keeps its figures, and one made for other features or without figures is refused."""

import json

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from cairnway import lexicon as lx
from cairnway.operators import learn


def kept(spark, path, **changes):
    """A small stored model whose metadata has ``changes``."""
    rows = spark.createDataFrame([(1.0,)], "x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features")]).fit(rows)
    scored = spark.createDataFrame([(a, b, 1.0) for a in lx.TIERS for b in lx.TIERS[:2]], "label string, prediction string, weight double")
    prior = spark.createDataFrame([(tier, 0.2 + i / 10) for i, tier in enumerate(lx.TIERS)], "tier string, share double")
    held = scored.withColumnRenamed("label", "tier")
    found = learn.report(learn.quality.weighted_metrics(scored), learn.majority(held.drop("prediction"), prior, held["weight"]), prior, 6)
    learn.save(model, path, spark, "logistic", found)
    document = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    document.update(changes)
    document = {k: v for k, v in document.items() if v is not None}
    spark.createDataFrame([(json.dumps(document),)], "value string").write.mode("overwrite").text(f"{path}/contract")


def test_figures_come_back(spark, tmp_path):
    kept(spark, str(tmp_path))
    _, found = learn.load(str(tmp_path), spark)
    assert found["trained_rows"] == 6 and found["model_name"] == "logistic_difficulty_tier"
    assert round(found["metrics"]["accuracy all"], 9) == round(1 / 3, 9) == round(found["majority_baseline_metrics"]["accuracy all"], 9)
    assert not found["usefulness_gate_passed"]


@pytest.mark.parametrize("changes", [{"numbers": ["length_km"]}, {"levels": []}, {"class_index": {}}, {"metrics": None}, {"classes": ["easy"]}])
def test_another_contract_is_refused(spark, tmp_path, changes):
    kept(spark, str(tmp_path), **changes)
    with pytest.raises(ValueError):
        learn.load(str(tmp_path), spark)
