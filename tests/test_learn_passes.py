"""Training passes read stored rows: small tables are sent along, never met in a shuffle of the rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnway.operators import learn, quality
from cairnway.plans import p09_learn
from cairnway.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")
def test_graded_rows_are_not_shuffled(spark):
    assert shuffles(p09_learn.graded(Tables(spark, FOLDER))) == 0


def test_rare_and_missing_levels_become_one(spark):
    rows = [("a", "x")] * 5 + [("b", "x")] * 4 + [(None, "y")] * 6
    train = spark.createDataFrame(rows, "u string, v string")
    got = learn.pooled(learn.common_levels(train, ["u", "v"]), train, ["u", "v"])
    assert shuffles(got) == 0
    counts = {(r["u"], r["v"]): r["n"] for r in got.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {("a", "x"): 5, (learn.RARE, "x"): 4, (learn.RARE, "y"): 6}


def test_every_test_row_of_one_place_has_its_distance(spark):
    test = spark.createDataFrame([(1, 46.0, 8.0), (2, 46.0, 8.0), (3, None, 8.0)], "feature_id long, lat double, lon double")
    train = spark.createDataFrame([(46.0, 8.001), (47.0, 8.0)], "lat double, lon double")
    got = {r["feature_id"]: r["km"] for r in quality.nearest_km(test, train).collect()}
    assert got[1] == got[2] and 0 < got[1] < 0.1 and got[3] is None
