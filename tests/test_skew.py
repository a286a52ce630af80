"""The split paths give what the plain windows give, on a table where one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from cairnway import skew


@pytest.fixture(scope="module")
def rows(spark):
    # Key 0 holds two thirds of the rows.
    return spark.range(900).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).cast("long").alias("k"),
        F.xxhash64("id").alias("o"),
        F.col("id").alias("v"),
    )


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


def numbered(rows):
    return skew.position(rows, ["k"], [F.col("o")], "pos")


def test_position(rows):
    same(numbered(rows), skew.position(rows, ["k"], [F.col("o")], "pos", bound=10))


def test_neighbours(rows):
    given = numbered(rows)
    args = dict(following={"v": "n"}, preceding={"v": "p"})
    same(
        skew.with_neighbours(given, ["k"], "pos", **args),
        skew.with_neighbours(given, ["k"], "pos", **args, bound=10),
    )
    sparse = given.where("v % 5 <> 0")
    same(
        skew.with_neighbours(sparse, ["k"], "pos", **args, dense=False),
        skew.with_neighbours(sparse, ["k"], "pos", **args, dense=False, bound=10),
    )


def test_frames_of_two_rows(rows):
    given = numbered(rows)
    columns = lambda w: {"m": F.sum("v").over(w.rowsBetween(-2, 2))}
    same(
        skew.framed(given, ["k"], "pos", columns, halo=2),
        skew.framed(given, ["k"], "pos", columns, halo=2, bound=10),
    )


@pytest.mark.parametrize("helper", [skew.running_total, skew.running_max])
def test_running(rows, helper):
    given = numbered(rows)
    same(helper(given, ["k"], "pos", "v", "t"), helper(given, ["k"], "pos", "v", "t", bound=10))


def test_next_value(rows):
    given = numbered(rows).withColumn("w", F.when(F.col("v") % 4 == 0, F.col("v")))
    same(
        skew.next_value(given, ["k"], "pos", "w", "n"),
        skew.next_value(given, ["k"], "pos", "w", "n", bound=10),
    )


def test_with_group(rows):
    values = {"s": F.sum("v"), "n": F.count(F.lit(1))}
    same(skew.with_group(rows, ["k"], values), skew.with_group(rows, ["k"], values, bound=10))


def test_top_per_group_limits_before_the_shuffle(rows):
    top = skew.top_per_group(rows, ["k"], [F.col("o")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3
