import random

import pytest
from pyspark.sql import functions as F

from quire.operators import ordering
from quire.storage import Bucketed, Stored, release


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_are_exact_over_many_partitions(spark, adaptive):
    names = ["spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in zip(names, [adaptive, "9", "200k", "20k"], strict=True):
            spark.conf.set(k, v)
        df = spark.range(400_000).select(F.xxhash64("id").alias("k"), "id", F.concat(F.lit("payload "), F.col("id") * 7).alias("text"))
        got = ordering.numbered(df, ["k", "id"], "place")
        path = Stored(got, "got").df
        assert path.count() == 400_000 and path.select("id").distinct().count() == 400_000
        rows = path.select("place", "k", "id", "text").orderBy("place").toPandas()
        assert rows["place"].tolist() == list(range(1, 400_001))
        assert rows["k"].is_monotonic_increasing and (rows["text"] == "payload " + (rows["id"] * 7).astype(str)).all()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ties_and_empty_tables_are_numbered(spark):
    rows = [(random.Random(3).randrange(4), i) for i in range(50)]
    got = ordering.numbered(spark.createDataFrame(rows, "a int, b int"), ["a"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 51))
    assert ordering.numbered(spark.createDataFrame([], "a int, b int"), ["a"], "n").count() == 0


def test_levels_of_deep_and_wide_trees(spark):
    tree = [(0, -1), (500, -1)] + [(i, i - 1) for i in range(1, 30)] + [(1000 + i, 500) for i in range(300)]
    got = {r["id"]: r["level"] for r in ordering.tree_levels(spark.createDataFrame(tree, "id int, parent int"), 20).collect()}
    assert got == {i: min(20, i + 1) for i in range(30)} | {500: 1} | {1000 + i: 2 for i in range(300)}


def test_buckets_are_joined_without_a_shuffle(spark):
    held = Bucketed(spark.range(1000).selectExpr("id % 50 as k", "id"), ["k"], "b")
    both = held.df.hint("merge").join(spark.range(50).selectExpr("id as k", "id * 2 as v"), "k")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and both.where("v = 2 * k").count() == 1000
    assert held.path in Stored.held
    release(spark)
    assert held.path not in Stored.held
