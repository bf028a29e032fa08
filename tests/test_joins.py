"""As-of joins, trees and lookups against plain loops, hot keys included."""

import random

import pytest

from quire.operators import joins, keys, ordering


def plain_asof(left, right, forward, first):
    out = []
    for k, i, x in left:
        near = [r for r in right if k is not None and x is not None and r[0] == k and r[1] is not None and (r[1] >= x if forward else r[1] <= x)]
        if near:
            at = (min if forward else max)(r[1] for r in near)
            out.append((k, i, x, (min if first else max)(r[2] for r in near if r[1] == at)))
        else:
            out.append((k, i, x, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("whole", [50, 10**6])
@pytest.mark.parametrize(("forward", "first"), [(False, False), (False, True), (True, False), (True, True)])
def test_asof_equals_plain_loops(spark, whole, forward, first):
    rnd = random.Random(5)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    left = [(key(), i, rnd.choice([None, *range(-5, 300)])) for i in range(400)]
    right = [(key(), rnd.choice([None, *range(20, 280, 7)]), j) for j in range(150)]
    a = spark.createDataFrame(left, "k bigint, i bigint, x bigint").repartition(3)
    b = spark.createDataFrame(right, "k bigint, s bigint, j bigint").repartition(3)
    got = joins.asof(a, b, ["k"], "x", "s", ["j"], forward=forward, first_of_ties=first, whole=whole)
    assert sorted((tuple(r) for r in got.select("k", "i", "x", "j").collect()), key=str) == plain_asof(left, right, forward, first)


def test_a_hot_key_is_in_many_tasks(spark):
    a = spark.range(20_000).selectExpr("1 as k", "id as x")
    b = spark.range(0, 20_000, 100).selectExpr("1 as k", "id as s")
    got = joins.asof(a, b, ["k"], "x", "s", ["s"], whole=1000)
    assert got.where("s = x div 100 * 100").count() == 20_000
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 2 and max(sizes) < 20_000


def plain_levels(tree, most):
    parent, out = {}, set()
    for i, p in tree:
        parent[i] = p if p is not None and p >= 0 else None
    level, home = {}, {}
    for i in parent:
        way, at = [], i
        while at is not None and at in parent and len(way) <= len(parent):
            way.append(at)
            at = parent[at]
        if at is not None:
            continue
        way.reverse()
        level[i] = min(most, len(way))
        home[i] = None if len(way) == 1 else way[most - 2] if len(way) > most else way[-2]
        out.add((i, home[i], level[i]))
    return out


def test_levels_equal_plain_loops(spark):
    rnd = random.Random(2)
    tree = [(i, rnd.choice([None, -1, rnd.randint(0, 299), i - 1, i - 1, i - 1])) for i in range(300)] + [(900, 901), (901, 900), (902, 7777)]
    got = ordering.tree_levels(spark.createDataFrame(tree, "id bigint, parent bigint"), 5)
    assert {tuple(r) for r in got.collect()} == plain_levels(tree, 5)
    assert ordering.tree_levels(spark.createDataFrame([], "id bigint, parent bigint"), 5).count() == 0
    twice = spark.createDataFrame([(1, 5), (1, None), (1, 2), (2, 1), (None, 1), (5, None)], "id bigint, parent bigint")
    assert {tuple(r) for r in ordering.tree_levels(twice, 9).collect()} == {(1, None, 1), (2, 1, 2), (5, None, 1)}


def test_a_long_chain_takes_few_rounds(spark):
    got = ordering.tree_levels(spark.range(100_000).selectExpr("id", "id - 1 as parent"), 20)
    assert got.where("level = least(20, id + 1) and parent <=> if(id = 0, null, least(18, id - 1))").count() == 100_000


def test_lookup_of_hot_keys(spark):
    a = spark.range(5000).selectExpr("id", "if(id % 2 = 0, 7, id) as k")
    b = spark.range(5000).selectExpr("id as other", "-id as v")
    got = keys.lookup(a, b, "k", "other", whole=100)
    assert got.where("v = -k").count() == 5000 == got.select("id").distinct().count()
