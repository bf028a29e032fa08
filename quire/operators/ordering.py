"""Orders, places, levels and suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower
from quire.operators.keys import lookup
from quire.storage import Stored


def natural_key(c: Column) -> Column:
    """A key whose byte order is the natural order: digit runs by number, leading zeros aside, A-Z as a-z."""
    runs = F.regexp_extract_all(ascii_lower(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(x: Column) -> Column:
        n = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(n).cast("string"), 4, "0"), n)).otherwise(x)

    return F.array_join(F.transform(runs, part), "")


def numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds the place (from 1) in the order of ``by`` without gathering all rows in one task.

    Rows are range-partitioned, sorted and written once, so that a row's partition and its place there, both in its
    running id, mean the same to all who read them; the sizes of the partitions before, one number each, are added.
    """
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    rows = Stored(ranged, "numbered").df.withColumn("_p", F.shiftright("_m", 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_s"))
    before = sizes.select("_p", (F.sum("_s").over(W.orderBy("_p")) - F.col("_s")).alias("_b"))  # a row for each partition
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "_p").withColumn(out, place.cast("int")).drop("_p", "_m", "_b")


def _climbed(nodes: DataFrame, merged: Callable[[Column, Column], Column]) -> Stored:
    """(id, up, v) of nodes that arrive: up leads from node to node until it is null; v gathers what the way holds.

    By pointer doubling: each round a node takes over where the node above points to, so a way of n nodes takes log2(n)
    rounds. Nodes that have arrived are not joined again. A round in which none arrives ends it: what is left leads nowhere.
    """
    state = [Stored(nodes, "nodes")]
    parts, left = [state[0].df.where("up is null")], state[0].df.where("up is not null")
    while left.limit(1).count():
        every = parts[0]
        for p in [*parts[1:], left]:
            every = every.unionByName(p)
        above = every.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("v").alias("_v"))
        met = lookup(left, above, "up", "_id").select("id", F.col("_up").alias("up"), merged(F.col("v"), F.col("_v")).alias("v"))
        state.append(Stored(met, "nodes"))
        found = state[-1].df.where("up is null")
        if not found.limit(1).count():
            break
        parts, left = [*parts, found], state[-1].df.where("up is not null")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    out = Stored(whole, "climbed")
    for held in state:
        held.drop()
    return out


def tree_levels(tree: DataFrame, most: int) -> DataFrame:
    """(id, parent, level) of the nodes (id, parent) of an outline of at most ``most`` levels.

    A root, level 1, has a null parent or one below 0 (returned as null). A node that is deeper than ``most`` moves up to its
    nearest ancestor at the level above, so it is at level ``most``. Nodes whose parents lead to no root (unknown ones,
    circles) and null ids are left out; of rows that repeat an id a root counts first, then the least parent.
    """
    root = F.col("parent").isNull() | (F.col("parent") < 0)
    once = tree.where("id is not null").groupBy("id").agg(F.min(F.struct((~root).alias("inner"), F.when(~root, F.col("parent")).alias("parent"))).alias("m"))
    nodes = Stored(once.select("id", "m.parent"), "tree")
    depths = _climbed(nodes.df.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("v")), lambda v, w: v + w)
    known = nodes.df.join(depths.df.select("id", F.col("v").alias("depth")), "id")
    fits = F.col("depth") < most
    if not known.where(F.col("depth") > most).limit(1).count():  # nothing has to move
        out = Stored(known.select("id", "parent", F.col("depth").cast("int").alias("level")), "levels")
        for held in (nodes, depths):
            held.drop()
        return out.df
    tops = _climbed(known.select("id", F.when(~fits, F.col("parent")).alias("up"), F.when(fits, F.col("id")).alias("v")), lambda v, w: w)
    parent = F.when(F.col("depth") > most, F.col("v")).otherwise(F.col("parent"))
    out = Stored(known.join(tops.df.select("id", "v"), "id").select("id", parent.alias("parent"), F.least(F.lit(most), F.col("depth")).cast("int").alias("level")), "levels")
    for held in (nodes, depths, tops):
        held.drop()
    return out.df


def suggestions(asked: DataFrame, words: DataFrame, distance: int, k: int) -> DataFrame:
    """(w, cand, d, n): for each w the k nearest words, ties by word, blocked by first letter and length band."""
    key = F.substring("w", 1, 1)
    left = asked.select("w", key.alias("b"), F.explode(F.sequence(F.length("w") - distance, F.length("w") + distance)).alias("len"))
    right = words.select(F.col("w").alias("cand"), key.alias("b"), F.length("w").alias("len"))
    near = left.join(right, ["b", "len"]).where("w <> cand").withColumn("d", F.levenshtein("w", "cand", distance)).where("d >= 0")
    return near.withColumn("n", F.row_number().over(W.partitionBy("w").orderBy("d", "cand"))).where(F.col("n") <= k).select("w", "cand", "d", "n")
