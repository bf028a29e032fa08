"""Lookup, as-of, interval, spatial and rule joins. All are equi joins on a key first; ranges are inside a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.keys import SHARE, heavy_keys
from quire.storage import Stored


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column], how: str = "left") -> DataFrame:
    """Each left row with the first matching right row by ``order``, nulls last; the right side shrinks to one row a key first."""
    cols = [c for c in right.columns if c not in on]
    ranks = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"_n{i}"), o.alias(f"_o{i}"))]
    first = right.groupBy(*on).agg(F.min(F.struct(*ranks, *[F.col(c) for c in cols])).alias("_m"))
    return left.join(first.select(*on, *[F.col(f"_m.{c}") for c in cols]), on, how)


#: Rows of one key that an as-of join leaves to one task.
WHOLE = 1_000_000


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, start: str, take: list[str], forward: bool = False, first_of_ties: bool = False, whole: int = WHOLE) -> DataFrame:
    """Keyed as-of join: the right row with the greatest ``start`` at most ``at`` (forward: the least at least ``at``).

    One shuffle by key: both sides are laid into one sorted sequence and the last right row is carried along, so no pairs
    are made. Of right rows with equal starts the one last in the order of ``take`` wins (or the first). Nulls in a key or place
    match nothing; their left rows stay, without a right one.

    A key of a thousandth of all rows and more than ``whole`` rows is cut in pieces at quantiles of its places, each a
    sequence of its own; the last right row of the pieces before, a row for each piece, is sent to all tasks. There are at
    most a thousand such keys. Rows of one key and one place stay together.
    """
    keyed = [F.col(c).isNotNull() for c in (*by, at)]
    known = keyed[0]
    for k in keyed[1:]:
        known &= k
    right = right.dropna(subset=[*by, start])
    theirs = right.select(*by, F.col(start).alias("_x"), F.lit(0).alias("_side"), F.struct(*take).alias("_r"))
    mine = left.select(*by, F.col(at).alias("_x"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")).where(known if at in by else " and ".join(f"`{c}` is not null" for c in (*by, "_x")))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    # ties: what is last in the sequence is carried on
    order = [F.desc("_x") if forward else F.asc("_x"), F.col("_side"), F.desc("_r") if first_of_ties else F.asc("_r")]
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    hot = heavy_keys(both.select(*by), by, least=whole + 1)
    rows = [r.asDict() for r in hot.drop("n").collect()]
    if rows:
        spark = left.sparkSession
        hot = F.broadcast(spark.createDataFrame(rows, hot.drop("n").schema))
        pieces = min(SHARE, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        cuts = both.join(hot, by).groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx("_x", [i / pieces for i in range(1, pieces)], 10 * pieces))).alias("_cuts"))
        cuts = Stored(cuts, "cuts").df
        place = F.size(F.filter("_cuts", (lambda c: c < F.col("_x")) if forward else (lambda c: c <= F.col("_x"))))
        both = both.join(F.broadcast(cuts), by, "left").withColumn("_piece", F.coalesce(place, F.lit(0)))
        best = (F.min if forward else F.max)(F.struct("_x", "_r"))
        if first_of_ties != forward:  # the place decides first, the least or greatest row of it then
            ends = both.where("_side = 0 and _cuts is not null").groupBy(*by, "_piece", "_x").agg((F.min if first_of_ties else F.max)("_r").alias("_r"))
        else:
            ends = both.where("_side = 0 and _cuts is not null")
        ends = ends.groupBy(*by, "_piece").agg(best.alias("_e"))
        every = cuts.select(*by, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_piece")).join(ends, [*by, "_piece"], "left")
        before = W.partitionBy(*by).orderBy(F.desc("_piece") if forward else F.asc("_piece")).rowsBetween(W.unboundedPreceding, -1)
        carried = every.select(*by, "_piece", F.last("_e._r", ignorenulls=True).over(before).alias("_c"))
        got = both.drop("_cuts").withColumn("_r", F.last("_r", ignorenulls=True).over(w.partitionBy(*by, "_piece"))).where("_side = 1")
        got = got.join(F.broadcast(carried), [*by, "_piece"], "left").withColumn("_r", F.coalesce("_r", "_c"))
    else:
        got = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w.partitionBy(*by))).where("_side = 1")
    unkeyed = left.where(~known).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take])
    return got.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in take]).union(unkeyed)


def interval(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """Points inside [low, high] of the ranges of the same key, for ranges that don't overlap: an as-of join and a test."""
    cols = [c for c in ranges.columns if c not in (*by, low)]
    got = asof(points, ranges.withColumn("_low", F.col(low)), by, at, low, ["_low", *cols])
    ok = (F.col(at) <= F.col(high)) & (F.col(at) >= F.col("_low"))
    got = got.withColumnRenamed("_low", low) if how == "left" else got
    if how == "inner":
        return got.where(ok).withColumnRenamed("_low", low)
    ok = (F.col(at) <= F.col(high)) & (F.col(at) >= F.col(low))
    return got.select(*points.columns, *[F.when(ok, F.col(c)).alias(c) for c in [low, *cols]])


def overlaps(a: dict[str, Column], b: dict[str, Column], share: float) -> Column:
    """Whether rectangles (x0, x1, y0, y1) overlap by a share of the first one's area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h >= share * (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])


def overlapping(boxes: DataFrame, by: list[str], near: float, side: float = 32.0) -> DataFrame:
    """(id, same): how many boxes (id, x0, x1, y0, y1) of the same key and another id each id's boxes overlap, if any.

    Boxes overlap if they share half of the narrower one's width and their middles are at most ``near`` apart in height. A
    box without x1 is open to the right (two such never overlap); one without width lies on all others.

    Equal boxes are one with a weight, so copies make no pairs. Those boxes meet in cells: strips of ``near``, where each
    also visits the two next to its own, and columns of ``side``, where each lies in all that it covers between the first
    and the last start of its key; a pair counts in the column of the later start alone.
    """
    box = [*by, "x0", "x1", "y0", "y1"]
    rows = boxes.select("id", *box).dropna(subset=["id", *by, "x0", "y0", "y1"])

    def meets(a, b) -> Column:
        wide = F.greatest(F.lit(0.0), F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0"))) * 2 >= F.least(a("x1") - a("x0"), b("x1") - b("x0"))
        return wide & (F.abs((a("y0") + a("y1")) / 2 - (b("y0") + b("y1")) / 2) <= near)

    column = lambda x: F.floor(x / side)
    flat = F.coalesce(F.col("x1") <= F.col("x0"), F.lit(False))
    ends = rows.groupBy(*by).agg(F.min("x0").alias("_left"), F.max("x0").alias("_right"))
    covered = F.sequence(column(F.when(flat, F.col("_left")).otherwise(F.col("x0"))), column(F.when(flat, F.col("_right")).otherwise(F.least("x1", "_right"))))
    strip = F.floor((F.col("y0") + F.col("y1")) / 2 / near)
    cells = rows.groupBy(*box).agg(F.count("*").alias("n")).join(ends, by).select(*box, "n", flat.alias("flat"), strip.alias("strip"), F.explode(covered).alias("column"))
    mine = cells.withColumn("strip", F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)))
    theirs = cells.select(*by, "strip", "column", *[F.col(c).alias(f"{c}_2") for c in ("x0", "x1", "y0", "y1", "n", "flat")])
    at = F.when(F.col("flat") == F.col("flat_2"), F.greatest("x0", "x0_2")).when(F.col("flat"), F.col("x0_2")).otherwise(F.col("x0"))
    pairs = mine.join(theirs, [*by, "strip", "column"]).where(meets(F.col, lambda c: F.col(f"{c}_2")) & (column(at) == F.col("column")))
    hits = pairs.groupBy(*[F.col(c).alias(f"{c}_2") for c in box]).agg(F.sum("n_2").alias("hits"))

    match = F.lit(True)
    for c in box:
        match &= F.col(c).eqNullSafe(F.col(f"{c}_2"))
    held = rows.groupBy("id", *box).agg(F.count("*").alias("n")).join(hits, match)
    held = held.groupBy("id").agg(F.sum(F.col("n") * F.col("hits")).alias("all"), F.collect_list(F.struct(*box, "n")).alias("own"))

    def among(a: Column) -> Column:
        """Boxes of the same id that a box of it meets, itself included."""
        same = lambda b: F.when(F.forall(F.array(*[a[c] == b[c] for c in by]), lambda x: x) & meets(lambda c: a[c], lambda c: b[c]), b["n"]).otherwise(0)
        return a["n"] * F.aggregate("own", F.lit(0).cast("bigint"), lambda n, b: n + same(b))

    others = F.col("all") - F.aggregate("own", F.lit(0).cast("bigint"), lambda n, a: n + among(a))
    return held.select("id", others.alias("same")).where("same > 0")


def fallback_chain(left: DataFrame, lexicon: DataFrame, candidates: Column, key: str) -> DataFrame:
    """Left rows with the lexicon's row for the first candidate (array of keys, in order) that it has; without one, none."""
    ids = left.columns
    tried = left.select("*", F.posexplode(candidates).alias("_try", key))
    hits = tried.join(lexicon, key)
    return hits.groupBy(*ids).agg(F.min_by(F.struct(*[c for c in hits.columns if c not in (*ids, "_try")]), F.struct("_try", key)).alias("_h")).select(*ids, "_h.*")


def cascade(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(element id, property, value): rules (ordinal, selector, property, value) that match elements (eid, tag, classes).

    An element rule gives way to a class rule and that to a tag.class rule; of equal ones the later wins, property by
    property. Selectors are exploded from the elements and looked up by an equi join.
    """
    low = F.transform(F.col("classes"), F.lower)
    each = F.concat(
        F.array(F.struct(F.lower("tag").alias("selector"), F.lit(0).alias("weight"))),
        F.transform(low, lambda c: F.struct(F.concat(F.lit("."), c).alias("selector"), F.lit(2).alias("weight"))),
        F.transform(low, lambda c: F.struct(F.concat(F.lower("tag"), F.lit("."), c).alias("selector"), F.lit(3).alias("weight"))),
        F.flatten(F.transform(F.coalesce(F.col("ancestors"), F.array().cast("array<string>")), lambda a: F.array(F.struct(F.concat(F.lower(a), F.lit(" "), F.lower("tag")).alias("selector"), F.lit(1).alias("weight"))))),
    )
    tried = elements.select("eid", F.inline(F.array_distinct(each)))
    return tried.join(rules, "selector").groupBy("eid", "property").agg(F.max_by("value", F.struct("weight", "ordinal")).alias("value"))
