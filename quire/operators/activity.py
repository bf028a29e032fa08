"""Reading-activity operators: span splitting, mergeable statistics, ordered folds, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import dates

HISTORY = 730  #: days that a reading history holds


def split_spans(spans: DataFrame, ts: str = "ts", seconds: str = "seconds") -> DataFrame:
    """Each span (ts, seconds) cut where the time of day changes: adds bucket, weekday, day and part (whole seconds)."""
    end = F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(seconds).cast("decimal(18,6)"))
    days = F.sequence(F.to_date(ts), F.to_date(end))
    cells = spans.withColumn("_end", end).withColumn("_day", F.explode(days)).withColumn("_cell", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 5), (5, 12), (12, 17), (17, 21), (21, 24))])))
    at = lambda h: F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h)
    lo, hi = F.greatest(F.col(ts), at(F.col("_cell.a"))), F.least(F.col("_end"), at(F.col("_cell.b")))
    part = F.round((F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / 1e6, 6)
    out = cells.withColumn("part", part).where("part > 0")
    return out.select(*spans.columns, dates.bucket(F.col("_cell.a")).alias("bucket"), F.weekday("_day").alias("weekday"), F.col("_day").alias("day"), "part")


def span_days(spans: DataFrame, ts: str = "ts", seconds: str = "seconds") -> DataFrame:
    """The days that a span touches, up to that of its last second."""
    last = F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.greatest(F.lit(0), F.col(seconds) - 1).cast("decimal(18,6)"))
    return spans.withColumn("day", F.explode(F.sequence(F.to_date(ts), F.to_date(last))))


def capped_average(values: Column, weight: int = 1000, most: int = 65535) -> Column:
    """Ordered fold of an array: (average * w + x) div (w + 1), w the count up to ``weight``; 0 is left out.

    Returns struct<avg, n>. Not an algebraic aggregate, as each step truncates.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("avg"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, x: Column) -> Column:
        w = F.least(a["n"], F.lit(weight))
        v = F.least(x, F.lit(most)).cast("bigint")
        new = F.struct(F.floor((a["avg"] * w + v) / (w + 1)).cast("bigint").alias("avg"), (a["n"] + 1).cast("bigint").alias("n"))
        return F.when(x > 0, new).otherwise(a)

    return F.aggregate(values, start, step)


def streaks(days: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """(by, first, last, length) of each run of consecutive distinct days within the history of each key."""
    once = days.select(*by, day).distinct()
    kept = once.withColumn("_new", F.max(day).over(W.partitionBy(*by))).where(F.datediff("_new", day) < HISTORY)
    runs = kept.withColumn("_run", F.date_sub(F.col(day), F.row_number().over(W.partitionBy(*by).orderBy(day))))
    return runs.groupBy(*by, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("length")).drop("_run")


def streak_summary(days: DataFrame, by: list[str], today: Column, day: str = "day") -> DataFrame:
    """(by, longest, current): current is the run that ends today or yesterday, else 0."""
    current = F.max(F.when(F.datediff(today, "last") <= 1, F.col("length")).otherwise(0))
    runs = streaks(days, by, day)
    return runs.groupBy(*by).agg(F.max("length").alias("longest"), current.alias("current"))


def merged_stats(devices: DataFrame, by: list[str], sums: list[str], peaks: list[str], arrays: list[str]) -> DataFrame:
    """Statistics of devices merged: saturating sums, maxima, and arrays summed place by place."""
    sizes = {a: F.max(F.size(a)) for a in arrays}
    out = devices.groupBy(*by).agg(*[F.least(F.sum(s), F.lit(dates.LONGEST)).alias(s) for s in sums], *[F.max(p).alias(p) for p in peaks], *[n.alias(f"_{a}") for a, n in sizes.items()])
    for a in arrays:
        places = devices.select(*by, F.posexplode(a).alias("_i", "_x")).groupBy(*by, "_i").agg(F.least(F.sum("_x"), F.lit(dates.LONGEST)).alias("_x"))
        whole = places.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(a))
        out = out.join(whole, by, "left").drop(f"_{a}")
    return out


def smoothed(values: Column, alpha: float = 0.25) -> Column:
    """Ordered fold of an array of doubles: exponential moving average that starts at the first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a + alpha * (x - a)))


def histogram_median(df: DataFrame, by: list[str], value: str, top: float, bins: int = 64) -> DataFrame:
    """(by, median): the upper edge of the bin in which the running count reaches half."""
    counts = df.select(*by, F.least(F.floor(F.col(value) * bins / top), F.lit(bins - 1)).alias("_b")).groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    run = counts.withColumn("_run", F.sum("_n").over(w.orderBy("_b"))).withColumn("_all", F.sum("_n").over(w))
    return run.where("_run * 2 >= _all").groupBy(*by).agg(((F.min("_b") + 1) * top / bins).alias("median"))
