"""Queries of reading activity: buckets, statistics, paces, streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import activity
from quire.plans.registry import query, read


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.floor(F.col("value") * 300).cast("bigint").alias("seconds"))


_SPANS = """s as (select event_id, user_id, ts, ts + to_seconds(floor(value * 300)::bigint) te, floor(value * 300)::bigint as "seconds" from events)"""


@query(f"""with {_SPANS}, c as (select s.*, day::date as day, a, b from s, unnest(generate_series(ts::date::timestamp, te::date::timestamp, interval 1 day)) g(day), (values (0, 5), (5, 12), (12, 17), (17, 21), (21, 24)) k(a, b)),
 p as (select *, epoch_us(least(te, day + to_hours(b))) - epoch_us(greatest(ts, day + to_hours(a))) us from c)
select user_id, case a when 5 then 'morning' when 12 then 'afternoon' when 17 then 'evening' else 'night' end as bucket, (isodow(day) - 1)::int as weekday, round(sum(us) / 1e6, 3) as "seconds", count(*) as parts
from p where us > 0 group by all""")
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    parts = activity.split_spans(_spans(spark, d))
    return parts.groupBy("user_id", "bucket", "weekday").agg(F.round(F.sum("part"), 3).alias("seconds"), F.count("*").alias("parts"))


@query(f"""with {_SPANS} select user_id, day::date as day, count(*) as spans from s, unnest(generate_series(ts::date::timestamp, (ts + to_seconds(greatest(0, "seconds" - 1)))::date::timestamp, interval 1 day)) g(day) group by all""")
def reading_days(spark: SparkSession, d: str) -> DataFrame:
    return activity.span_days(_spans(spark, d)).groupBy("user_id", "day").agg(F.count("*").alias("spans"))


_DAYS = "e as (select distinct user_id, ts::date as day from events where value > 10)"


@query(f"""with {_DAYS}, r as (select user_id, day, day - (row_number() over (partition by user_id order by day))::int run from e),
 k as (select user_id, run, count(*) n, max(day) last from r group by 1, 2)
select user_id, max(n) as longest, max(case when date '2024-01-30' - last <= 1 then n else 0 end) as current from k group by user_id""")
def reading_streaks(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "events").where("value > 10").select("user_id", F.col("ts").cast("date").alias("day"))
    return activity.streak_summary(days, ["user_id"], F.lit("2024-01-30").cast("date"))


@query("""with o as (select user_id, list(floor(value * 40)::bigint order by ts, event_id) v from events group by 1),
 f as (select user_id, list_reduce(list_prepend({'avg': 0::bigint, 'n': 0::bigint}, list_transform(v, lambda x: {'avg': x, 'n': 0::bigint})), lambda a, x: case when x.avg > 0 then
  {'avg': (a.avg * least(a.n, 1000) + least(x.avg, 65535)) // (least(a.n, 1000) + 1), 'n': a.n + 1} else a end) r from o)
select user_id, r.avg as pace, r.n as pages from f""")
def pace_fold(spark: SparkSession, d: str) -> DataFrame:
    """The running average of a reader's page times, in order; ties of time go by event."""
    e = read(spark, d, "events").select("user_id", F.struct("ts", "event_id", F.floor(F.col("value") * 40).cast("bigint").alias("x")).alias("e"))
    lists = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda s: s["x"]).alias("v"))
    return lists.withColumn("r", activity.capped_average(F.col("v"))).select("user_id", F.col("r.avg").alias("pace"), F.col("r.n").alias("pages"))


@query("""with d as (select user_id % 20 as device, user_id % 3 as book, count(*) as sessions, sum(floor(value * 1e7))::bigint as "seconds", max(value) as peak,
  [count(*) filter (hour(ts) between 5 and 11), count(*) filter (hour(ts) between 12 and 16), count(*) filter (hour(ts) between 17 and 20), count(*) filter (hour(ts) >= 21 or hour(ts) < 5)] tod from events group by 1, 2)
select book, least(sum(sessions), 4294967295)::bigint as sessions, least(sum("seconds"), 4294967295)::bigint as "seconds", max(peak) as peak, [sum(tod[1]), sum(tod[2]), sum(tod[3]), sum(tod[4])]::bigint[]::varchar as tod from d where device <> 7 group by book""")
def device_merge(spark: SparkSession, d: str) -> DataFrame:
    """Per-device partial statistics, then their merge; one device is left out."""
    from quire.functions import dates

    b = dates.bucket(F.hour("ts"))
    part = read(spark, d, "events").groupBy((F.col("user_id") % 20).alias("device"), (F.col("user_id") % 3).alias("book")).agg(
        F.count("*").alias("sessions"), F.sum(F.floor(F.col("value") * 1e7)).cast("bigint").alias("seconds"), F.max("value").alias("peak"), F.array(*[F.count_if(b == x) for x in ("morning", "afternoon", "evening", "night")]).alias("tod")
    )
    out = activity.merged_stats(part.where("device <> 7"), ["book"], ["sessions", "seconds"], ["peak"], ["tod"])
    return out.withColumn("tod", F.concat(F.lit("["), F.array_join("tod", ", "), F.lit("]")))


@query("""with h as (select l_returnflag f, least(floor(l_quantity * 64 / 64.0), 63) b, count(*) n from lineitem group by 1, 2),
 r as (select f, b, sum(n) over (partition by f order by b) run, sum(n) over (partition by f) total from h)
select f as l_returnflag, (min(b) + 1) * 64.0 / 64 as median from r where run * 2 >= total group by f""")
def histogram_median(spark: SparkSession, d: str) -> DataFrame:
    return activity.histogram_median(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 64.0)


@query("""with c as (select conv_id, count(*) filter (turn < 3 and role = 'user') u, count(*) filter (turn < 3 and length(text) > 300) l, count(*) turns, sum(length(text))::bigint size from conversations group by 1)
select conv_id, turns, size, case when u > 0 and l > 0 then 'mixed' when l > 0 then 'long' when u > 0 then 'short' else 'unknown' end as kind from c""")
def kind_from_first_pages(spark: SparkSession, d: str) -> DataFrame:
    early = F.col("turn") < 3
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(early & (F.col("role") == "user")).alias("u"), F.count_if(early & (F.length("text") > 300)).alias("l"), F.count("*").alias("turns"), F.sum(F.length("text")).cast("bigint").alias("size"))
    kind = F.when((F.col("u") > 0) & (F.col("l") > 0), "mixed").when(F.col("l") > 0, "long").when(F.col("u") > 0, "short").otherwise("unknown")
    return c.select("conv_id", "turns", "size", kind.alias("kind"))


@query("""with o as (select user_id, list(value order by ts, event_id) filter (value is not null) v from events group by 1)
select user_id, round(list_reduce(v, lambda a, x: a + 0.25 * (x - a)), 6) as level, len(v)::bigint as n from o""")
def smoothed_level(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("v"))
    e = e.withColumn("v", F.filter("v", lambda x: x.isNotNull()))
    return e.select("user_id", F.round(activity.smoothed(F.col("v")), 6).alias("level"), F.size("v").cast("bigint").alias("n"))


@query("""with g as (select user_id, event_type, max(value) v from events group by 1, 2)
select user_id, arg_max_null(event_type, (v, event_type)) as strongest, max(v) as value, (select count(*) from events e where e.user_id is not distinct from g.user_id) as events from g group by user_id""")
def keep_strongest(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_type")).alias("strongest"), F.max("value").alias("value"), F.count("*").alias("events"))
    return e.select("user_id", "strongest", "value", "events")


@query("""select event_id, json_extract(props, '$.k')::int as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing, to_json({'id': event_id, 'type': event_type}) as row_json from events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "k int, missing string")
    return read(spark, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("none")).alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")), {"ignoreNullFields": "false"}).alias("row_json"))


@query("""with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end new from events),
 g as (select *, sum(new) over (partition by user_id order by ts, event_id) session from s)
select user_id, session::bigint as session, count(*) as events, min(ts) as first, max(ts) as last from g group by user_id, session""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions cut at gaps of six hours (our own addition)."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(gap <= 6 * 3600 * 10**6, 0).otherwise(1).alias("new")).withColumn("session", F.sum("new").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
