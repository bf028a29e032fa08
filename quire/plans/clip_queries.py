"""Queries of clips, positions, precedence and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import clips
from quire.operators import joins
from quire.plans.join_queries import _positions
from quire.plans.registry import query, read


@query("""with w as (select l_orderkey, list(l_returnflag || l_linestatus || (case when l_linenumber % 3 = 0 then '-' else '' end) order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) v from lineitem group by 1)
select l_orderkey, coalesce(regexp_replace(array_to_string(v, ' '), '- ', '', 'g'), '') as clip from w""")
def clip_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Words joined, layout's hyphens taken out."""
    n = F.col("l_linenumber")
    w = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", F.concat("l_returnflag", "l_linestatus", F.when(n % 3 == 0, "-").otherwise("")).alias("text"), F.coalesce(n % 3 == 0, F.lit(False)).alias("hyphen"), F.lit(False).alias("attached"), F.lit(False).alias("paragraph"))
    words = read(spark, d, "lineitem").select("l_orderkey", w.alias("w")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("w")).alias("v"))
    return words.select("l_orderkey", clips.assemble(F.col("v")).alias("clip"))


@query("select user_id, arg_max(event_type, (case event_type when 'purchase' then 3 when 'signup' then 2 else 1 end, -event_id)) as best from events group by user_id")
def metadata_precedence(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return read(spark, d, "events").groupBy("user_id").agg(clips.best_known(F.col("event_type"), rank, F.col("event_id")).alias("best"))


@query("""select l_orderkey, l_linenumber, case when l_orderkey + l_linenumber + l_partkey is not null then printf('/body/DocFragment[%d]/body/p[%d]/text().%d', l_orderkey, l_linenumber, l_partkey) end as path,
 coalesce(l_suppkey >= 0 and l_suppkey <= l_partkey and l_partkey < 1500, false) as valid from lineitem""")
def positions_and_validity(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    return read(spark, d, "lineitem").select(a, b, clips.position_path(a, b, c).alias("path"), clips.valid_range(F.col("l_suppkey"), c, F.lit(1500)).alias("valid"))


@query("""with s as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) - length(text) start, sum(length(text)) over (partition by conv_id) total, length(text) n from conversations),
 p as (select distinct conv_id, k, (total * k // 10)::bigint x, total from s, range(11) r(k)), m as (select p.conv_id, p.k, p.x, any_value(p.total) total, max(s.start) start from p join s on s.conv_id = p.conv_id and s.start <= p.x group by 1, 2, 3)
select m.conv_id, m.k, max(s.turn) as section, round(m.x / m.total, 6)::double as progress from m join s on s.conv_id = m.conv_id and s.start = m.start where m.total > 0 group by all""")
def percent_to_section(spark: SparkSession, d: str) -> DataFrame:
    """Tenths of a conversation's text as sections, and the progress that they stand for."""
    s, p = _positions(spark, d)
    total = s.groupBy("conv_id").agg(F.sum("n").alias("total")).where("total > 0")
    got = joins.asof(p, s, ["conv_id"], "x", "start", ["turn"]).join(total, "conv_id")
    return got.select("conv_id", "k", F.col("turn").alias("section"), F.round(F.col("x") / F.col("total"), 6).alias("progress"))
