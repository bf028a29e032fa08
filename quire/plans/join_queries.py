"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import joins
from quire.plans.registry import query, read


@query("select o.o_orderkey, c.c_name, c.c_mktsegment from orders o join customer c on c.c_custkey = o.o_custkey")
def lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    """A lookup that drops what has no match; Spark broadcasts the small side when its size allows."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", "c_name", "c_mktsegment")


@query("select c.c_custkey, f.o_orderkey as first_order from customer c left join (select o_custkey, min(o_orderkey) o_orderkey from orders group by 1) f on f.o_custkey = c.c_custkey")
def lookup_first_match(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return joins.first_match(read(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], [F.col("first_order")]).select("c_custkey", "first_order")


@query("""with wanted as (select distinct regexp_extract(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') as name from documents)
select doc_id, length(text)::bigint as size, w.name from documents d join wanted w on w.name = regexp_extract(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')""")
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every document's first word among the wanted names."""
    first = F.regexp_extract(text.ascii_lower(F.col("text")), "[a-z]+", 0)
    docs = read(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("size"), first.alias("name"))
    return docs.join(docs.select("name").distinct(), "name").select("doc_id", "size", "name")


_ENTRIES = """lex as (select row_number() over (order by word) ordinal, word, n from (select word, count(*) n from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) word from benchmark) group by word))"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""with {_ENTRIES}, q as (select conv_id, turn, regexp_extract(text, '[A-Za-z]+') w from conversations)
select conv_id, turn, w, word, n from (select q.*, lex.word, lex.n, row_number() over (partition by conv_id, turn order by (lex.word = q.w) desc, lex.word) r
 from q join lex on lower(lex.word) = lower(q.w)) where r = 1""")
def lookup_ignoring_case(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon's entry in any case, the exact case first."""
    lex = _lexicon(spark, d).withColumn("k", F.lower("word"))
    q = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract("text", "[A-Za-z]+", 0).alias("w")).withColumn("k", F.lower("w"))
    hits = q.join(lex, "k")
    best = hits.groupBy("conv_id", "turn", "w").agg(F.min_by(F.struct("word", "n"), F.struct(F.col("word") != F.col("w"), "word")).alias("m"))
    return best.select("conv_id", "turn", "w", "m.word", "m.n")


_CHAIN = ", ".join(text.stem_sql("w"))


@query(f"""with {_ENTRIES}, small as (select distinct lower(word) word from lex), q as (select conv_id, turn, lower(regexp_extract(text, '[A-Za-z]+')) w from conversations),
 c as (select conv_id, turn, w, [w] || case when length(w) >= 3 then list_filter([{_CHAIN}], lambda x: x is not null and length(x) >= 2) else [] end c from q),
 t as (select conv_id, turn, w, unnest(c) word, unnest(range(len(c))) i from c)
select conv_id, turn, w, arg_min(t.word, i) as entry from t join small on small.word = t.word group by all""")
def lookup_fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """The word itself, then its stems in order; the first that the lexicon has."""
    lex = _lexicon(spark, d).select(F.lower("word").alias("entry")).distinct()
    q = read(spark, d, "conversations").select("conv_id", "turn", F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("w"))
    return joins.fallback_chain(q, lex, F.concat(F.array("w"), text.stem_variants(F.col("w"))), "entry")


@query(f"""with {_ENTRIES}, syn as (select upper(word) alt, min(ordinal) ordinal from lex group by 1), q as (select conv_id, turn, upper(regexp_extract(text, '[A-Za-z]+')) w from conversations)
select conv_id, turn, w, lex.word from q join syn on syn.alt = q.w join lex on lex.ordinal = syn.ordinal""")
def synonym_indirection(spark: SparkSession, d: str) -> DataFrame:
    """Alternative form, then headword."""
    lex = _lexicon(spark, d)
    syn = lex.groupBy(F.upper("word").alias("w")).agg(F.min("word").alias("word"))
    q = read(spark, d, "conversations").select("conv_id", "turn", F.upper(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("w"))
    return q.join(syn, "w").join(lex.select("word"), "word").select("conv_id", "turn", "w", "word")


@query("""with s as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) - length(text) start, sum(length(text)) over (partition by conv_id) total from conversations),
 p as (select distinct conv_id, k, (total * k // 10)::bigint x from s, range(11) r(k))
select p.conv_id, p.k, p.x, max(turn) as turn from p join s on s.conv_id = p.conv_id and s.start <= p.x group by all""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """The turn in which a tenth of a conversation's text begins."""
    s, p = _positions(spark, d)
    return joins.asof(p, s, ["conv_id"], "x", "start", ["turn"])


def _positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    s = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n")).withColumn("start", F.sum("n").over(w) - F.col("n"))
    total = s.groupBy("conv_id").agg(F.sum("n").alias("total"))
    p = total.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(10)).cast("array<bigint>")).alias("k"), "total").select("conv_id", "k", F.expr("total * k div 10").alias("x"))
    return s, p


@query("""with s as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) - length(text) start, sum(length(text)) over (partition by conv_id) total from conversations),
 p as (select distinct conv_id, k, (total * k // 10)::bigint x from s, range(11) r(k)), l as (select conv_id, max(turn) last from s group by 1)
select p.conv_id, p.k, p.x, coalesce(min(turn), any_value(last)) as turn from p join l using (conv_id) left join s on s.conv_id = p.conv_id and s.start >= p.x group by all""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """The first turn that begins at a position or later, the last turn where there is none."""
    s, p = _positions(spark, d)
    last = s.groupBy("conv_id").agg(F.max("turn").alias("last"))
    got = joins.asof(p, s, ["conv_id"], "x", "start", ["turn"], forward=True, first_of_ties=True)
    return got.join(last, "conv_id").select("conv_id", "k", "x", F.coalesce("turn", "last").alias("turn"))


@query("""with s as (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn) - length(text) lo, sum(length(text)) over (partition by conv_id order by turn) - 1 hi, sum(length(text)) over (partition by conv_id) total from conversations),
 p as (select distinct conv_id, k, (total * k // 10)::bigint x from s, range(11) r(k))
select p.conv_id, p.k, turn, (x - lo)::bigint as inside from p join s on s.conv_id = p.conv_id and p.x between s.lo and s.hi""")
def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    s, p = _positions(spark, d)
    ranges = s.where("n > 0").select("conv_id", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"), "turn")
    return joins.interval(p, ranges, ["conv_id"], "x", "lo", "hi").select("conv_id", "k", "turn", (F.col("x") - F.col("lo")).alias("inside"))


@query("""select o_orderkey, count(*) as early from orders join lineitem on l_orderkey = o_orderkey where l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 30 day group by 1""")
def keyed_range(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey"), "o_orderdate")
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    near = (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 30 days"))
    return o.join(li, "o_orderkey").where(near).groupBy("o_orderkey").agg(F.count("*").alias("early"))


@query("""with w as (select conv_id, turn, sum(len(string_split(text, ' '))) over (partition by conv_id order by turn) - len(string_split(text, ' ')) start, len(string_split(text, ' ')) n from conversations),
 saved as (select conv_id, turn as id, (start + n * 3 // 4)::bigint a, (start + n + 5)::bigint b from w)
select s.conv_id, s.id, max(case when w.start <= s.a then w.turn end) as start_turn, coalesce(max(case when w.start <= s.b and s.b < w.start + w.n then w.turn end), s.id) as end_turn
from saved s join w using (conv_id) group by s.conv_id, s.id""")
def saved_item_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Each end of a saved range by a keyed as-of; an end beyond the text falls back to the stored turn."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    s = read(spark, d, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("bigint").alias("n")).withColumn("start", F.sum("n").over(w) - F.col("n"))
    saved = s.select("conv_id", F.col("turn").alias("id"), F.expr("start + n * 3 div 4").alias("a"), (F.col("start") + F.col("n") + 5).alias("b"))
    pages = s.select("conv_id", "start", "turn", (F.col("start") + F.col("n")).alias("stop"))
    one = joins.asof(saved, pages.withColumnRenamed("turn", "start_turn"), ["conv_id"], "a", "start", ["start_turn"])
    two = joins.asof(one, pages.withColumnRenamed("turn", "end_turn"), ["conv_id"], "b", "start", ["end_turn", "stop"])
    return two.select("conv_id", "id", "start_turn", F.when(F.col("b") < F.col("stop"), F.col("end_turn")).otherwise(F.col("id")).alias("end_turn"))


@query("select c_custkey, exists(select 1 from orders where o_custkey = c_custkey and o_totalprice >= 100000 and o_totalprice < 200000) as marked from customer")
def half_open_semi(spark: SparkSession, d: str) -> DataFrame:
    hit = read(spark, d, "orders").where("o_totalprice >= 100000 and o_totalprice < 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("marked", F.lit(True))
    return read(spark, d, "customer").select("c_custkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("marked", F.lit(False)).alias("marked"))


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", "c_name").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""with r as (select row_number() over (order by n_nationkey) - 1 i, n_nationkey * 7 + 1 as first, n_name, n_regionkey from nation),
 p as (select p_partkey, p_size from part)
select p_partkey, coalesce((select arg_max_null(r.n_name, r.first) from r where r.first <= p_size), '') || '-' || (1 + p_size - coalesce((select max(r.first) from r where r.first <= p_size), 0)) as label from p""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    """The last range that starts at the page or before, and the number within it."""
    ranges = read(spark, d, "nation").select(F.lit(1).alias("k"), (F.col("n_nationkey") * 7 + 1).cast("bigint").alias("first"), "n_name", (F.col("n_nationkey") * 7 + 1).cast("bigint").alias("at"))
    pages = read(spark, d, "part").select(F.lit(1).alias("k"), "p_partkey", F.col("p_size").cast("bigint").alias("p"))
    sizes = pages.select("k", "p").distinct()  # few page numbers: the one key holds only these
    got = joins.asof(sizes, ranges, ["k"], "p", "first", ["n_name", "at"])
    label = F.concat(F.coalesce("n_name", F.lit("")), F.lit("-"), 1 + F.col("p") - F.coalesce("at", F.lit(0)))
    return pages.join(got.where("p is not null").select("p", label.alias("label")), "p", "left").select("p_partkey", "label")


@query("""with b as (select p_partkey id, (p_partkey * 37 % 600)::double x0, (p_partkey * 37 % 600 + p_size)::double x1, (p_partkey * 91 % 800)::double y0, (p_partkey * 91 % 800 + 12)::double y1, p_partkey % 5 page, p_type t from part)
select a.id, count(*) as same from b a join b c on a.page = c.page and a.t = c.t and a.id <> c.id
 and greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * 2 >= least(a.x1 - a.x0, c.x1 - c.x0) and abs((a.y0 + a.y1) / 2 - (c.y0 + c.y1) / 2) <= 96 group by a.id""")
def duplicate_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one text on one page that overlap by half of the narrower and stand near each other."""
    k = F.col("p_partkey")
    b = read(spark, d, "part").select(k.alias("id"), (k * 37 % 600).cast("double").alias("x0"), (k * 37 % 600 + F.col("p_size")).cast("double").alias("x1"), (k * 91 % 800).cast("double").alias("y0"), (k * 91 % 800 + 12).cast("double").alias("y1"), (k % 5).alias("page"), F.col("p_type").alias("t"))
    return joins.overlapping(b, ["page", "t"], 96.0)


@query("""with e as (select p_partkey eid, lower(split_part(p_type, ' ', 1)) tag, [lower(p_brand), 'c' || (p_size % 5)] cs from part),
 r as (select * from (values (1, 'promo', 'color', 'red'), (2, '.c1', 'color', 'blue'), (3, 'promo.c1', 'margin', '2em'), (4, 'standard', 'color', 'gray'), (5, '.c1', 'margin', '1em'), (6, '.c2', 'color', 'green'), (7, 'promo', 'margin', '0')) t(ordinal, selector, property, value)),
 m as (select eid, property, value, (case when contains(selector, '.') and not starts_with(selector, '.') then 3 when starts_with(selector, '.') then 2 else 0 end) * 1000 + ordinal p
   from e join r on selector = tag or list_contains(list_transform(cs, lambda c: '.' || c), selector) or list_contains(list_transform(cs, lambda c: tag || '.' || c), selector))
select eid, property, arg_max(value, p) as value from m group by eid, property""")
def style_cascade(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(
        [(1, "promo", "color", "red"), (2, ".c1", "color", "blue"), (3, "promo.c1", "margin", "2em"), (4, "standard", "color", "gray"), (5, ".c1", "margin", "1em"), (6, ".c2", "color", "green"), (7, "promo", "margin", "0")],
        "ordinal int, selector string, property string, value string",
    )
    e = read(spark, d, "part").select(F.col("p_partkey").alias("eid"), F.element_at(F.split("p_type", " "), 1).alias("tag"), F.array("p_brand", F.concat(F.lit("c"), F.col("p_size") % 5)).alias("classes"), F.lit(None).cast("array<string>").alias("ancestors"))
    return joins.cascade(e, F.broadcast(rules))


@query("select c_custkey, n_name, coalesce(c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000 and s_nationkey is not null), false) as known from customer left join nation on n_nationkey = c_nationkey")
def flag_by_join(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("known", F.lit(True))
    nation = read(spark, d, "nation").select("n_nationkey", "n_name").join(known, "n_nationkey", "left")
    return read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation, "n_nationkey", "left").select("c_custkey", "n_name", F.coalesce("known", F.lit(False)).alias("known"))


@query("select user_id, ts::date as day from events where event_type = 'click' union select user_id, ts::date from events where value > 50")
def union_of_day_sets(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    day = lambda x: x.select("user_id", F.col("ts").cast("date").alias("day"))
    return day(e.where("event_type = 'click'")).union(day(e.where("value > 50"))).distinct()


@query("select user_id, event_id from events where event_type = 'click' union all select user_id, event_id from events where value > 50")
def union_all_rows(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id", "event_id").unionByName(e.where("value > 50").select("user_id", "event_id"))


@query("""with new as (select o_custkey k, 0 as lo, 5000 as hi from orders group by 1)
select l_orderkey, l_linenumber, l_partkey as place from lineitem where not (l_partkey >= 100 and l_partkey < 200) union all select o_orderkey, 0, 150 from orders where o_orderkey % 10 = 0""")
def replace_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a range are deleted, then new ones inserted."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("place"))
    new = read(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(150).cast("bigint").alias("place"))
    return li.where("not (place >= 100 and place < 200)").unionByName(new)
