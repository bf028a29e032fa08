"""Queries of windows, sorting, top-k, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import ordering
from quire.plans.registry import query, read

#: Orders lines totally, as line numbers may repeat.
_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(f"""with w as (select conv_id, turn, len(regexp_extract_all(text, '{text.WORD.replace(chr(39), chr(39) * 2)}'))::bigint n from conversations),
 l as (select *, sum(n) over (partition by conv_id order by turn) cum, sum(n) over (partition by conv_id) total from w)
select conv_id, min(turn) filter (2 * cum >= total) as half_turn, max(total)::bigint as words, max(cum / total)::double as reached from l group by conv_id""")
def word_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Words of each conversation and the turn that holds the middle one."""
    w = W.partitionBy("conv_id")
    c = read(spark, d, "conversations").select("conv_id", "turn", text.word_count(F.col("text")).alias("n"))
    ledger = c.withColumn("cum", F.sum("n").over(w.orderBy("turn").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    half = F.min(F.when(F.col("cum") * 2 >= F.col("total"), F.col("turn")))
    return ledger.groupBy("conv_id").agg(half.alias("half_turn"), F.max("total").alias("words"), F.max(F.when(F.col("total") > 0, F.col("cum") / F.col("total"))).alias("reached"))


@query("""select l_orderkey, l_linenumber, sum(l_quantity) over w as run, coalesce(lead(l_linenumber) over w2, 99) as until, count(*) over (partition by l_orderkey) as lines
from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate rows unbounded preceding), w2 as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)""")
def running_sizes(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy(*_LINE)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.coalesce(F.lead("l_linenumber").over(w), F.lit(99)).alias("until"), F.count("*").over(W.partitionBy("l_orderkey")).alias("lines"))


@query("""with s as (select conv_id, turn, case when turn % 3 = 1 then turn end toc from conversations)
select conv_id, turn, last_value(toc ignore nulls) over (partition by conv_id order by turn rows unbounded preceding) as toc from s""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.col("turn")).alias("toc"))
    return s.withColumn("toc", F.last("toc", ignorenulls=True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)))


@query("""with s as (select l_orderkey o, l_linenumber n, l_quantity q, l_quantity > 40 h, l_returnflag f, l_partkey a, l_suppkey b, l_extendedprice c, l_shipdate d from lineitem)
select o as l_orderkey, n as l_linenumber, coalesce(count(*) filter (h) over (partition by o order by q desc groups between unbounded preceding and 1 preceding), 0) as section,
 coalesce(f <> lag(f) over (partition by o order by n, a, b, q, c, d), true) as new_block from s""")
def sections_and_flags(spark: SparkSession, d: str) -> DataFrame:
    """Headings above (peers left out), and a flag where the block changes."""
    by = W.partitionBy("l_orderkey")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_returnflag", *_LINE)
    upto = F.count_if(F.col("l_quantity") > 40).over(by.orderBy(F.desc("l_quantity")).rangeBetween(W.unboundedPreceding, 0))
    peers = F.count_if(F.col("l_quantity") > 40).over(W.partitionBy("l_orderkey", "l_quantity"))
    change = F.col("l_returnflag") != F.lag("l_returnflag").over(by.orderBy(*_LINE))
    return li.select("l_orderkey", "l_linenumber", (upto - peers).alias("section"), F.coalesce(change, F.lit(True)).alias("new_block"))


@query("""with recursive t as (select distinct p_partkey id, p_partkey // 3 - 1 parent from part where p_partkey is not null), r(id, level) as (select id, 1 from t where parent < 0 union all select t.id, r.level + 1 from t join r on t.parent = r.id where r.level < 20)
select id, level from r""")
def outline_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of a tree given by parents, at most 20 deep."""
    t = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.expr("p_partkey div 3") - 1).alias("parent"))
    return ordering.tree_levels(t, 20).select("id", "level")


@query("""with recursive t as (select distinct p_partkey id, p_partkey // 2 - 1 parent from part where p_partkey is not null),
 r(id, way) as (select id, [id] from t where parent < 0 union all select t.id, list_append(way, t.id) from t join r on t.parent = r.id)
select id, case when len(way) = 1 then null when len(way) > 4 then way[3] else way[-2] end as parent, least(4, len(way))::int as level from r""")
def outline_reparented(spark: SparkSession, d: str) -> DataFrame:
    """An outline of four levels: what is deeper moves up to the nearest ancestor that may have it."""
    t = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.expr("p_partkey div 2") - 1).alias("parent"))
    return ordering.tree_levels(t, 4)


@query("""with r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) n from events where event_type = 'view')
select user_id, event_id from r where n <= 3""")
def recent_per_key(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").where("event_type = 'view'").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id")


@query("""with l as (select user_id, max(struct_pack(ts := ts, e := event_id)) m from events group by 1) select user_id, m.e as event_id from l order by m.ts desc, m.e desc limit 18""")
def recent_list(spark: SparkSession, d: str) -> DataFrame:
    """The 18 most recently used keys."""
    last = read(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.orderBy(F.desc("m")).limit(18).select("user_id", "m.event_id")


@query("""with k as (select distinct c_name || '-' || (c_custkey % 12) as name from customer)
select name, (row_number() over (order by regexp_extract(name, '^[^0-9]*'), regexp_extract(name, '([0-9]+)', 1)::bigint, regexp_extract(name, '-([0-9]+)$', 1)::bigint, name))::int as place from k""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "customer").select(F.concat("c_name", F.lit("-"), F.col("c_custkey") % 12).alias("name")).distinct()
    return ordering.numbered(k.withColumn("key", ordering.natural_key(F.col("name"))), ["key", "name"], "place").select("name", "place")


@query("""with n as (select p_name || ' ' || p_partkey as name from part) select name from n where name > 'blue bolt 5' order by name limit 7""")
def next_after_pivot(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    return n.where("name > 'blue bolt 5'").orderBy("name").limit(7)


@query("""select s_suppkey, s_nationkey = 3 as saved, s_acctbal from supplier order by s_nationkey = 3 desc, s_acctbal desc, s_suppkey limit 8""")
def multi_key_top(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") == 3).alias("saved"), "s_acctbal")
    return s.orderBy(F.desc("saved"), F.desc("s_acctbal"), "s_suppkey").limit(8)


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) select o_custkey, o_orderkey from r where n <= 7""")
def keep_newest(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("n", F.row_number().over(w)).where("n <= 7").select("o_custkey", "o_orderkey")


@query("""select l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) as newest, max(l_shipdate) as shipped, count(*) as revisions from lineitem group by 1""")
def newest_revision(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    return read(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_orderkey", at).alias("newest"), F.max("l_shipdate").alias("shipped"), F.count("*").alias("revisions"))


@query("select min(doc_id) as doc_id, count(*) as copies, length(text)::bigint as size, any_value(md5(text)) as digest from documents group by text")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first of equal texts; texts meet by digest, size and checksum and not by themselves."""
    t = F.col("text")
    rows = read(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("k"), F.length(t).cast("bigint").alias("size"), F.md5(t.cast("binary")).alias("digest"))
    return rows.groupBy("k", "size", "digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies", "size", "digest")


@query("""select source, (select count(distinct c) from (select unnest(string_split(text, '')) c from documents e where e.source = d.source) where c <> '') as characters, count(*) as docs from documents d group by source""")
def character_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    chars = docs.select("source", F.explode(F.array_distinct(F.split("text", ""))).alias("c")).where("c <> ''").distinct().groupBy("source").agg(F.count("*").alias("characters"))
    return docs.groupBy("source").agg(F.count("*").alias("docs")).join(chars, "source", "left").select("source", F.coalesce("characters", F.lit(0)).alias("characters"), "docs")


@query("""with e as (select doc_id, regexp_extract(text, '[A-Za-z]+') head, md5(text) def from documents union all select item_id + 1000000, regexp_extract(text, '[A-Za-z]+'), md5(text) from benchmark),
 m as (select head, string_agg(def, '; ' order by doc_id) defs, count(*) n from e group by 1)
select head, md5(defs) as definition, n as sources, (row_number() over (order by lower(head), head))::int as ordinal from m""")
def dictionary_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entries of two sources by headword, digests of their whole texts in source order, numbered by the headword."""
    head, whole = F.regexp_extract("text", "[A-Za-z]+", 0).alias("head"), F.md5(F.col("text").cast("binary")).alias("def")
    e = read(spark, d, "documents").select(F.col("doc_id").alias("i"), head, whole).unionByName(read(spark, d, "benchmark").select((F.col("item_id") + 1000000).alias("i"), head, whole))
    m = e.groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "def"))), lambda s: s["def"]), "; ").alias("defs"), F.count("*").alias("sources"))
    m = m.select("head", F.md5(F.nullif("defs", F.lit("")).cast("binary")).alias("definition"), "sources", F.lower("head").alias("k"))
    return ordering.numbered(m, ["k", "head"], "ordinal").select("head", "definition", "sources", "ordinal")


@query("""with v as (select distinct lower(w) w from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from benchmark)),
 c as (select q.w, v.w cand, levenshtein(q.w, v.w) d from v q join v on substr(q.w, 1, 1) = substr(v.w, 1, 1) and abs(length(q.w) - length(v.w)) <= 2 and q.w <> v.w where levenshtein(q.w, v.w) <= 2),
 r as (select *, row_number() over (partition by w order by d, cand) n from c) select w, cand, d::int as d, n::int as n from r where n <= 5""")
def fuzzy_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """For every distinct word the five nearest by edit distance among those of the same first letter and near length."""
    v = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return ordering.suggestions(v, v, 2, 5)


@query("""with l as (select unnest(string_split(text, chr(10))) as line, source, doc_id from documents), n as (select source, lower(trim(line)) k, count(distinct doc_id) pages, count(*) times from l where trim(line) <> '' group by 1, 2)
select source, md5(k) as line, pages, times from n where pages >= 3""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines on three documents or more of a source, the candidates of running headers and footers."""
    lines = read(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", F.lower(F.trim("line")).alias("k")).where("k <> ''")
    n = lines.groupBy("source", F.md5(F.col("k").cast("binary")).alias("line"), "doc_id").agg(F.count("*").alias("n")).groupBy("source", "line").agg(F.count("*").alias("pages"), F.sum("n").alias("times"))
    return n.where("pages >= 3").select("source", "line", "pages", "times")


@query("""with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) i from documents),
 n as (select source, md5(lower(trim(line))) k from l where trim(line) <> '' group by 1, 2 having count(distinct doc_id) >= 3)
select doc_id, count(*) filter (n.k is null) as kept, count(*) filter (n.k is not null) as dropped from l left join n on n.source = l.source and n.k = md5(lower(trim(l.line))) group by doc_id""")
def suppressed_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each document stay once repeated ones are dropped."""
    lines = read(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", F.md5(F.lower(F.trim("line")).cast("binary")).alias("line"))
    hit = lines.join(repeated_lines(spark, d).select("source", "line", F.lit(True).alias("hit")), ["source", "line"], "left")
    return hit.groupBy("doc_id").agg(F.count_if(F.col("hit").isNull()).alias("kept"), F.count_if(F.col("hit")).alias("dropped"))


@query("""select (row_number() over (order by p_retailprice desc, p_partkey))::int as place, p_partkey from part qualify place between 101 and 120 or p_partkey = 5""")
def positional_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Rows by their place in an order, and the place of one row."""
    ranked = ordering.numbered(read(spark, d, "part").select("p_partkey", "p_retailprice").withColumn("k", F.coalesce(-F.col("p_retailprice"), F.lit(float("inf")))), ["k", "p_partkey"], "place")
    return ranked.where("place between 101 and 120 or p_partkey = 5").select("place", "p_partkey")
