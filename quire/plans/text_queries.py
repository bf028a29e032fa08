"""Queries of text, URL, name and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import dates, text, urls
from quire.plans.registry import query, read

_W = text.WORD
_UP, _LOW = text.UPPER, text.LOWER


@query(f"select doc_id, len(regexp_extract_all(text, '{_W.replace(chr(39), chr(39) * 2)}'))::bigint as words from documents")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(f"""select lang, sum(len(regexp_extract_all(text, '[{text.LETTERS}]')))::bigint as letters, sum(len(regexp_extract_all(text, '[{text.CJK}]')))::bigint as cjk, count(*) as docs
from documents group by lang""")
def character_classes(spark: SparkSession, d: str) -> DataFrame:
    count = lambda c: F.sum(F.regexp_count("text", F.lit(f"[{c}]")).cast("bigint"))
    return read(spark, d, "documents").groupBy("lang").agg(count(text.LETTERS).alias("letters"), count(text.CJK).alias("cjk"), F.count("*").alias("docs"))


@query(rf"""select doc_id, md5(translate(trim(regexp_replace(text, '[ \r\n\t]+', ' ', 'g')), '{_UP}', '{_LOW}')) as form,
length(trim(regexp_replace(text, '[ \r\n\t]+', ' ', 'g')))::bigint as units from documents""")
def text_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(text.normal_form(F.col("text")).cast("binary")).alias("form"), F.length(text.collapse(F.col("text"))).cast("bigint").alias("units"))


@query("""select a.p_partkey, b.p_partkey as other, case when a.p_name is not null and b.p_name is not null then least(levenshtein(a.p_name, b.p_name), 9)::int end as distance
from part a join part b on b.p_partkey = a.p_partkey + 1""")
def capped_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    return a.join(b, "p_partkey").select("p_partkey", "other", text.capped_distance(F.col("p_name"), F.col("name"), 8).alias("distance"))


_STEMS = ", ".join(text.stem_sql("w"))


@query(f"""with v as (select distinct unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[a-z]+')) w from benchmark),
 s as (select w, unnest(list_filter([{_STEMS}], lambda x: x is not null and length(x) >= 2)) stem from v where length(w) >= 3)
select w as word, stem from s group by w, stem""")
def stem_variants(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(text.ascii_lower(F.col("text")), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return v.select("word", F.explode(text.stem_variants(F.col("word"))).alias("stem"))


@query()
def word_trimming(spark: SparkSession, d: str) -> DataFrame:
    """Every word of each turn, in any script, cut down for a lookup (no SQL; tests hold it against hand-made words)."""
    w = F.col("w")
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return rows.select("conv_id", "turn", "i", text.lookup_word(w).alias("core"), text.has_lookup_character(w).alias("looked_up"), text.drop_last(w, 2).alias("dropped"), text.bionic_prefix(w, 40).alias("bold"))


@query("""select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped,
 replace(text, chr(173), '') = text as plain, md5(regexp_replace(text, '-$', '')) as joined from documents""")
def markup_escape(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts escaped, and joined without a layout hyphen, as digests."""
    t, digest = F.col("text"), lambda c: F.md5(c.cast("binary"))
    return read(spark, d, "documents").select("doc_id", digest(text.xml_escape(t)).alias("escaped"), (text.strip_soft_hyphens(t) == t).alias("plain"), digest(text.strip_layout_hyphen(t)).alias("joined"))


@query(r"""select doc_id, coalesce(regexp_matches(regexp_extract(text, '[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]|\p{L}'), '[\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]'), false) as rtl,
 length(text) >= 64 and not regexp_matches(left(text, 256), '\s') and length(regexp_replace(left(text, 256), '[^A-Za-z0-9+/=]', '', 'g')) * 100 >= 95 * length(left(text, 256)) as unbroken from documents""")
def direction_and_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", text.starts_right_to_left(t).alias("rtl"), text.unbroken_token(t).alias("unbroken"))


@query("""with n as (select p_partkey, p_size n from part)
select p_partkey, [ '', 'X', 'XX', 'XXX', 'XL', 'L'][(n // 10) % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] as roman,
 repeat(chr(65 + (n - 1) % 26), ((n - 1) // 26 + 1)::bigint) as letters from n""")
def page_numerals(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return read(spark, d, "part").select("p_partkey", text.roman(n).alias("roman"), text.alphabetic(n).alias("letters"))


@query(r"""with u as (select page_id, regexp_replace(url, '^.*?://', '') p, url from pages)
select page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '/') as path,
 case when regexp_full_match(p, '/[^/]*') then '/' else regexp_extract(p, '^(.*)/[^/]*$', 1) end as folder,
 regexp_replace(regexp_replace(p, '[<>:"/\\|?*]', '_', 'g'), '[. ]+$', '') as component, suffix(lower(p), '.html') as html from u""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    rows = read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^.*?://", "").alias("p"))
    return rows.select("page_id", urls.normal_path(p).alias("path"), urls.folder(p).alias("folder"), urls.safe_component(p).alias("component"), urls.has_extension(p, ".HTML").alias("html"))


@query(r"""select page_id, regexp_extract(url, '^.*?://[^/]*') as origin, regexp_extract(url, '^.*?://[^/]*') || '/a%20b' as rooted,
 regexp_replace(regexp_replace(url, '\?.*$', ''), '/+$', '') || '/c.html' as relative, not regexp_matches(url, '^(?:https?://|mailto:|ftp://|tel:|javascript:)') and url <> '' as internal from pages""")
def url_resolution(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.origin(u).alias("origin"), urls.resolve(u, F.lit("/a b")).alias("rooted"), urls.resolve(u, F.lit("c.html")).alias("relative"), urls.internal_link(u).alias("internal"))


@query("""select doc_id, md5(substring(text, 1, 1024) || substring(text, 1025, 1024) || substring(text, 4097, 1024) || substring(text, 16385, 1024) || substring(text, 65537, 1024)
 || substring(text, 262145, 1024) || substring(text, 1048577, 1024)) as digest, length(text)::bigint as units, sha256(text) as identity from documents""")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", urls.sampled_digest(F.col("text"), 7).alias("digest"), F.length("text").cast("bigint").alias("units"), F.sha2("text", 256).alias("identity"))


@query("""select o_orderkey, (o_orderdate::date - date '2000-01-01')::int as day_index, (isodow(o_orderdate) - 1)::int as weekday,
 (year(o_orderdate) % 4 = 0 and year(o_orderdate) % 100 <> 0) or year(o_orderdate) % 400 = 0 as leap, day(last_day(o_orderdate::date))::int as month_days,
 (o_orderdate::date + 45)::date as later, strftime(o_orderdate, '%b %d') as short from orders""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", dates.day_index(o).alias("day_index"), dates.weekday(o).alias("weekday"), dates.leap_year(F.year(o)).alias("leap"), F.day(F.last_day(o)).alias("month_days"), F.date_add(o, 45).alias("later"), F.date_format(o, "MMM dd").alias("short"))


@query("""select event_id, case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 16 then 'afternoon' when hour(ts) between 17 and 20 then 'evening' when ts is not null then 'night' end as bucket,
 epoch(date_trunc('day', ts) + to_hours(case when hour(ts) < 5 then 5 when hour(ts) < 12 then 12 when hour(ts) < 17 then 17 when hour(ts) < 21 then 21 else 24 end) - ts)::bigint as to_boundary,
 epoch(ts + to_seconds(90000) - ts)::bigint as added from events""")
def day_buckets(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    added = F.when(ts.isNotNull(), 90000).cast("bigint")
    return read(spark, d, "events").select("event_id", dates.bucket(F.hour(ts)).alias("bucket"), dates.seconds_to_boundary(ts).alias("to_boundary"), added.alias("added"))


@query("""with s as (select l_orderkey, l_linenumber, (l_quantity * 977)::bigint s, (l_extendedprice)::bigint p from lineitem)
select l_orderkey, l_linenumber, case when s >= 3600 then (s // 3600) || 'h ' || (s // 60 % 60) || 'm' when s >= 60 then (s // 60) || 'm' else s || 's' end as took,
 case when s >= 120 and p % 120 > 0 and p % 120 < 100 then floor(s * (100 - p % 120) / (p % 120))::bigint end as time_left,
 case when s <= 60 then 0.0 else p * 60.0 / s end::double as rate, least(4294967295 - 1000 + s, 4294967295)::bigint as saturated,
 ((s - p) % 4294967296 + 4294967296) % 4294967296 between 1 and 2147483647 as newer from s""")
def durations_and_estimates(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("s"), F.col("p")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 977).cast("bigint").alias("s"), F.bround("l_extendedprice").cast("bigint").alias("p"))
    return rows.select("l_orderkey", "l_linenumber", dates.duration(s).alias("took"), dates.time_left(s, p % 120).cast("bigint").alias("time_left"), dates.pages_per_minute(p, s).alias("rate"), dates.saturating_add(F.lit(4294966295), s).alias("saturated"), dates.sequence_newer(s, p).alias("newer"))


@query("""with s as (select o_orderkey, o_totalprice::bigint p, (o_orderkey % 40)::int m from orders)
select o_orderkey, (p % 2200)::int as y, (m % 14)::int as mo, m as da, p % 2200 between 2000 and 2099 and try_cast(printf('%04d-%02d-%02d', (p % 2200)::int, (m % 14)::int, m) as date) is not null as ok from s""")
def date_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", (F.bround("o_totalprice").cast("bigint") % 2200).cast("int").alias("y"), (F.col("o_orderkey") % 40).cast("int").alias("da"))
    rows = rows.withColumn("mo", (F.col("da") % 14).cast("int"))
    return rows.select("o_orderkey", "y", "mo", "da", dates.valid_date(F.col("y"), F.col("mo"), F.col("da")).alias("ok"))
