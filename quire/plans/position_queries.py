"""Queries of places in books as paths and shares. Pages stand for sections, ten to a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import positions
from quire.plans.registry import query, read
from quire.storage import Stored

_BY = ["book", "section"]


def _index(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.floor(F.col("page_id") / 10).cast("bigint").alias("book"), (F.col("page_id") % 10).alias("section"), "html").where("book is not null and html is not null").distinct()
    return Stored(positions.path_index(pages, _BY), "paths").df  # met by ten steps: pages are read once


# The visible text of a page by its tags alone: the paragraphs of these pages are all in one article.
_SEEN = """b as (select page_id, regexp_extract(html, '(?s)<body[^>]*>(.*?)(?:</body>|$)', 1) body from (select distinct page_id, html from pages where page_id is not null and html is not null)),
 split as (select page_id, string_split(body, '<p>') v, body from b),
 seen as (select page_id, k, v[k + 1] t, array_to_string(v[1:k], '<p>') before from split, range(1, 2000) r(k) where k < len(v)),
 visible as (select page_id, length(regexp_replace(regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&[A-Za-z0-9#]+;', '.', 'g')) n from b),
 room as (select page_id, n, sum(n) over (partition by page_id // 10 order by page_id % 10) - n before, sum(n) over (partition by page_id // 10) total from visible)"""


@query(rf"""with {_SEEN}, starts as (select page_id, k, t, length(regexp_replace(regexp_replace(regexp_replace(before, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '&[A-Za-z0-9#]+;', '.', 'g')) as "at" from seen)
select page_id // 10 as book, page_id % 10 as section, "at", '/body/DocFragment[' || (page_id % 10 + 1) || ']/body/article[1]/p[' || k || ']' || case when starts_with(t, '<b>') then '/b[1]' else '' end || '/text()[1].1' as path, "at" as back
from starts where regexp_matches(t, '^(<b>)?[^<]')""")
def position_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph's first visible character as a path, and the offset that the path leads back to."""
    index = _index(spark, d)
    starts = index.where((F.col("node") == 1) & F.col("path").rlike(r"/p\[\d+\](?:/b\[1\])?\z")).groupBy(*_BY, "paragraph").agg(F.min("start").alias("offset"))
    return positions.identical(starts.select(*_BY, "offset"), index, ["book"], "section")


@query(rf"""with {_SEEN}, asked as (select page_id // 10 book, k, k / 20.0 share from (select distinct page_id // 10 * 10 page_id from visible), range(21) r(k)),
 reached as (select a.book, a.k, a.share, floor(a.share * r.total) target, r.page_id % 10 section, r.before, r.n, row_number() over (partition by a.book, a.k order by r.page_id) nth from asked a join room r on r.page_id // 10 = a.book where r.before + r.n >= floor(a.share * r.total)),
 one as (select *, greatest(0.0, least(1.0, (target - before) / n)) intra from reached where nth = 1)
select book, k, section, intra, floor(intra * 6 + 0.5)::bigint as page, (before_of + (floor(intra * 6 + 0.5) / 6) * n_of) / total_of as share from (select one.*, room.before before_of, room.n n_of, room.total total_of from one join room on room.page_id = one.book * 10 + one.section)""")
def share_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Twentieths of every book as section and page of seven, and the share that this page is."""
    index = _index(spark, d)
    asked = index.select("book").distinct().select("book", F.explode(F.sequence(F.lit(0), F.lit(20)).cast("array<bigint>")).alias("k"), F.lit(None).cast("string").alias("path"), F.lit(7).cast("bigint").alias("pages"))
    found = positions.from_paths(asked.withColumn("share", F.col("k") / 20), index, ["book"], "section").drop("offset", "path", "share")
    nothing = F.lit(None).cast("bigint")
    back = positions.to_paths(found.select("*", nothing.alias("offset"), nothing.alias("item"), nothing.alias("paragraph")), index, ["book"], "section")
    return back.select("book", "k", "section", "intra", "page", "share")
