"""Queries of text runs on pages: reading order and hidden text.

Parts of the table ``part`` stand for runs: 48 to a page, six pages to a file, with running heads, a rotated run, a heading, two
columns, a table on two pages of three and a last paragraph. Only these places are made in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import CJK, LETTERS
from quire.operators import pages
from quire.plans.registry import query, read

BOX = (0.0, 0.0, 600.0, 800.0)

_AT = "p_partkey % 48 as r, cast(floor(p_partkey / 48) as bigint) % 6 as page, cast(floor(p_partkey / 288) as bigint) as doc, p_partkey as run, coalesce(p_size, 7) as s, coalesce(p_name, '') as name"
_TABLE = "r between 25 and 39 and page % 3 <> 2"
_PLACED = f"""doc, page, run, run % 7 as source_order,
 case when r = 0 then concat('Running  HEAD ', cast(doc as string)) when r = 1 then concat('Page ', cast(page as string)) when r = 2 then 'confidential' when {_TABLE} then cast(s as string)
  else concat(name, case s % 4 when 0 then '.' when 1 then '' when 2 then ': ' else ' and' end) end as text,
 cast(case when r < 3 then 100 when r = 4 then 30 when r < 25 then 30 + 300 * (r % 2) + s % 3 when r < 40 then 60 + 150 * ((r - 25) % 3) + s % 4 + case when page % 3 = 2 and (r - 25) % 3 = 1 then 150 else 0 end else 30 + 40 * (s % 2) end as double) as x0,
 cast(case when r < 3 then 200 when r = 4 then 560 when r < 25 then 210 + 300 * (r % 2) + s when r < 40 then 90 + 150 * ((r - 25) % 3) + s % 4 + case when page % 3 = 2 and (r - 25) % 3 = 1 then 150 else 0 end when page % 2 = 0 then 200 else 400 end as double) as x1,
 cast(case when r = 0 then 770 when r = 1 then 10 when r = 2 then 22 when r = 3 then 600 when r = 4 then 700 when r < 25 then 680 - 14 * cast(floor((r - 5) / 2) as bigint) - s % 2
  when r < 40 then 480 - 15 * cast(floor((r - 25) / 3) as bigint) + s % 2 else 380 - 14 * (r - 40) * (1 + s % 3) end as double) as y0, cast(10 + s % 3 as double) as h, case when r = 3 then 0.0 else 50.0 end as dx, case when r = 3 then 10.0 else 0.0 end as dy"""
_RUNS = "text, doc, page, run, source_order, x0, x1, y0, y0 + h as y1, y0 as baseline, cast(dx as double) as dx, cast(dy as double) as dy"


def _sql(columns: str) -> str:
    """A list of columns as DuckDB reads it."""
    return columns.replace("as string)", "as varchar)")


_SOURCE = f"runs as (select {_RUNS} from (select {_sql(_PLACED)} from (select {_sql(_AT)} from part)))"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    at = read(spark, d, "part").selectExpr(*_split(_AT))
    return at.selectExpr(*_split(_PLACED)).selectExpr(*_split(_RUNS))


def _split(columns: str) -> list[str]:
    """The columns of a list, parted at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@query(f"""with {_SOURCE}, banded as (select *, case when (y0 + y1) / 2 >= 800 - 80 then 'top' when (y0 + y1) / 2 <= 80 then 'bottom' end band,
  lower(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'))) norm, count(*) over (partition by doc, page) held from runs),
 heads as (select doc, band, norm from banded where band is not null and norm <> '' group by all having count(distinct coalesce(page, -1)) >= 3),
 flow as (select b.* from banded b where not (b.dy <> 0 and (b.dx = 0 or 2 * abs(b.dy) > abs(b.dx))) and not exists (select 1 from heads h where h.doc is not distinct from b.doc and h.band = b.band and h.norm = b.norm)),
 placeable as (select *, row_number() over () id, coalesce(doc, -1) * 10 + coalesce(page, 9) pg from flow where held <= 256),
 usual as (select * from placeable where x0 is not null and x1 is not null and y0 is not null and y1 is not null), bare as (from placeable where x0 is null or x1 is null or y0 is null or y1 is null),
 heights as (select pg, list_sort(list(least(63, floor((y1 - y0) * 64 / 800))))[(count(*) + 1) // 2] b from usual group by pg),
 measured as (select u.*, greatest(1, (b + 1) * 800 / 64) m, greatest(1, greatest(1, (b + 1) * 800 / 64) / 3) tol from usual u join heights using (pg)),
 far as (select * from measured a where strlen(text) <= 8 and exists (select 1 from measured b where b.pg = a.pg and strlen(b.text) <= 8 and abs(a.baseline - b.baseline) <= a.tol and abs(a.x0 + a.x1 - b.x0 - b.x1) >= 8 * a.m)),
 met as (select * from far a where exists (select 1 from far b where b.pg = a.pg and abs(a.baseline - b.baseline) > a.tol and abs(a.baseline - b.baseline) <= 2 * a.m and abs(a.x0 - b.x0) <= a.m)),
 cells as (select id from far a where exists (select 1 from met b where b.pg = a.pg and abs(a.baseline - b.baseline) <= a.tol)),
 kinds as (select *, id in (from cells) cell, id not in (from cells) and (x1 - x0) * 100 >= 55 * 600 heading from measured),
 parts as (select *, (select count(*) from kinds b where b.pg = a.pg and b.heading and b.baseline > a.baseline) above, max(baseline) filter (cell) over (partition by pg) top, min(baseline) filter (cell) over (partition by pg) bottom,
   not cell and not heading plain, least(63, floor(x0 * 64 / 600))::int first, least(63, floor(x1 * 64 / 600))::int last, least(63, floor((x0 + x1) / 2 * 64 / 600))::int middle from kinds a),
 sections as (select *, case when top is null then least(255, above) else least(255, 3 * above + case when cell then 1 when baseline > top then 0 when baseline < bottom then 2 else 1 end) end section from parts),
 used as (select distinct pg, unnest(range(first, last + 1)) bin from sections where plain),
 steps as (select pg, bin, lead(bin) over (partition by pg order by bin) - bin - 1 wide from used),
 chosen as (select pg, list_reduce(list({{'s': (bin + 1)::int, 'w': wide::int}} order by bin), lambda a, g: case when len(a) < 2 then list_append(a, g) when a[1].w <= a[2].w then case when g.w > a[1].w then [g, a[2]] else a end
   when g.w > a[2].w then [a[1], g] else a end, []::struct(s int, w int)[]) g from steps where wide >= 3 and pg in (select pg from sections where plain group by pg having count(*) >= 4) group by pg),
 dealt as (select s.*, case when plain then len(list_filter(coalesce(g, []), lambda x: s.middle > x.s + x.w // 2)) else 0 end col, len(coalesce(g, [])) gaps from sections s left join chosen using (pg)),
 full_ as (select pg from (select pg, col, any_value(gaps) gaps, count(*) n from dealt where plain group by 1, 2) group by pg having count(*) = any_value(gaps) + 1 and min(n) >= 2),
 columns_ as (select *, case when pg in (from full_) then col else 0 end "column" from dealt),
 across as (select *, bool_or(cell) over (partition by pg, section) wide from columns_),
 placed as (select *, row_number() over (partition by pg order by section, case when wide then 0 else "column" end, baseline desc, x0, source_order, run, text) - 1 position from across),
 before as (select *, lag(section) over w s, lag("column") over w c, lag(baseline) over w b, lag(x0) over w x, lag(text) over w t from placed window w as (partition by pg order by position)),
 lines as (select *, position = 0 or section <> s parted, position = 0 or section <> s or "column" <> c or abs(b - baseline) > tol new_line, abs(b - baseline) gap from before)
select doc, page, run, text, section::bigint section, "column"::bigint "column", position, new_line, parted or heading or (new_line and (gap > 2 * m or abs(x - x0) > 2 * m or cell or
  (gap * 2 > 3 * m and regexp_matches(rtrim(t), '[.!?:]$') and not regexp_matches(ltrim(text), '^[a-z]')))) new_block, heading, cell, false as fallback from lines
union all select doc, page, run, text, null, null, (select count(*) from usual u where u.pg = bare.pg) + row_number() over (partition by pg order by run, text) - 1, true, true, false, false, false from bare
union all select doc, page, run, text, 0, 0, row_number() over (partition by doc, page order by run, source_order, text) - 1, true, true, false, false, true from flow where held > 256""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """All runs of all pages in reading order, running heads and rotated runs left out."""
    return pages.reading_order(_runs(spark, d), BOX)


_HIDDEN = """doc, page, run,
 case s % 13 when 0 then '' when 1 then '--' when 2 then concat('Producer: ', name) else concat('w ', cast(s % 5 as string)) end as text,
 cast(case s % 17 when 3 then -70 when 4 then 580 else 40 * (r % 8) + s end as double) as x0, cast(30 + s % 7 * case when s % 19 = 5 then 0 else 1 end - case when s % 19 = 5 then 30 else 0 end as double) as w,
 cast(20 * (run % 31) + s as double) as y0, cast(10 + s % 3 as double) as h, cast(case when s % 23 = 6 then 0 else 40 end as double) as dx, cast(0 as double) as dy, coalesce(r % 5 <> 0, false) as hidden"""
_BOXES = "doc, page, run, text, x0, x0 + w as x1, y0, y0 + h as y1, dx, dy, hidden"
_IMAGES = "doc, page, cast(100 * (run % 5) as double) as x0, cast(100 * (run % 5) + 20 * s as double) as x1, cast(90 * (run % 7) as double) as y0, cast(90 * (run % 7) + 10 * s as double) as y1"
_CHAIN = "abs(a.y0 + a.y1 - b.y0 - b.y1) <= 2 * greatest(800 / 6, 8 * greatest(a.y1 - a.y0, b.y1 - b.y0)) and 2 * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= least(a.x1 - a.x0, b.x1 - b.x0)"


@query(f"""with at_ as (select {_sql(_AT)} from part), runs as (select {_BOXES} from (select {_sql(_HIDDEN)} from at_)), images as (select {_IMAGES} from at_ where r % 24 = 11),
 n as (select *, lower(trim(text)) norm, (x1 - x0) * (y1 - y0) area, coalesce(doc, -1) * 10 + coalesce(page, 9) pg from runs),
 e as (select a.*, case when not hidden then 'not_hidden' when text = '' then 'empty' when not regexp_matches(text, '[{LETTERS}{CJK}]') then 'unmappable' when starts_with(norm, 'producer:') then 'metadata_like'
   when x1 <= x0 or y1 <= y0 then 'zero_area' when dx = 0 and dy = 0 then 'zero_transform' when 2 * greatest(0, least(600, x1) - greatest(0, x0)) * greatest(0, least(800, y1) - greatest(0, y0)) < area then 'off_page'
   when not exists (select 1 from images i where i.doc is not distinct from a.doc and i.page is not distinct from a.page and i.x1 > i.x0 and i.y1 > i.y0 and 4 * greatest(0, least(i.x1, a.x1) - greatest(i.x0, a.x0)) * greatest(0, least(i.y1, a.y1) - greatest(i.y0, a.y0)) >= area) then 'no_image_overlap'
   when exists (select 1 from n b where b.pg = a.pg and not b.hidden and b.norm = a.norm and b.x1 > b.x0 and b.y1 > b.y0 and {_CHAIN}) then 'duplicate_visible' end v from n a),
 g as (select pg, norm, list({{'run': run, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}} order by run, x0, y0, x1, y1) rs from e where v is null group by 1, 2),
 k as (select pg, norm, unnest(list_reduce(rs, lambda o, b: case when len(list_filter(o, lambda a: {_CHAIN})) > 0 then o else list_append(o, b) end, []::struct(run bigint, x0 double, x1 double, y0 double, y1 double)[])) r from g)
select doc, page, e.run, coalesce(v, case when exists (select 1 from k where k.pg = e.pg and k.norm = e.norm and k.r.run is not distinct from e.run and k.r.x0 = e.x0 and k.r.y0 = e.y0) then 'qualified' else 'duplicate_hidden' end) verdict from e""")
def hidden_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What every run is, hidden or not, on pages with images."""
    at = read(spark, d, "part").selectExpr(*_split(_AT))
    images = at.where("r % 24 = 11").selectExpr(*_split(_IMAGES))
    return pages.hidden_verdicts(at.selectExpr(*_split(_HIDDEN)).selectExpr(*_split(_BOXES)), images, BOX)
