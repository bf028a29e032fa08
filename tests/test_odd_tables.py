"""Queries against their SQL on small tables of odd rows."""

import duckdb
from conftest import SMALL, plain
from pyspark.sql import functions as F

from quire.operators import joins
from quire.plans import catalog, source_queries
from quire.sources import pdf


def agrees(spark, folder, name, **tables):
    """The query's rows equal those of its SQL on tables given as DuckDB selects."""
    duck = duckdb.connect()
    duck.execute("set timezone='UTC'")
    for table, sql in tables.items():
        duck.execute(f"create table {table} as {sql}")
        duck.execute(f"copy {table} to '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_day_buckets_round_halves_to_even(spark, tmp_path):
    times = ["2024-03-31 01:59:58.5", "2024-03-31 01:59:57.5", "2024-01-01 04:59:59.5", "2024-01-01 05:00:00", "2024-01-29 20:59:59.999999", "1969-12-31 23:59:58.5", "2024-01-17 12:00:00.500001", "2024-01-17 12:00:00.499999"]
    rows = ", ".join(f"({i}, timestamp '{t}')" for i, t in enumerate(times))
    agrees(spark, tmp_path, "day_buckets", events=f"select * from (values {rows}, (99, null)) t(event_id, ts)")


def test_html_titles_decode_what_the_sql_decodes(spark, tmp_path):
    titles = ["a &amp;&amp", "b &am", "c &quot", "d &amp;lt; &amp;amp;", "e &eacute; &#39; &#x27;", "&lt;f&gt; &quot;g&quot;", "&LT; &ampamp;", "h\nh", ""]
    rows = ", ".join(f"({i}, '<html><head><title>{t}</title></head></html>')" for i, t in enumerate(titles))
    agrees(spark, tmp_path, "html_titles", pages=f"select * from (values {rows}, (98, null), (99, '<p>untitled</p>')) t(page_id, html)")


def test_pdf_files_are_dealt_over_all_tasks(spark):
    assert source_queries._parts(spark, SMALL).select(F.spark_partition_id().alias("task")).distinct().count() >= 4


def test_pdf_pages_share_a_font(monkeypatch):
    made, font = [], pdf.Font
    monkeypatch.setattr(pdf, "Font", lambda *a: made.append(1) or font(*a))
    kids = b"".join(b"%d 0 obj << /Type /Page /Contents 9 0 R >> endobj " % n for n in (5, 6, 7))
    drawn = b"9 0 obj << /Length 31 >>\nstream\nBT /F1 10 Tf 7 8 Td (ab) Tj ET  \nendstream endobj "
    top = b"1 0 obj << /Pages 2 0 R >> endobj 2 0 obj << /Kids [5 0 R 6 0 R 7 0 R] /Resources << /Font << /F1 3 0 R >> >> >> endobj 3 0 obj << /FirstChar 97 /Widths [500 250.5] >> endobj "
    file = pdf.Pdf(b"%PDF-1.5 " + top + kids + drawn + b"trailer << /Root 1 0 R >>")
    got = [r for page in file.pages() for r in pdf.runs(file, file.contents(page), page["Resources"])]
    assert [(r["text"], r["x0"], round(r["x1"], 6)) for r in got] == [("ab", 7.0, 14.505)] * 3
    assert len(made) == 1


def test_duplicate_geometry_counts_copies_and_odd_boxes(spark, tmp_path):
    part = """select k::bigint as p_partkey, case when k % 97 = 0 then null when k % 89 = 0 then 0 when k % 83 = 0 then -7 when k % 79 = 0 then 400 else hash(k) % 50 + 1 end::int as p_size,
     case when k % 101 = 0 then null else 'T' || hash(k * 3) % 2 end as p_type from (select unnest(range(-600, 1400)) k union all select unnest(range(2400, 2600)) union all select unnest(range(0, 1200, 3)) union all select null)"""
    agrees(spark, tmp_path, "duplicate_geometry", part=part)


def test_equal_boxes_make_no_pairs(spark):
    boxes = spark.range(200_000).select((F.col("id") % 100_000).alias("id"), F.lit(1.0).alias("x0"), F.lit(9.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(12.0).alias("y1"), F.lit("t").alias("t"))
    got = joins.overlapping(boxes, ["t"], 96.0).groupBy("same").count().collect()
    assert [tuple(r) for r in got] == [(2 * 199_998, 100_000)]
