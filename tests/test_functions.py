import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import bidi, clips, dates, layout, markup, text, urls
from quire.operators import activity, ordering


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("t", "n"), [("don't stop--me well-known", 4), ("中文字 abc", 4), ("été", 1), ("á-b", 1), ("a--b", 2), ("-a- b-", 2), ("l’état-major", 1), ("×÷", 1), ("カタカナ words", 5), ("123 4.5", 3), ("", 0)])
def test_word_count(spark, t, n):
    assert one(spark, text.word_count(F.lit(t))) == n


@pytest.mark.parametrize(("w", "stems"), [("studies", ["study", "studi"]), ("running", ["runn", "runne", "run"]), ("été", []), ("as", [])])
def test_stems(spark, w, stems):
    assert one(spark, text.stem_variants(F.lit(w))) == stems


def test_natural_order(spark):
    names = ["Vol 10", "vol 2", "Vol 02b", "Vol 1", "Vol", "alpha"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(ordering.natural_key(F.col("n")), "n").collect()] == ["alpha", "Vol", "Vol 1", "vol 2", "Vol 02b", "Vol 10"]


def test_capped_distance(spark):
    assert one(spark, text.capped_distance(F.lit("kitten"), F.lit("sitting"), 5)) == 3
    assert one(spark, text.capped_distance(F.lit("kitten"), F.lit("sitting"), 2)) == 3


@pytest.mark.parametrize(("values", "expected"), [([30, 31], (30, 2)), ([10, 20, 33], (21, 3)), ([33, 20, 10], (20, 3)), ([0, 70000, 1], (32768, 2)), ([], (0, 0))])
def test_capped_average(spark, values, expected):
    got = one(spark, activity.capped_average(F.lit(values).cast("array<bigint>")))
    assert (got["avg"], got["n"]) == expected


def test_streaks(spark):
    days = spark.sql("select 1L as k, date_add(date'2024-01-01', d - 1) as day from values 1, 2, 3, 5, 6 t(d)")
    for today, current in (("2024-01-06", 2), ("2024-01-07", 2), ("2024-01-08", 0)):
        r = activity.streak_summary(days, ["k"], F.lit(today).cast("date")).first()
        assert (r["longest"], r["current"]) == (3, current)


def test_span_splitting(spark):
    spans = spark.sql("select timestamp_ntz'2024-01-01 11:59:30' as ts, 60L as seconds union all select timestamp_ntz'2024-01-06 23:59:30', 60L")
    got = {(r["bucket"], r["weekday"], r["part"]) for r in activity.split_spans(spans).collect()}
    assert got == {("morning", 0, 30.0), ("afternoon", 0, 30.0), ("night", 5, 30.0), ("night", 6, 30.0)}
    ends = spark.sql("select timestamp_ntz'2024-01-01 23:59:00' as ts, 60L as seconds")
    assert activity.span_days(ends).count() == 1  # ends at midnight


def test_dates(spark):
    assert one(spark, dates.weekday(F.lit("2000-01-01").cast("date"))) == 5
    assert one(spark, dates.saturating_add(F.lit(4294967290), F.lit(10))) == 4294967295
    assert one(spark, dates.pages_per_minute(F.lit(10), F.lit(60))) == 0
    assert abs(one(spark, dates.pages_per_minute(F.lit(10), F.lit(61))) - 9.836) < 1e-3
    assert one(spark, dates.valid_date(F.lit(2024), F.lit(2), F.lit(30))) is False
    assert [one(spark, dates.bucket(F.lit(h))) for h in (4, 5, 12, 17, 21)] == ["night", "morning", "afternoon", "evening", "night"]
    assert one(spark, dates.sequence_newer(F.lit(1), F.lit(4294967295))) is True
    assert one(spark, dates.time_left(F.lit(119), F.lit(50))) is None
    assert one(spark, dates.word_progress(F.lit(5), F.lit(4))) is None
    assert one(spark, dates.size_progress(F.lit(10.0), F.lit(10.0), F.lit(0.5), F.lit(40.0))) == 0.375
    assert str(one(spark, dates.finish_date(F.lit("2024-01-01").cast("date"), F.lit(50), F.lit(50), F.lit(10)))) == "2024-01-11"


def test_paths_and_urls(spark):
    assert one(spark, urls.normal_path(F.lit("a//b/../c"))) == "a/c"
    assert one(spark, urls.normal_path(F.lit("a/./b"))) == "a/./b"
    assert one(spark, urls.normal_path(F.lit("../x"))) == "x"
    assert one(spark, urls.normal_path(F.lit("/a"), True)) == "/a"
    assert one(spark, urls.resolve(F.lit("h.org/x?q=1"), F.lit("y"))) == "http://h.org/x/y"
    assert one(spark, urls.resolve(F.lit("https://h.org/a/b"), F.lit("/c d"))) == "https://h.org/c%20d"
    assert one(spark, urls.resolve(F.lit("x"), F.lit("ftp://z/%zz"))) == "ftp://z/%25zz"
    assert one(spark, urls.percent_decode(F.lit("a%20b%zz+"))) == "a b%zz+"
    assert one(spark, urls.safe_component(F.lit("a:b?. "))) == "a_b_"


def test_line_breaks_are_optimal():
    rnd = random.Random(3)
    for _ in range(200):
        widths, width = [rnd.randint(1, 8) for _ in range(rnd.randint(1, 9))], 12

        def cost(ends):
            total, i = 0.0, 0
            for e in ends:
                used = sum(widths[i:e]) + e - i - 1
                if used > width and e - i > 1:
                    return float("inf")
                total += 0 if e == len(widths) else max(0, width - used) ** 2
                i = e
            return total

        n = len(widths)
        best = min(cost([*c, n]) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert cost(layout.best_ends(widths, width)) == best


def test_wrap():
    assert layout.wrap_text("aa bb cc\n\nabcdefgh", 5) == ["aa bb", "cc", "", "abcde", "fgh"]


def test_hyphenation(spark):
    h = layout.Hyphenator(["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"])
    assert h.positions("hyphenation") == [2, 6]
    assert h.positions("well-known") == [5]
    assert one(spark, layout.hyphenate(F.lit("hyphenation"), ["hy3ph"])) == [2]


def test_visual_order_and_nfc(spark):
    assert one(spark, bidi.visual_order(F.lit("ab אבג"))) == "ab גבא"
    assert one(spark, layout.nfc(F.lit("é"))) == "é"
    assert one(spark, text.starts_right_to_left(F.lit("1 אב a"))) is True


def test_numerals(spark):
    assert [one(spark, text.roman(F.lit(n))) for n in (1, 4, 1990, 3999)] == ["I", "IV", "MCMXC", "MMMCMXCIX"]
    assert [one(spark, text.alphabetic(F.lit(n))) for n in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]


def test_blocks(spark):
    page = "<html><head><title>x</title></head><body><h1 id='t'>Head</h1><p>a  b<b>c</b></p><ul><li><p>one</p></li></ul><table><tr><td>1</td><td>2</td></tr></table><p>tail"
    rows = markup.blocks(spark.createDataFrame([(1, page), (2, None)], "id bigint, html string"), "id").orderBy("id", "block").collect()
    assert [(r["kind"], r["tag"], r["text"]) for r in rows] == [("block", "h1", "Head"), ("block", "p", "a bc"), ("block", "li", "• one"), ("cell", "td", "1"), ("cell", "td", "2"), ("block", "p", "tail")]
    assert rows[0]["anchors"] == ["t"]


def test_css(spark):
    rules = markup.css_rules(spark.createDataFrame([(1, "/* x */ p, .C { color: red !important; margin: 1em } @media print { p { color: blue } }")], "id int, css string"), "id").collect()
    assert {(r["selector"], r["property"], r["value"]) for r in rules} == {("p", "color", "red"), (".c", "color", "red"), ("p", "margin", "1em"), (".c", "margin", "1em")}
    got = one(spark, markup.css_length(F.lit("1.5em")))
    assert (got["number"], got["unit"]) == (1.5, "em")


def test_clips(spark):
    rows = [("A", False, False, False), ("well-", False, False, False), ("known", False, False, False), ("hyphen-", True, False, False), ("ated", False, False, False), ("x", False, True, False), ("New", False, False, True)]
    df = spark.createDataFrame([(rows,)], "v array<struct<text: string, hyphen: boolean, attached: boolean, paragraph: boolean>>")
    assert df.select(clips.assemble(F.col("v"))).first()[0] == "A well-known hyphenatedx\nNew"
    path = one(spark, clips.position_path(F.lit(2), F.lit(3), F.lit(4)))
    assert tuple(one(spark, clips.parse_position(F.lit(path)))) == (2, 3, 4)
    assert one(spark, clips.parse_position(F.lit("/x"))) is None
    assert [one(spark, clips.safe_cache_path(F.lit(p))) for p in ("a/b.bin", "../a", "/a", "a/./b", "a b")] == [True, False, False, False, False]


def test_hyphenator_of_language():
    patterns = {"en": ["1na", "n2at"], "de": ["1na"], "xx": ["1na"]}
    h = layout.hyphenator("en_GB", patterns)
    assert (h.before, h.after) == (3, 3) and layout.hyphenator("DE", patterns).before == 2
    assert [layout.hyphenator(t, patterns) for t in ("xx", "fr", "", None)] == [None] * 4
    assert layout.hyphenator("de", patterns).positions("banana") == [2, 4]
