"""Places in books as paths: readers of elements against hand-made pages, both ways."""

from conftest import SMALL
from pyspark.sql import functions as F

from quire.functions.markup import BlockReader, PathReader
from quire.operators import positions
from quire.plans import catalog

PAGE = "<html><head><title>no</title></head> x<body><div><p>ab<b>c</b>d&amp;</p><ul><li>one<li>two<ul><li>in</ul></ul></div><!-- n -->tail<p>e<p></p></body> out</html>"


def test_paths_of_elements_and_text_nodes():
    rows = PathReader.of(PAGE)
    texts = [(r[0], r[1], r[2], r[3]) for r in rows if r[1]]
    assert texts == [
        ("/div[1]/p[1]", 1, 0, 2), ("/div[1]/p[1]/b[1]", 1, 2, 1), ("/div[1]/p[1]", 2, 3, 2), ("/div[1]/ul[1]/li[1]", 1, 5, 3), ("/div[1]/ul[1]/li[2]", 1, 8, 3),
        ("/div[1]/ul[1]/li[2]/ul[1]/li[1]", 1, 11, 2), ("", 1, 13, 4), ("/p[1]", 1, 17, 1),
    ]
    assert [(r[0], r[4]) for r in rows if r[1] == 0 and r[0].rpartition("/")[2].startswith("p[")] == [("/div[1]/p[1]", 1), ("/p[1]", 2), ("/p[2]", 3)]
    assert PathReader.of(None) == [] and PathReader.of("plain")[0][:4] == ("", 1, 0, 5)
    assert [r[0] for r in PathReader.of("a<script>var x='<p>'</script>b") if r[1]] == ["", ""]


def test_offsets_of_blocks_count_what_is_seen():
    reader = BlockReader()
    reader.feed("<head><title>t</title></head>\n<p>abc</p><p>de</p>")
    reader.close()
    reader.flush()
    assert [(r[2], r[5]) for r in reader.rows] == [("abc", 1), ("de", 4)]


def test_references_lacking_their_semicolon_stay_as_written():
    page = "<body><h1>a&amp;&amp</h1><p title='x&copy=1'>b&lt;&nope;&notit; &#65;&#66 & c</p><p>d</p></body>"
    reader = BlockReader()
    reader.feed(page)
    reader.close()
    reader.flush()
    assert [(r[2], r[5]) for r in reader.rows] == [("a&&amp", 0), ("b<&nope;&notit; A&#66 & c", 6), ("d", 31)]
    assert [r[2:4] for r in PathReader.of(page) if r[1]] == [(0, 6), (6, 25), (31, 1)]


def book(spark):
    pages = [(1, 0, PAGE), (1, 1, "<body><p>0123456789</p></body>"), (1, 2, None), (2, 0, "<p>x</p>"), (None, 0, "<p>y</p>")]
    return positions.path_index(spark.createDataFrame(pages, "book bigint, section bigint, html string").repartition(3), ["book", "section"])


def test_places_as_paths(spark):
    index = book(spark)
    rows = [(0, 1, 0, 3, None, None, None, None), (1, 1, 0, None, 3, None, None, None), (2, 1, 0, None, None, 3, None, None), (3, 1, 1, None, None, None, 2, 5), (4, 1, 1, 99, None, None, 0, 5), (5, 1, 2, 0, None, None, None, None), (6, 1, 0, 99, 2, 1, 1, 2), (7, 9, 0, 0, None, None, None, None)]
    places = spark.createDataFrame(rows, "n int, book bigint, section bigint, offset bigint, item bigint, paragraph bigint, page bigint, pages bigint")
    got = {r["n"]: (r["path"], r["share"]) for r in positions.to_paths(places, index, ["book"], "section").collect()}
    root = "/body/DocFragment[1]/body"
    assert {n: p for n, (p, _) in got.items()} == {
        0: f"{root}/div[1]/p[1]/text()[2].1", 1: f"{root}/div[1]/ul[1]/li[2]/ul[1]/li[1]", 2: f"{root}/p[2]", 3: "/body/DocFragment[2]/body/p[1]/text()[1].5",
        4: "/body/DocFragment[2]/body", 5: None, 6: f"{root}/div[1]/ul[1]/li[2]", 7: None,
    }
    assert got[3][1] == (18 + 0.5 * 10) / 28 and got[0][1] == 0 and got[7][1] is None


def test_paths_as_places(spark):
    index, root = book(spark), "/body/DocFragment[1]/body"
    asked = {
        f"{root}/div[1]/p[1]/text()[2].2": (0, 4), f"{root}/div/p/b/text().1": (0, 2), f"{root}/div[1]/p[1]/text()[2].99": (0, 4), f"{root}/div[1]/ul[1]/li[2]": (0, 8),
        f"{root}/section[4]/p[2]/text()[9].1": (0, 17), f"{root}/text()[1].3": (0, 15), root: (0, 0), "/body/DocFragment[2]/body/p[1]/text()[1].4": (1, 3), "nowhere": (1, None), "/body/DocFragment[7]/body/p[9]": (1, None),
    }
    rows = [(1, p, 0.8, 3) for p in asked] + [(1, None, 0.5, 3), (5, root, 0.5, 3)]
    got = {(r["book"], r["path"]): r for r in positions.from_paths(spark.createDataFrame(rows, "book bigint, path string, share double, pages bigint"), index, ["book"], "section").collect()}
    assert {p: (got[1, p]["section"], got[1, p]["offset"]) for p in asked} == asked
    half = got[1, None]
    assert (half["section"], half["offset"], half["page"]) == (0, None, 2) and abs(half["intra"] - 14 / 18) < 1e-12
    assert got[5, root]["section"] is None and got[1, "nowhere"]["page"] == 1


def test_every_place_leads_back(spark):
    index = book(spark)
    every = positions.sizes(index, ["book"], "section").select("book", "section", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("visible") - 1)).alias("offset"))
    got = positions.identical(every.where("book is not null"), index, ["book"], "section")
    assert got.count() == 29 == got.where("at = back").count()
    assert positions.identical(every.limit(0), index, ["book"], "section").count() == 0


def test_places_behind_open_references_lead_back(spark):
    pages = [(1, 0, "<body><article><h1>x&amp;&amp</h1><p>one &am</p><p>two</p></article></body>")]
    index = positions.path_index(spark.createDataFrame(pages, "book bigint, section bigint, html string"), ["book", "section"])
    places = spark.createDataFrame([(1, 0, 6), (1, 0, 13)], "book bigint, section bigint, offset bigint")
    got = {r["at"]: (r["path"], r["back"]) for r in positions.identical(places, index, ["book"], "section").collect()}
    root = "/body/DocFragment[1]/body/article[1]"
    assert got == {6: (f"{root}/p[1]/text()[1].1", 6), 13: (f"{root}/p[2]/text()[1].1", 13)}


def test_pages_of_places_are_read_once(spark, capsys):
    for name in ("position_round_trip", "share_round_trip"):
        catalog.QUERIES[name](spark, SMALL).explain()
        assert "MapInPandas" not in capsys.readouterr().out
