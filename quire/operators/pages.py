"""Text runs of pages: reading order with tables, columns and running heads, and what hidden text is.

Runs are rows (doc, page, run, text, x0, x1, y0, y1, baseline, dx, dy, source_order); y grows upwards. A page is one window:
rows are dealt once by page and every step is a window over it. Pages of more than ``most`` runs keep the order of their
runs, so no page costs the square of an unbounded number; those that hold a thousandth of all rows (a thousand pages at
most) are known before and never meet in one task.

Null texts are empty. A run without a box or baseline stands last on its page, in the order of runs. Null docs and pages are a
doc and a page. Rows that repeat a run all take part; equal ones are neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.layout import rotated
from quire.functions.text import ascii_lower, has_lookup_character
from quire.operators.keys import heavy_keys
from quire.storage import Stored

BINS = 64
WHITE = r"[ \t\n\f\r]+"


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def running_heads(runs: DataFrame, box: tuple[float, float, float, float], pages: int = 3) -> DataFrame:
    """doc, band, line: texts in the top or bottom tenth of ``pages`` pages of a doc or more, as digests of their normal forms."""
    seen = _banded(runs, box).where("band is not null and line is not null").groupBy("doc", "band", "line", "page").agg(F.lit(1).alias("_one"))
    return seen.groupBy("doc", "band", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= pages).select("doc", "band", "line")


def _banded(runs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    _, y0, _, y1 = map(F.lit, box)
    middle, tenth = (F.col("y0") + F.col("y1")) / 2, (y1 - y0) / 10
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    normal = ascii_lower(F.trim(F.regexp_replace("text", WHITE, " ")))
    runs = runs.withColumn("band", F.when(solid & (middle >= y1 - tenth), "top").when(solid & (middle <= y0 + tenth), "bottom"))
    return runs.withColumn("line", F.when(F.col("band").isNotNull() & (normal != ""), F.md5(normal.cast("binary"))))


def _without_heads(runs: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Adds gone: a running head or foot, or a rotated run. Only rows in a band are joined."""
    rows = _banded(runs, box)
    heads = running_heads(runs, box).select(F.col("doc").alias("_doc"), F.col("band").alias("_band"), F.col("line").alias("_line"), F.lit(True).alias("_hit"))
    held = rows.where("line is not null").join(heads, _same("doc", "_doc") & (F.col("band") == F.col("_band")) & (F.col("line") == F.col("_line")), "left")
    held = held.withColumn("gone", F.coalesce(F.col("_hit"), F.lit(False))).drop("_doc", "_band", "_line", "_hit")
    out = held.unionByName(rows.where("line is null").withColumn("gone", F.lit(False)))
    turned = F.coalesce(rotated(F.col("dx"), F.col("dy")), F.lit(False))
    return out.withColumn("gone", F.col("gone") | turned).drop("band", "line")


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Which of 64 columns of the page a place is in."""
    return F.when(x <= low, 0).when(x >= high, BINS - 1).otherwise(F.least(F.lit(BINS - 1), F.floor((x - low) * BINS / (high - low)).cast("int")))


def _cells(rows: DataFrame, page) -> DataFrame:
    """Adds cell: short runs far apart on one line, if a line nearby has one that starts below or above it."""
    m, tol, b = F.col("m"), F.col("tol"), F.col("baseline")
    short = F.coalesce(F.octet_length("text") <= 8, F.lit(False)) & ~F.col("bare")
    rows = rows.withColumn("_short", F.collect_list(F.when(short, F.struct(b.alias("b"), (F.col("x0") + F.col("x1")).alias("c")))).over(page))
    beside = F.exists("_short", lambda s: (F.abs(s["b"] - b) <= tol) & (F.abs(s["c"] - (F.col("x0") + F.col("x1"))) >= 8 * m))
    rows = rows.withColumn("_far", short & beside).drop("_short")
    rows = rows.withColumn("_starts", F.collect_list(F.when(F.col("_far"), F.struct(b.alias("b"), F.col("x0").alias("x")))).over(page))
    below = lambda s: (F.abs(s["b"] - b) > tol) & (F.abs(s["b"] - b) <= 2 * m) & (F.abs(s["x"] - F.col("x0")) <= m)
    rows = rows.withColumn("_met", F.col("_far") & F.exists("_starts", below)).drop("_starts")
    rows = rows.withColumn("_rows", F.collect_list(F.when(F.col("_met"), b)).over(page))
    return rows.withColumn("cell", F.col("_far") & F.exists("_rows", lambda s: F.abs(s - b) <= tol)).drop("_far", "_met", "_rows")


#: SQL: the centres of at most two gaps of three empty bins or more between the first and the last used one. Of more gaps a wider one
#: takes the place of the narrower of the two.
_GAPS = """if(many < 4 or high - low < 2, cast(array() as array<int>), array_sort(transform(aggregate(filter(zip_with(
  filter(sequence(low + 1, high - 1), b -> (shiftright(used, b) & 1) = 0 and (shiftright(used, b - 1) & 1) = 1),
  filter(sequence(low + 1, high - 1), b -> (shiftright(used, b) & 1) = 0 and (shiftright(used, b + 1) & 1) = 1),
  (s, e) -> named_struct('s', s, 'w', e - s + 1)), g -> g.w >= 3),
  cast(array() as array<struct<s:int,w:int>>), (a, g) -> case when size(a) < 2 then concat(a, array(g))
   when a[0].w <= a[1].w and g.w > a[0].w then array(g, a[1]) when a[0].w > a[1].w and g.w > a[1].w then array(a[0], g) else a end), g -> g.s + g.w div 2)))"""


def _columns(rows: DataFrame, page, x0: Column, x1: Column) -> DataFrame:
    """Adds column: by the widest empty strips of the page, if every column has two runs or more."""
    plain = ~F.col("heading") & ~F.col("cell") & ~F.col("bare")
    rows = rows.withColumn("_a", _bin(F.col("x0"), x0, x1)).withColumn("_z", _bin(F.col("x1"), x0, x1)).withColumn("_plain", plain)
    rows = rows.withColumn("_mask", F.when(plain & (F.col("_a") <= F.col("_z")), F.expr("shiftleft(-1L, _a) & shiftrightunsigned(-1L, 63 - _z)")))
    rows = rows.withColumn("used", F.expr("coalesce(bit_or(_mask) over (partition by doc, page), 0L)")).withColumn("low", F.min(F.when(plain, F.col("_a"))).over(page)).withColumn("high", F.max(F.when(plain, F.col("_z"))).over(page))
    rows = rows.withColumn("many", F.count(F.when(plain, 1)).over(page)).withColumn("_gaps", F.when(F.col("nth") == 1, F.expr(_GAPS)))
    rows = rows.withColumn("_gaps", F.max("_gaps").over(page))
    at = _bin((F.col("x0") + F.col("x1")) / 2, x0, x1)
    rows = rows.withColumn("_at", at).withColumn("_c", F.when(plain, F.size(F.filter("_gaps", lambda g: F.col("_at") > g))).otherwise(0))
    full = F.lit(True)
    for c in range(3):
        full &= (F.size("_gaps") < c) | (F.count(F.when(plain & (F.col("_c") == c), 1)).over(page) >= 2)
    rows = rows.withColumn("_full", full)
    return rows.withColumn("column", F.when(F.col("_full"), F.col("_c")).otherwise(0)).drop("_a", "_z", "_plain", "_mask", "used", "low", "high", "many", "_gaps", "_at", "_c", "_full")


def _laid_out(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = map(F.lit, box)
    page = W.partitionBy("doc", "page")
    b, none = F.col("baseline"), F.lit(None)
    bare = F.lit(False)
    for c in ("x0", "x1", "y0", "y1", "baseline"):
        bare |= F.col(c).isNull()
    height = F.least(F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0)), y1 - y0)
    rows = rows.withColumn("bare", bare).withColumn("_bin", F.when(~F.col("bare"), F.least(F.lit(BINS - 1), F.floor(height * BINS / (y1 - y0)).cast("int"))))
    rows = rows.withColumn("nth", F.row_number().over(page.orderBy(F.asc_nulls_last("_bin")))).withColumn("_n", F.count("_bin").over(page))
    middle = F.when(F.col("nth") == F.expr("(_n + 1) div 2"), F.greatest(F.lit(1.0), (F.col("_bin") + 1) * (y1 - y0) / BINS))
    rows = rows.withColumn("m", F.coalesce(F.max(middle).over(page), F.lit(1.0))).withColumn("tol", F.greatest(F.lit(1.0), F.col("m") / 3)).drop("_bin", "_n")
    rows = _cells(rows, page)
    rows = rows.withColumn("heading", ~F.col("cell") & ~F.col("bare") & F.coalesce((F.col("x1") - F.col("x0")) * 100 >= 55 * (x1 - x0), F.lit(False)))
    mark = F.col("heading").cast("int")
    above = F.sum(mark).over(page.orderBy(F.desc("baseline"))) - F.sum(mark).over(W.partitionBy("doc", "page", "baseline"))
    rows = rows.withColumn("_above", F.least(F.lit(255), above).cast("int"))
    rows = rows.withColumn("_top", F.max(F.when(F.col("cell"), b)).over(page)).withColumn("_low", F.min(F.when(F.col("cell"), b)).over(page))
    phase = F.when(F.col("cell"), 1).when(b > F.col("_top"), 0).when(b < F.col("_low"), 2).otherwise(1)
    rows = rows.withColumn("section", F.when(F.col("_top").isNull(), F.col("_above")).otherwise(F.least(F.lit(255), F.col("_above") * 3 + phase))).drop("_above", "_top", "_low")
    rows = _columns(rows, page, x0, x1)
    # where a section holds a table, its rows go by baseline across all columns
    rows = rows.withColumn("_across", F.max("cell").over(W.partitionBy("doc", "page", "section")))
    order = [F.col("bare"), F.when(~F.col("bare"), F.col("section")), F.when(F.col("_across") | F.col("bare"), 0).otherwise(F.col("column")), F.when(~F.col("bare"), -b), F.when(~F.col("bare"), F.col("x0")), F.when(~F.col("bare"), F.col("source_order"))]
    line = page.orderBy(*order, "run", "text")
    rows = rows.withColumn("position", (F.row_number().over(line) - 1).cast("bigint"))
    for c in ("section", "column", "baseline", "x0", "text"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(line))
    first, gap = (F.col("position") == 0) | F.col("bare"), F.abs(F.col("_baseline") - b)
    parted = first | (F.col("section") != F.col("_section"))
    new_line = parted | (F.col("column") != F.col("_column")) | (gap > F.col("tol"))
    ends = F.regexp_replace("_text", rf"{WHITE}\z", "").rlike(r"[.!?:]\z")
    goes_on = F.regexp_replace("text", rf"\A{WHITE}", "").rlike(r"\A[a-z]")
    apart = (gap > 2 * F.col("m")) | (F.abs(F.col("_x0") - F.col("x0")) > 2 * F.col("m")) | F.col("cell") | ((gap * 2 > 3 * F.col("m")) & ends & ~goes_on)
    placed = lambda c: F.when(F.col("bare"), none).otherwise(F.col(c)).cast("bigint").alias(c)
    return rows.select("doc", "page", "run", "text", placed("section"), placed("column"), "position", new_line.alias("new_line"), (parted | F.col("heading") | (new_line & apart)).alias("new_block"), "heading", "cell", F.lit(False).alias("fallback"))


#: Runs of a page that are numbered together where a page keeps their order.
CHUNK = 4096


def _as_they_come(rows: DataFrame) -> DataFrame:
    """Rows of pages that keep the order of their runs: places from the sizes of the chunks before."""
    rows = rows.withColumn("_chunk", F.expr(f"coalesce(run div {CHUNK}, -1)"))
    sizes = rows.groupBy("doc", "page", "_chunk").agg(F.count("*").alias("_s"))
    before = F.sum("_s").over(W.partitionBy("doc", "page").orderBy("_chunk")) - F.col("_s")
    sizes = sizes.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.col("_chunk").alias("_c"), before.alias("_before"))
    rows = rows.join(sizes, _same("doc", "_doc") & _same("page", "_page") & (F.col("_chunk") == F.col("_c")))
    place = F.row_number().over(W.partitionBy("doc", "page", "_chunk").orderBy("run", "source_order", "text"))
    zero, yes, no = F.lit(0).cast("bigint"), F.lit(True), F.lit(False)
    return rows.select("doc", "page", "run", "text", zero.alias("section"), zero.alias("column"), (F.col("_before") + place - 1).alias("position"), yes.alias("new_line"), yes.alias("new_block"), no.alias("heading"), no.alias("cell"), yes.alias("fallback"))


def reading_order(runs: DataFrame, box: tuple[float, float, float, float], most: int = 256) -> DataFrame:
    """doc, page, run, text, section, column, position (from 0), new_line, new_block, heading, cell, fallback of runs in reading order.

    Rotated runs and running heads are left out. Short runs far apart on a line are table cells if a line within two median heights
    has one that starts within a height of it. Wide runs are headings and part the page, as a table does from what is above and
    below it; empty strips of its width part it into three columns at most. Rows go by section, column, baseline, x and
    source order; in a section that holds a table, columns don't count.
    """
    rows = runs.select("doc", "page", "run", F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y0", "y1", "baseline", "dx", "dy")], "source_order")
    hot = heavy_keys(rows, ["doc", "page"], least=most + 1)
    rows = _without_heads(rows, box)
    rows = rows.join(F.broadcast(hot.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.lit(True).alias("_hot"))), _same("doc", "_doc") & _same("page", "_page"), "left").drop("_doc", "_page")
    usual = rows.where("_hot is null").withColumn("_all", F.count("*").over(W.partitionBy("doc", "page")))
    every = usual.unionByName(rows.where("_hot").withColumn("_all", F.lit(most + 1).cast("bigint"))).where("not gone").drop("_hot", "gone")
    every = Stored(every, "runs").df  # read twice, and a plan of this length is planned in parts
    laid = _laid_out(every.where(F.col("_all") <= most).drop("_all"), box)
    return laid.unionByName(_as_they_come(every.where(F.col("_all") > most).drop("_all")))


# Beginnings of texts that describe a file, white space of normal forms, verdicts in their order.
METADATA = ("producer:", "creator:", "creationdate:", "moddate:", "metadata:", "xmp:", "pdfaid:")
SPACES = r"[\x{9}\x{A}\x{C}\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
VERDICTS = ("not_hidden", "empty", "unmappable", "metadata_like", "zero_area", "zero_transform", "off_page", "no_image_overlap", "duplicate_visible", "duplicate_hidden", "qualified")


def _normal(c: Column) -> Column:
    return ascii_lower(F.trim(F.regexp_replace(c, SPACES, " ")))


def _common(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def _gridded(rows: DataFrame, box: tuple[float, float, float, float], side: float) -> DataFrame:
    """Adds cx, cy: a row for each cell of the page that a box lies in; all beyond the page is one cell further."""
    def span(a: str, z: str, low: float, high: float) -> Column:
        cell = lambda c: F.floor((F.greatest(F.lit(low - side), F.least(F.lit(high + side), F.col(c))) - low) / side).cast("int")
        return F.sequence(cell(a), cell(z))

    return rows.withColumn("cx", F.explode(span("x0", "x1", box[0], box[2]))).withColumn("cy", F.explode(span("y0", "y1", box[1], box[3])))


#: SQL: of boxes in the order of runs, those that no earlier kept one repeats.
_KEPT = """aggregate(boxes, cast(array() as array<struct<run:bigint,x0:double,y0:double,x1:double,y1:double>>), (a, b) -> if(exists(a, k ->
  2 * greatest(0d, least(k.x1, b.x1) - greatest(k.x0, b.x0)) >= least(k.x1 - k.x0, b.x1 - b.x0) and
  abs(k.y0 + k.y1 - b.y0 - b.y1) <= 2 * greatest({sixth}, 8 * greatest(k.y1 - k.y0, b.y1 - b.y0))), a, concat(a, array(b))))"""


def hidden_verdicts(runs: DataFrame, images: DataFrame, box: tuple[float, float, float, float], side: float = 64.0) -> DataFrame:
    """doc, page, run, verdict of runs (doc, page, run, text, x0, x1, y0, y1, dx, dy, hidden), given images (doc, page, x0, x1, y0, y1).

    The first of ``VERDICTS`` that fits. A hidden run has to lie on the page by half, on some image by a quarter, and not repeat a visible
    run or an earlier qualified one: the same normal form, half of the narrower width shared, and middles no farther than the
    greater of a sixth of the page and eight heights. Boxes meet in cells of ``side``; equal boxes of a text count as the
    first of them. A null text is empty, a null box has no area, and null hidden is visible; images without a box cover nothing.
    """
    x0, y0, x1, y1 = box
    numbers = ("x0", "y0", "x1", "y1")
    rows = runs.select("doc", "page", F.col("run").cast("bigint").alias("run"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in (*numbers, "dx", "dy")], F.coalesce(F.col("hidden"), F.lit(False)).alias("hidden"))
    own = tuple(F.col(c) for c in numbers)
    size = (own[2] - own[0]) * (own[3] - own[1])
    solid = F.coalesce((own[2] > own[0]) & (own[3] > own[1]), F.lit(False))
    ascii_head = F.substring(F.regexp_replace(_normal(F.col("text")), r"[^\x00-\x7F]", ""), 1, 32)
    described = F.lit(False)
    for m in METADATA:
        described |= ascii_head.startswith(m)
    early = (
        F.when(~F.col("hidden"), "not_hidden").when(F.col("text") == "", "empty").when(~has_lookup_character(F.col("text")), "unmappable").when(described, "metadata_like").when(~solid, "zero_area")
        .when((F.coalesce(F.col("dx"), F.lit(0.0)) == 0) & (F.coalesce(F.col("dy"), F.lit(0.0)) == 0), "zero_transform").when(2 * _common(own, tuple(map(F.lit, box))) < size, "off_page")
    )
    rows = rows.withColumn("early", early)
    on = ["doc", "page"]
    match = _same("doc", "_doc") & _same("page", "_page")
    live = rows.where("early is null").select(*on, "run", *numbers, F.md5(_normal(F.col("text")).cast("binary")).alias("line"))
    boxes = live.select(*on, *numbers).distinct()
    pictures = images.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), *[F.col(c).cast("double").alias(c) for c in numbers]).where("x1 > x0 and y1 > y0").distinct()
    theirs = _gridded(pictures, box, side).select("_doc", "_page", "cx", "cy", *[F.col(c).alias(f"_{c}") for c in numbers])
    there = tuple(F.col(f"_{c}") for c in numbers)
    mine = _gridded(boxes, box, side)
    cells = match & (mine["cx"] == theirs["cx"]) & (mine["cy"] == theirs["cy"])
    covered = mine.join(theirs, cells & (4 * _common(own, there) >= size), "left_semi").select(*on, *numbers).distinct()

    def marked(left: DataFrame, right: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Adds whether a row of the right has the row's keys, nulls alike."""
        same = F.lit(True)
        for k in keys:
            same &= _same(k, f"_k_{k}")
        return left.join(right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias(name)), same, "left").drop(*[f"_k_{k}" for k in keys])

    key = [*on, "line", *numbers]
    live = marked(live, covered, "on_image", [*on, *numbers])
    pictured = live.where("on_image")
    shown = rows.where(~F.col("hidden") & (F.col("text") != "") & solid).select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), F.md5(_normal(F.col("text")).cast("binary")).alias("_line"), *[F.col(c).alias(f"_{c}") for c in numbers]).distinct()
    wide = pictured.select(*key).distinct()
    strips = lambda df, a, z: df.withColumn("cx", F.explode(F.sequence(*[F.floor((F.greatest(F.lit(x0 - side), F.least(F.lit(x1 + side), F.col(c))) - x0) / side).cast("int") for c in (a, z)])))
    left, right = strips(wide, "x0", "x1"), strips(shown, "_x0", "_x1")
    near = (2 * F.greatest(F.lit(0.0), F.least(own[2], there[2]) - F.greatest(own[0], there[0])) >= F.least(own[2] - own[0], there[2] - there[0])) & (
        F.abs(own[1] + own[3] - there[1] - there[3]) <= 2 * F.greatest(F.lit((y1 - y0) / 6), 8 * F.greatest(own[3] - own[1], there[3] - there[1]))
    )
    doubled = left.join(right, match & (F.col("line") == F.col("_line")) & (left["cx"] == right["cx"]) & near, "left_semi").select(*key).distinct()
    live = marked(pictured, doubled, "doubled", key).unionByName(live.where("on_image is null").withColumn("doubled", F.lit(None).cast("boolean")))
    alone = live.where("on_image and doubled is null").groupBy(*key).agg(F.min("run").alias("run"))
    firsts = alone.groupBy(*on, "line").agg(F.array_sort(F.collect_list(F.struct("run", *numbers))).alias("boxes"))
    kept = firsts.select(*on, "line", F.inline(F.expr(_KEPT.format(sixth=f"{(y1 - y0) / 6!r}d")))).select(*on, "line", "run", *numbers)
    live = marked(live, kept, "kept", [*key, "run"])
    late = F.when(F.col("on_image").isNull(), "no_image_overlap").when(F.col("doubled"), "duplicate_visible").when(F.col("kept"), "qualified").otherwise("duplicate_hidden")
    return rows.where("early is not null").select(*on, "run", F.col("early").alias("verdict")).unionByName(live.select(*on, "run", late.alias("verdict")))
