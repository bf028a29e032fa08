"""Reading order and hidden text against plain loops over pages."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import keys, pages

BOX = (0.0, 0.0, 600.0, 800.0)
SHAPE = "doc bigint, page bigint, run bigint, text string, x0 double, x1 double, y0 double, y1 double, baseline double, dx double, dy double, source_order bigint"
NAMES = [c.split()[0] for c in SHAPE.split(", ")]


def bin_of(x):
    return 0 if x <= 0 else 63 if x >= 600 else min(63, int(x * 64 // 600))


def ordered(runs):
    """(run, section, column, position, new_line, new_block, heading, cell, fallback) of one document's runs (dicts), page by page."""
    flat = lambda t: " ".join(w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).replace("\n", " ").replace("\t", " ").split(" ") if w)

    def band(r):
        if None in (r["x0"], r["x1"], r["y0"], r["y1"]) or r["x1"] <= r["x0"] or r["y1"] <= r["y0"] or not flat(r["text"] or ""):
            return None
        middle = (r["y0"] + r["y1"]) / 2
        return "top" if middle >= 720 else "bottom" if middle <= 80 else None

    seen = {}
    for r in runs:
        if band(r):
            seen.setdefault((band(r), flat(r["text"])), set()).add(r["page"])
    out = []
    for page in {r["page"] for r in runs}:
        here = [r for r in runs if r["page"] == page]
        dx, dy = (lambda r: r["dx"] or 0), (lambda r: r["dy"] or 0)
        turned = lambda r: r["dx"] is not None and r["dy"] is not None and dy(r) != 0 and (dx(r) == 0 or 2 * abs(dy(r)) > abs(dx(r)))
        flow = [r for r in here if not turned(r) and not (band(r) and len(seen[band(r), flat(r["text"])]) >= 3)]
        if len(here) > 256:
            out += [(r["run"], 0, 0, i, True, True, False, False, True) for i, r in enumerate(sorted(flow, key=lambda r: (r["run"], r["source_order"])))]
            continue
        bare = [r for r in flow if None in (r["x0"], r["x1"], r["y0"], r["y1"], r["baseline"])]
        rs = [r for r in flow if r not in bare]
        if rs:
            heights = sorted(min(63, int(min(max(r["y1"] - r["y0"], 0), 800) * 64 // 800)) for r in rs)
            m = max(1, (heights[(len(rs) + 1) // 2 - 1] + 1) * 800 / 64)
            tol = max(1, m / 3)
        text = lambda r: r["text"] or ""
        near = lambda a, b: abs(a["baseline"] - b["baseline"]) <= tol
        short = [r for r in rs if len(text(r).encode()) <= 8]
        far = [a for a in short if any(near(a, b) and abs(a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2 >= 4 * m for b in short)]
        met = [a for a in far if any(not near(a, b) and abs(a["baseline"] - b["baseline"]) <= 2 * m and abs(a["x0"] - b["x0"]) <= m for b in far)]
        cell = {id(a) for a in far if any(near(a, b) for b in met)}
        heading = {id(r) for r in rs if id(r) not in cell and (r["x1"] - r["x0"]) * 100 >= 55 * 600}
        lines = [r["baseline"] for r in rs if id(r) in cell]
        section = {}
        for r in rs:
            n = sum(id(h) in heading and h["baseline"] > r["baseline"] for h in rs)
            if lines:
                n = 3 * n + (1 if id(r) in cell else 0 if r["baseline"] > max(lines) else 2 if r["baseline"] < min(lines) else 1)
            section[id(r)] = min(255, n)
        plain = [r for r in rs if id(r) not in cell and id(r) not in heading]
        used = {b for r in plain for b in range(bin_of(r["x0"]), bin_of(r["x1"]) + 1)}
        gaps = []
        if len(plain) >= 4 and used:
            at = min(used) + 1
            while at < max(used):
                if at in used:
                    at += 1
                    continue
                start = at
                while at not in used:
                    at += 1
                if at - start < 3:
                    continue
                if len(gaps) < 2:
                    gaps.append((start, at - start))
                else:
                    k = 0 if gaps[0][1] <= gaps[1][1] else 1
                    if at - start > gaps[k][1]:
                        gaps[k] = (start, at - start)
        centres = sorted(s + w // 2 for s, w in gaps)
        column = {id(r): sum(bin_of((r["x0"] + r["x1"]) / 2) > c for c in centres) for r in plain}
        if any(sum(v == c for v in column.values()) < 2 for c in range(len(centres) + 1)):
            column = {}
        column = {id(r): column.get(id(r), 0) for r in rs}
        tabled = {section[id(r)] for r in rs if id(r) in cell}
        rs.sort(key=lambda r: (section[id(r)], 0 if section[id(r)] in tabled else column[id(r)], -r["baseline"], r["x0"], r["source_order"], r["run"]))
        for i, r in enumerate(rs):
            p = rs[i - 1] if i else None
            parted = p is None or section[id(p)] != section[id(r)]
            line = parted or column[id(p)] != column[id(r)] or not near(p, r)
            block = parted or id(r) in heading
            if line and not block:
                gap = abs(p["baseline"] - r["baseline"])
                block = gap > 2 * m or abs(p["x0"] - r["x0"]) > 2 * m or id(r) in cell
                block = block or (2 * gap > 3 * m and text(p).rstrip(" \t\n\f\r")[-1:] in tuple(".!?:") and not ("a" <= text(r).lstrip(" \t\n\f\r")[:1] <= "z"))
            out.append((r["run"], section[id(r)], column[id(r)], i, line, block, id(r) in heading, id(r) in cell, False))
        out += [(r["run"], None, None, len(rs) + i, True, True, False, False, False) for i, r in enumerate(sorted(bare, key=lambda r: r["run"]))]
    return sorted(out, key=str)


def page_of(rnd, page, n):
    rows = []
    for run in range(n):
        kind = rnd.random()
        x0, w, y, h, text = rnd.choice([20, 30, 230, 330, 430]) + rnd.choice([0, 0, 3]), rnd.choice([20, 80, 150]), rnd.randint(100, 700), rnd.choice([8, 10, 14]), rnd.choice(["Words here.", "and on ", "Ends: ", "é" * 5, ""])
        if kind < 0.3:
            x0, w, y, text = rnd.choice([60, 200, 340]) + rnd.randint(0, 3), 30, 400 - 14 * rnd.randint(0, 5) + rnd.randint(0, 1), str(rnd.randint(0, 99))
        elif kind < 0.36:
            x0, w = 20, 400
        elif kind < 0.46:
            y, text = rnd.choice([5, 760]), rnd.choice(["A  Head", "a head", f"page {page}"])
        dx, dy = rnd.choice([(50, 0)] * 8 + [(0, 5), (None, None)])
        row = [1, page, run, rnd.choice([text] * 9 + [None]), x0, x0 + w, y, y + h, y, dx, dy, rnd.randint(0, 3)]
        if rnd.random() < 0.03:
            row[rnd.choice([4, 6, 8])] = None
        rows.append(tuple(float(v) if 4 <= i <= 10 and v is not None else v for i, v in enumerate(row)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_reading_order_equals_plain_loops(spark, seed):
    rnd = random.Random(seed)
    rows = [r for page in range(12) for r in page_of(rnd, page, rnd.choice([1, 3, 12, 40, 60]))] + [r for r in page_of(rnd, 77, 300)]
    got = pages.reading_order(spark.createDataFrame(rows, SHAPE).repartition(5), BOX).collect()
    want = ordered([dict(zip(NAMES, r, strict=True)) for r in rows])
    keep = ("run", "section", "column", "position", "new_line", "new_block", "heading", "cell", "fallback")
    assert sorted((tuple(r[k] for k in keep) for r in got), key=str) == want
    assert any(r["cell"] for r in got) and any(r["column"] for r in got) and any(r["fallback"] for r in got)


def test_columns_under_a_heading(spark):
    spots = [("Right one", 330.0, 200.0, 680.0), ("Left one", 20.0, 200.0, 680.0), ("A wide heading", 20.0, 560.0, 700.0), ("Right two", 330.0, 200.0, 668.0), ("Left two", 20.0, 200.0, 668.0)]
    rows = [(1, 1, i, t, x, x + w, y, y + 10, y, 1.0, 0.0, i) for i, (t, x, w, y) in enumerate(spots)]
    got = pages.reading_order(spark.createDataFrame(rows, SHAPE), BOX).orderBy("position").collect()
    assert [r["text"] for r in got] == ["A wide heading", "Left one", "Left two", "Right one", "Right two"]


def test_a_page_with_most_rows_is_numbered_in_chunks(spark):
    runs = spark.range(20_000).select(F.lit(1).alias("doc"), F.lit(2).alias("page"), F.col("id").alias("run"), F.lit("t").alias("text"), *[F.lit(x).alias(n) for n, x in zip(("x0", "x1", "y0", "y1", "baseline", "dx", "dy"), (0.0, 9.0, 300.0, 310.0, 300.0, 9.0, 0.0), strict=True)], F.col("id").alias("source_order"))
    got = pages.reading_order(runs, BOX)
    assert got.where("position = run and fallback").count() == 20_000
    empty = pages.reading_order(runs.limit(0), BOX)
    assert empty.count() == 0
    assert [tuple(r) for r in keys.heavy_keys(runs, ["doc"]).collect()] == [(1, 20_000)]


HIDDEN = "doc bigint, page bigint, run bigint, text string, x0 double, x1 double, y0 double, y1 double, dx double, dy double, hidden boolean"
PICTURE = "doc bigint, page bigint, x0 double, x1 double, y0 double, y1 double"


def verdicts(runs, images):
    """Verdicts of one page's runs, in the order of runs."""
    shared = lambda a, b: max(0, min(a[1], b[1]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[2], b[2]))
    white = "\t\n\f\r \xa0　"
    flat = lambda t: " ".join("".join(" " if c in white else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split())
    out, kept = {}, []
    for run, text, box, dx, dy, hidden in runs:
        text, none = text or "", None in box
        solid = not none and box[1] > box[0] and box[3] > box[2]
        area = (box[1] - box[0]) * (box[3] - box[2]) if solid else 0

        def doubles(other, t, box=box, text=text):
            if flat(t or "") != flat(text) or None in other or other[1] <= other[0] or other[3] <= other[2]:
                return False
            wide = max(0, min(box[1], other[1]) - max(box[0], other[0])) * 2 >= min(box[1] - box[0], other[1] - other[0])
            return wide and abs(box[2] + box[3] - other[2] - other[3]) <= 2 * max(800 / 6, 8 * max(box[3] - box[2], other[3] - other[2]))

        v = "qualified"
        if not hidden:
            v = "not_hidden"
        elif not text:
            v = "empty"
        elif not any(c.isalnum() for c in text):
            v = "unmappable"
        elif "".join(c for c in flat(text) if c.isascii())[:32].startswith(pages.METADATA):
            v = "metadata_like"
        elif not solid:
            v = "zero_area"
        elif not dx and not dy:
            v = "zero_transform"
        elif 2 * shared(box, (0, 600, 0, 800)) < area:
            v = "off_page"
        elif not any(4 * shared(box, i) >= area for i in images if None not in i and i[1] > i[0] and i[3] > i[2]):
            v = "no_image_overlap"
        elif any(doubles(b, t) for _, t, b, _, _, h in runs if not h and t):
            v = "duplicate_visible"
        elif any(doubles(b, t) for t, b in kept):
            v = "duplicate_hidden"
        else:
            kept.append((text, box))
        out[run] = v
    return out


def test_hidden_text_equals_plain_loops(spark):
    rnd, runs, images, want = random.Random(6), [], [], {}
    for page in (1, 2, None):
        here = []
        for run in range(200):
            x, y, w, h = rnd.choice([-60, 10, 40, 200, 240, 560]) + rnd.randint(0, 9), rnd.randint(-10, 790), rnd.choice([0, 20, 40, 90]), rnd.choice([8, 12])
            box = tuple(map(float, (x, x + w, y, y + h)))
            if rnd.random() < 0.05:
                box = (None, *box[1:])
            text = rnd.choice(["a", "A ", "b c", "b　C", "--", "", None, " Creator: x", "éProducer: y", "中", "xmp:1"])
            here.append((run, text, box, rnd.choice([0.0, 9.0, 9.0, None]), 0.0, rnd.random() < (0.7 if page else 0.99)))
        pictures = [tuple(map(float, (x, x + rnd.randint(0, 300), y, y + rnd.randint(0, 300)))) for x, y in ((rnd.randint(-50, 500), rnd.randint(-50, 600)) for _ in range(5))] + [(None, 1.0, 1.0, 2.0)]
        runs += [(1, page, r, t, *b, dx, dy, h) for r, t, b, dx, dy, h in here]
        images += [(1, page, *i) for i in pictures]
        want |= {(page, k): v for k, v in verdicts(here, pictures).items()}
    df, pics = spark.createDataFrame(runs, HIDDEN).repartition(4), spark.createDataFrame(images, PICTURE)
    got = {(r["page"], r["run"]): r["verdict"] for r in pages.hidden_verdicts(df, pics, BOX).collect()}
    assert got == want and set(want.values()) == set(pages.VERDICTS)
    assert pages.hidden_verdicts(df.limit(0), pics, BOX).count() == 0


def test_hidden_text_of_a_page(spark):
    rows = [(1, 1, 0, "Hello  World", 10.0, 100.0, 10.0, 20.0, 9.0, 0.0, False), (1, 1, 1, "hello world", 12.0, 98.0, 11.0, 21.0, 9.0, 0.0, True), (1, 1, 2, "other", 10.0, 60.0, 40.0, 50.0, 9.0, 0.0, True), (1, 1, 3, "other", 10.0, 60.0, 41.0, 51.0, 9.0, 0.0, True), (1, 1, 4, "", 0.0, 1.0, 0.0, 1.0, 9.0, 0.0, True), (1, 1, 5, "x", -50.0, 10.0, 0.0, 1.0, 9.0, 0.0, True)]
    image = spark.createDataFrame([(1, 1, 0.0, 600.0, 0.0, 800.0)], PICTURE)
    got = {r["run"]: r["verdict"] for r in pages.hidden_verdicts(spark.createDataFrame(rows, HIDDEN), image, BOX).collect()}
    assert got == {0: "not_hidden", 1: "duplicate_visible", 2: "qualified", 3: "duplicate_hidden", 4: "empty", 5: "off_page"}
