"""Places in a book as paths of elements and as shares, and back.

A book's sections are pages of HTML. The index of a section is a row for each text node and element: its path (the elements
from the body down, each with its number among those of its name under one parent), the number of the node, where its
visible text begins and how long it is. Places become paths by an as-of join on where nodes begin, paths become places by
an equi join, shares by the sizes of sections. Offsets count visible code points of a section from 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.markup import PathReader
from quire.operators import joins

INDEX = "path string, node bigint, start bigint, length bigint, paragraph bigint, item bigint"


def path_index(sections: DataFrame, by: list[str], html_col: str = "html") -> DataFrame:
    """by, path, node (0 for an element), start, length, paragraph, item (p and li begun so far) of sections (by, html).

    Text nodes end at every tag. Null pages are empty; what can't be read is kept up to the fault.
    """
    shape = ", ".join(f"`{c}` {sections.schema[c].dataType.simpleString()}" for c in by)
    ints = [c for c in by if sections.schema[c].dataType.simpleString() in ("bigint", "int")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda rows: pd.DataFrame(rows, columns=[*by, *[c.split()[0] for c in INDEX.split(", ")]]).astype(dict.fromkeys(ints, "Int64"))
        for b in batches:
            rows = []
            for *key, page in zip(*[b[c] for c in (*by, "_html")], strict=True):
                rows += [(*key, *r) for r in PathReader.of(page)]
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    return sections.select(*by, F.col(html_col).alias("_html")).mapInPandas(run, f"{shape}, {INDEX}")


def sizes(index: DataFrame, book: list[str], section: str) -> DataFrame:
    """book, section, visible, before, total: visible code points of each section, of those before it and of its book."""
    each = index.where("node > 0").groupBy(*book, section).agg(F.sum("length").alias("visible"))
    by, upto = W.partitionBy(*book), W.partitionBy(*book).orderBy(section)
    return each.select(*book, section, "visible", (F.sum("visible").over(upto) - F.col("visible")).alias("before"), F.sum("visible").over(by).alias("total"))


def _share(target: Column, visible: Column) -> Column:
    """The offset that a share of a section leads to: the target-th visible code point, counted from 1."""
    return F.greatest(F.lit(1), F.least(visible, F.ceil(F.greatest(F.lit(0.0), F.least(F.lit(1.0), target)) * visible))).cast("bigint") - 1


def to_paths(places: DataFrame, index: DataFrame, book: list[str], section: str) -> DataFrame:
    """places with path and share (of the book), for places (book, section from 0, offset, item, paragraph, page, pages), nulls for what isn't known.

    The first that leads somewhere counts: the offset, the list item, the paragraph, the share of pages read. A share of nothing is
    the section's body. An offset behind the text or a section without text falls to the next; if nothing leads anywhere
    the path is null. ``share`` goes by the page of the section and the sections' visible sizes.
    """
    by = [*book, section]
    key = [F.col(c) for c in by]
    room = sizes(index, book, section)
    intra = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("page") / (F.col("pages") - 1)))).otherwise(0.0)
    rows = places.join(room, by, "left").withColumn("_intra", F.coalesce(intra, F.lit(0.0)))
    for tag, column in (("li", "item"), ("p", "paragraph")):
        found = index.where((F.col("node") == 0) & F.col("path").rlike(rf"/{tag}\[\d+\]\z")).select(*by, F.col(column), F.col("path").alias(f"_{tag}"))
        rows = rows.join(found, [*by, column], "left")
    given = F.when((F.col("offset") >= 0) & (F.col("offset") < F.col("visible")), F.col("offset"))
    named = F.coalesce("_li", "_p")
    at = F.coalesce(given, F.when(named.isNull() & (F.col("_intra") > 0), _share(F.col("_intra"), F.col("visible"))))
    nodes = index.where("node > 0 and length > 0").select(*by, "start", F.col("path").alias("_path"), F.col("node").alias("_node"), F.col("start").alias("_start"))
    rows = joins.asof(rows.withColumn("_at", at), nodes, by, "_at", "start", ["_start", "_path", "_node"])
    root = F.concat(F.lit("/body/DocFragment["), (F.col(section) + 1).cast("string"), F.lit("]/body"))
    text = F.concat(F.lit("/text()["), F.col("_node").cast("string"), F.lit("]."), (F.col("_at") - F.col("_start") + 1).cast("string"))
    body = F.when(F.col("visible").isNotNull() & named.isNull() & (F.col("_intra") == 0), root)
    path = F.coalesce(F.concat(root, "_path", text), F.concat(root, named), body)
    share = (F.col("before") + F.col("_intra") * F.col("visible")) / F.col("total")
    return rows.select(*places.columns, path.alias("path"), share.alias("share"))


def _parts(path: Column) -> dict[str, Column]:
    """Section (from 0), element path with all numbers written, node and character of a path; null for what it lacks."""
    number = lambda rx: F.nullif(F.regexp_extract(path, rx, 1), F.lit("")).try_cast("bigint")
    steps = F.regexp_extract(path, r"^/body/DocFragment\[\d+\]/body((?:/[A-Za-z][\w.-]*(?:\[\d+\])?)*)(?:/text\(\)(?:\[\d+\])?)?(?:\.\d+)?$", 1)
    return {
        "section": number(r"^/body/DocFragment\[(\d+)\]") - 1,
        "steps": F.regexp_replace(steps, r"(/[A-Za-z][\w.-]*)(?=/|$)", "$1[1]"),
        "node": F.when(path.rlike(r"/text\(\)"), F.coalesce(number(r"/text\(\)\[(\d+)\]"), F.lit(1))),
        "char": F.coalesce(number(r"\.(\d+)$"), F.lit(0)),
        "paragraph": number(r"^.*/p\[(\d+)\]"),
    }


def from_paths(asked: DataFrame, index: DataFrame, book: list[str], section: str) -> DataFrame:
    """asked with section, offset, intra and page, for (book, path, share, pages).

    The section is the path's, or where it names none of the book's the first whose end the share of the book reaches. The offset is that of the
    character in the path's text node (its last one, if the node is shorter), else where the element begins, else where the
    paragraph of that number of the section does, else null. ``intra`` is the share of the section read: by the offset, else by the
    share of the book. ``page`` is that share of ``pages``, rounded.
    """
    parts = _parts(F.col("path"))
    rows = asked.drop(section).select("*", *[c.alias(f"_{n}") for n, c in parts.items()])
    room = sizes(index, book, section)
    whole = room.select(*book, F.col("total").alias("_total")).distinct()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))))
    rows = rows.join(whole, book, "left").withColumn("_target", F.floor(F.col("_total") * share))
    named = room.select(*book, F.col(section).alias("_section"), F.struct(section, "before", "visible").alias("_named"))
    rows = rows.join(named, [*book, "_section"], "left")
    ends = room.select(*book, (F.col("before") + F.col("visible")).alias("_end"), section, "before", "visible")
    ends = ends.select(*book, "_end", F.struct(section, "before", "visible").alias("_reached"))
    rows = joins.asof(rows, ends, book, "_target", "_end", ["_reached"], forward=True, first_of_ties=True)
    rows = rows.withColumn("_in", F.coalesce("_named", "_reached")).withColumn(section, F.col(f"_in.{section}"))
    by = [*book, section]
    nodes = index.select(*by, F.col("path").alias("_steps"), F.col("node").alias("_n"), "start", "length")
    exact = F.coalesce(F.col("_node"), F.lit(0))
    found = rows.withColumn("_n", exact).join(nodes, [*by, "_steps", "_n"], "left")
    first = index.where(F.col("node") == 0).where(F.col("path").rlike(r"/p\[\d+\]\z")).select(*by, F.col("paragraph").alias("_paragraph"), F.col("start").alias("_begin"))
    found = found.join(first, [*by, "_paragraph"], "left")
    inside = F.col("start") + F.greatest(F.lit(0), F.least(F.col("_char"), F.col("length")) - 1)
    begins = F.when((F.col("_steps") == "") & F.col("path").isNotNull() & F.col("_section").isNotNull(), F.lit(0).cast("bigint"))
    offset = F.coalesce(F.when(F.col("_n") > 0, inside).otherwise(F.col("start")), "_begin", begins)
    shared = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_target") - F.col("_in.before")) / F.col("_in.visible")))
    intra = F.coalesce(F.when(offset.isNotNull(), (offset + 1) / F.col("_in.visible")), shared)
    page = F.when(F.col("pages") > 0, F.greatest(F.lit(0), F.least(F.col("pages") - 1, F.floor(F.col("intra") * (F.col("pages") - 1) + 0.5))))
    out = found.withColumn("offset", offset).withColumn("intra", intra).withColumn("page", page.cast("bigint"))
    kept = [c for c in asked.columns if c != section]
    return out.select(*kept, section, "offset", "intra", "page")


def identical(places: DataFrame, index: DataFrame, book: list[str], section: str) -> DataFrame:
    """Places (book, section, offset) with their path and the offset that it leads back to."""
    blank = reduce(lambda df, c: df.withColumn(c, F.lit(None).cast("bigint")), ("item", "paragraph", "page", "pages"), places)
    paths = to_paths(blank, index, book, section).select(*places.columns, "path", "share").withColumnRenamed("offset", "at").withColumnRenamed(section, "_was")
    back = from_paths(paths.withColumn("pages", F.lit(None).cast("bigint")), index, book, section)
    return back.select(*[c for c in places.columns if c not in ("offset", section)], F.col("_was").alias(section), "at", "path", F.col("offset").alias("back"))
