"""Clips of saved words, positions as paths, precedence of metadata, validity of saved ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(words: Column) -> Column:
    """Text of array<struct<text, hyphen, attached, paragraph>>, in order.

    ``hyphen``: layout put a hyphen at the word's end, which goes; a real one at the end joins the next word unless that
    begins with a blank or punctuation; a paragraph begins a line; attached words touch; else one blank. Null words are left out.
    """
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("first"), F.lit(False).alias("hyphen"))

    def step(a: Column, w: Column) -> Column:
        cut = F.when(a["hyphen"], F.regexp_replace(a["t"], "-$", "")).otherwise(a["t"])
        real = ~a["hyphen"] & a["t"].endswith("-") & ~w["text"].rlike(r"^[\s\p{Punct}]")
        gap = F.when(a["first"] | a["hyphen"] | real, "").when(w["paragraph"], "\n").when(w["attached"], "").otherwise(" ")
        return F.struct(F.concat(cut, gap, w["text"]).alias("t"), F.lit(False).alias("first"), w["hyphen"].alias("hyphen"))

    return F.aggregate(F.filter(words, lambda w: w["text"].isNotNull()), start, step, lambda a: a["t"])


def position_path(section: Column, paragraph: Column, offset: Column) -> Column:
    """Such a path, null if any part of it is."""
    known = section.isNotNull() & paragraph.isNotNull() & offset.isNotNull()
    return F.when(known, F.format_string("/body/DocFragment[%d]/body/p[%d]/text().%d", section, paragraph, offset))


def parse_position(path: Column) -> Column:
    """struct<section, paragraph, offset>, null for anything else."""
    rx = r"^/body/DocFragment\[(\d+)\]/body/p\[(\d+)\]/text\(\)\.(\d+)$"
    part = lambda i: F.regexp_extract(path, rx, i).try_cast("bigint")
    return F.when(path.rlike(rx), F.struct(part(1).alias("section"), part(2).alias("paragraph"), part(3).alias("offset")))


def best_known(value: Column, rank: Column, order: Column) -> Column:
    """Aggregate: the value of the highest origin; of equal ones the first by ``order``."""
    return F.max_by(value, F.struct(rank, -order))


def valid_range(start: Column, end: Column, total: Column) -> Column:
    return F.coalesce((start >= 0) & (start <= end) & (end < total), F.lit(False))


def safe_cache_path(path: Column) -> Column:
    """Whether a relative path stays inside its folder and has only plain characters."""
    return path.rlike(r"^[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$") & ~path.rlike(r"(?:^|/)\.\.?(?:/|$)")
