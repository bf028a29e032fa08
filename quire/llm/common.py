"""Helpers shared by the operators: shared storage, native building blocks, table reading."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import Bucketed, Stored, release, shared_dir

__all__ = ["Bucketed", "Stored", "release", "shared_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it under ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def sql_text(s: str) -> str:
    """A SQL string literal; raw, so regular expressions need no doubled backslashes."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements in a block of a two-level running sum.
BLOCK = 128


def running_sum(arr: str) -> str:
    """SQL: the inclusive running sums of an array of ints."""
    return _running(arr, "0L", "rs_s + rs_v")


def running_max(arr: str) -> str:
    """SQL: the inclusive running maxima of an array of bigints that are not below 0."""
    return _running(arr, "0L", "greatest(rs_s, rs_v)")


def _running(arr: str, zero: str, add: str) -> str:
    """SQL: running folds of an array.

    Two levels (within blocks, then over blocks), so a text with 100,000 matches costs 100,000 * BLOCK additions
    and not their square, and no array is copied per element.
    """
    fold = lambda of, start=zero: f"aggregate({of}, {start}, (rs_s, rs_v) -> {add})"
    short = f"transform(rs_a, (rs_x, rs_i) -> {fold('slice(rs_a, 1, rs_i + 1)')})"
    blocks = f"transform(sequence(0, cast((size(rs_a) - 1) div {BLOCK} as int)), rs_b -> slice(rs_a, rs_b * {BLOCK} + 1, {BLOCK}))"
    whole = f"transform(rs_k, rs_w -> {fold('rs_w')})"
    before = f"transform(rs_t, (rs_x, rs_i) -> {fold('slice(rs_t, 1, rs_i)')})"
    inner = f"transform(rs_w, (rs_y, rs_j) -> {fold('slice(rs_w, 1, rs_j + 1)', 'element_at(rs_f, rs_q + 1)')})"
    long = let(blocks, "rs_k", let(whole, "rs_t", let(before, "rs_f", f"flatten(transform(rs_k, (rs_w, rs_q) -> {inner}))")))
    return let(arr, "rs_a", f"if(size(rs_a) <= {BLOCK}, {short}, {long})")


#: Code points of text before and after a match that are kept as its context.
CONTEXT = 40


def _laid(text: str, rx: str) -> str:
    """SQL: struct<g array<string>, m array<string>>: the pieces between matches, and the matches."""
    return f"named_struct('g', split({text}, {rx}, -1), 'm', regexp_extract_all({text}, {rx}, 0))"


def matches(text: str, pattern: str) -> str:
    """SQL: array<struct<start, end, m, pre, post>> of the leftmost non-overlapping matches of a pattern that matches no empty text.

    Starts and ends are code points, the end exclusive; ``pre`` and ``post`` are the texts just before and
    after, up to the next match at most. The pieces between matches and the matches themselves, laid in turn, give every position in linear time.
    """
    rx = sql_text(pattern)
    steps = "transform(mt_s.m, (mt_x, mt_i) -> cast(length(element_at(mt_s.g, mt_i + 1)) + length(mt_x) as bigint))"
    one = f"named_struct('start', mt_e - length(element_at(mt_s.m, mt_i + 1)), 'end', mt_e, 'm', element_at(mt_s.m, mt_i + 1), 'pre', right(element_at(mt_s.g, mt_i + 1), {CONTEXT}), 'post', left(element_at(mt_s.g, mt_i + 2), {CONTEXT}))"
    found = let(_laid(text, rx), "mt_s", f"transform({running_sum(steps)}, (mt_e, mt_i) -> {one})")
    return f"if({text} rlike {rx}, {found}, cast(array() as array<struct<start:bigint,end:bigint,m:string,pre:string,post:string>>))"


def without(text: str, spans: str) -> str:
    """SQL: the text with spans (array<struct<start, end, by>>) replaced by their ``by``; of spans that overlap, by the first's.

    Linear in the text: it is cut into code points once, and the pieces between spans are joined.
    """
    new = "(rd_i = 0 or rd_x.start >= element_at(rd_m, greatest(rd_i, 1)))"
    first = f"filter(rd_s, (rd_x, rd_i) -> {new})"
    ends = "filter(rd_m, (rd_e, rd_i) -> rd_i = size(rd_s) - 1 or element_at(rd_s, least(rd_i + 2, size(rd_s))).start >= rd_e)"
    since = "if(rd_j = 0, 0L, element_at(rd_l, greatest(rd_j, 1)))"
    piece = let(since, "rd_p", "concat(array_join(slice(rd_c, cast(rd_p + 1 as int), cast(rd_x.start - rd_p as int)), ''), rd_x.by)")
    tail = "array_join(slice(rd_c, cast(element_at(rd_l, -1) + 1 as int), greatest(0, cast(size(rd_c) - element_at(rd_l, -1) as int))), '')"
    body = f"concat(array_join(transform(rd_f, (rd_x, rd_j) -> {piece}), ''), {tail})"
    laid = let("split(rd_t, '')", "rd_c", let(running_max("transform(rd_s, rd_x -> rd_x.end)"), "rd_m", let(first, "rd_f", let(ends, "rd_l", body))))
    return let(text, "rd_t", let(f"array_sort({spans})", "rd_s", f"if(size(rd_s) = 0, rd_t, {laid})"))


#: The most bits of a membership bitmap: 64 MB.
BITS = 1 << 29


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys: 16 a key and a power of two, ``BITS`` at most."""
    return min(BITS, 1 << max(16, (16 * keys - 1).bit_length()))


def _words(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(_word, _bits): the bitmap of ``key`` modulo ``bits``, in rows of 4 KB."""
    return keys.select(F.pmod(key, F.lit(bits)).alias("h")).selectExpr("h div 32768 as _word", "h % 32768 as b").groupBy("_word").agg(F.expr("bitmap_construct_agg(b)").alias("_bits"))


class Bitmap:
    """Which 64-bit keys a table may hold, as a value that tasks share: false only where it holds none.

    64 MB at most however many keys there are. Beyond 2**25 keys more rows pass than are meant, never fewer, so what
    passes is still counted or joined; its use is only to save rows.
    """

    def __init__(self, keys: DataFrame, key: str):
        self.bits = bits_for(keys.count())
        self.at = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in _words(keys, F.col(key), self.bits).toLocalIterator():
            part = np.frombuffer(r["_bits"], dtype=np.uint8)
            self.at[r["_word"] * 4096 : (r["_word"] + 1) * 4096] = part[: len(self.at) - r["_word"] * 4096]

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each of the uint64 keys may be there."""
        h = keys & np.uint64(self.bits - 1)
        return (self.at[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


def likely(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Adds _likely: false only where no row of ``wanted`` has the key. Nothing of ``df`` is shuffled.

    A bitmap of key hashes, 16 bits a key and 64 MB at most, is sent to all tasks; beyond 2**25 keys more rows are likely
    than are wanted, and a join has to follow in any case.
    """
    bits = bits_for(wanted.count())
    words = _words(wanted, F.xxhash64(wanted_key), bits)
    out = df.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_word", F.expr("_h div 32768")).join(F.broadcast(words), "_word", "left")
    byte = "cast(conv(hex(substring(_bits, cast(_h % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return out.withColumn("_likely", F.expr(f"coalesce((shiftright({byte}, cast(_h % 8 as int)) & 1) = 1, false)")).drop("_h", "_word", "_bits")


#: A key is heavy that holds this share of all rows, one in so many.
HEAVY = 1000


def lookup(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner join with a stored table of one row a key, of which ``count`` tells how many left rows (or more) have the key.

    Keys that hold a thousandth or more of all rows, of which there are a thousand at most, are sent to all tasks; so the
    shuffle that joins the others deals no key with more than that share.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * HEAVY >= F.lit(total)
    hot = right.where(heavy)
    marked = left.join(F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True))), on, "left")
    few = marked.where("_hot").drop("_hot").join(F.broadcast(hot.drop(count)), on)
    return few.unionByName(marked.where("_hot is null").drop("_hot").join(right.where(~heavy).drop(count), on))
