"""Passages that documents share, found by seeds that are extended both ways, and their removal.

A window is ``words`` consecutive words of one document. Of every window one run of ``seed`` words is chosen, the first of the
smallest hash (winnowing), so equal windows choose alike and about a fifth of all runs are anchors.

1. Seeds: anchors that documents of different ids share. A pass over the texts sends each distinct anchor of a task's block
   once, with the least and the greatest id that has it. The shared ones travel to the tasks as a bitmap (see ``Bitmap``;
   anchors that it lets through by mistake only cost work).
2. Extension: a shared anchor reaches left and right over all windows that chose it, its block. Blocks that are equal as a
   whole meet first, so a passage in thousands of documents becomes one row; distinct blocks of an anchor then meet by
   their windows, each the anchor with so many words left and the rest right of it. No pairs of documents are made.
3. A window whose least id is smaller than that of its document is repeated. Overlapping windows join to maximal repeats.

Blocks and windows meet in joins by keys of one row each, whose heavy keys are broadcast (``lookup``), so no passage is hot.
Words have two 64-bit hashes, sums of random values of their bytes by place; anchors are told apart by the first, windows by
the second, and equal windows have equal anchors, so 128 bits tell windows apart.
Only texts that lose words are shuffled, to meet their repeats; a bitmap of their ids tells the others.

Defined results: null and empty texts have no words; a null id owns nothing and loses nothing; rows that repeat an id are one
document in several texts, none of which takes words from another; ties of hashes go to the first; an empty table gives an
empty result; texts are read whole; other columns are not read, and whatever they are called does no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Bitmap, Stored, likely, lookup, table


@dataclass(frozen=True)
class Params:
    words: int = 13  #: of a window
    seed: int = 5  #: of an anchor, ``words`` at most
    block: int = 4_000_000  #: windows of texts whose anchors or blocks a task sends together


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _rolled(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values: of halves that are powers of two, so about log2(k) passes."""
    n, power, at, out = len(values) - k + 1, values, 0, None
    for bit in range(k.bit_length()):
        size = 1 << bit
        if k & size:
            part = power[at : at + n]
            out = _mix(part * _ODD + np.uint64(size)) if out is None else _mix(out * _ODD + part)
            at += size
        if k >> (bit + 1):
            power = _mix(power[:-size] * _ODD + power[size:])
    return out


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True
#: Places in a word that have random values of their own for each byte; a word's hash is their sum.
_PLACES = 64
_VALUES = np.random.default_rng(13).integers(0, 2**64, size=(2, _PLACES * 256), dtype=np.uint64)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each word of some bytes begins, two 64-bit hashes of each)."""
    black = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(black[1:] != black[:-1])
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return begin, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    at = (place % _PLACES) * 256 + data[black[1:-1]]
    hashes = []
    for values in _VALUES:
        each = values[at]
        far = np.flatnonzero(place >= _PLACES)
        each[far] *= (2 * (place[far] // _PLACES) + 1).astype(np.uint64)
        hashes.append(_mix(np.add.reduceat(each, first) + size.astype(np.uint64)))
    return begin, *hashes


def read(texts: list[bytes], p: Params) -> Blocks:
    """The blocks of some texts, all at once."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    begin, first, second = _words(np.frombuffer(b" ".join(texts), dtype=np.uint8))
    upto = np.searchsorted(begin, offsets)  # words before each text
    text = np.repeat(np.arange(len(texts)), np.diff(upto))  # of each word
    n = len(first) - p.words + 1
    none = np.zeros(0, dtype=np.int64)
    if n < 1:
        return Blocks(none, none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.uint64))
    runs, windows = _rolled(first, p.seed), _rolled(second, p.words)
    least, chosen = runs[:n], np.arange(n)
    for j in range(1, p.words - p.seed + 1):
        less = runs[j : j + n] < least
        least = np.where(less, runs[j : j + n], least)
        chosen = np.where(less, np.arange(j, j + n), chosen)
    inside = np.flatnonzero(np.arange(n) + p.words <= upto[1:][text[:n]])  # windows of one text
    # a run that a text's window chose lies in that text, so no block goes over its end
    start = np.flatnonzero(np.diff(chosen[inside], prepend=-1))
    many, start = np.diff(np.append(start, len(inside))), inside[start]
    block = np.zeros(len(start), dtype=np.uint64)
    for j in range(int(many.max(initial=0))):
        more = many > j
        block[more] = _mix(block[more] * _ODD + windows[start[more] + j])
    return Blocks(text[start], least[start], _mix(block + many.astype(np.uint64)), start - upto[text[start]], many, start, windows)


@dataclass
class Blocks:
    """Blocks of texts: the text's number, anchor, hash, first window (in its text), windows in it, first window (of all), hashes of all windows."""

    text: np.ndarray
    anchor: np.ndarray
    block: np.ndarray
    start: np.ndarray
    many: np.ndarray
    at: np.ndarray
    windows: np.ndarray

    def only(self, which: np.ndarray) -> Blocks:
        return Blocks(self.text[which], self.anchor[which], self.block[which], self.start[which], self.many[which], self.at[which], self.windows)

    def flat(self) -> np.ndarray:
        """The hashes of the blocks' windows, one block after the other."""
        return self.windows[np.repeat(self.at - np.cumsum(self.many) + self.many, self.many) + np.arange(self.many.sum())]


def _column(b: pa.RecordBatch, i: int) -> list:
    return b.column(i).cast(pa.binary()).to_pylist()


#: Bytes of texts that are read at once, and texts.
AT_ONCE = (1 << 18, 4096)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(the leading columns, texts) of rows whose last column is a text, about ``AT_ONCE`` at a time."""
    for b in batches:
        ids, texts = np.array([b.column(i).to_pylist() for i in range(b.num_columns - 1)], dtype=np.int64), _column(b, b.num_columns - 1)
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= AT_ONCE[0] or i + 1 - at >= AT_ONCE[1] or i + 1 == len(texts):
                yield ids[:, at : i + 1], texts[at : i + 1]
                at, size = i + 1, 0


def _wanted(docs: DataFrame) -> DataFrame:
    return docs.where("doc is not null and text is not null").select("doc", "text")


def _firsts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of equal keys together, where each distinct one begins in it)."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))


def _anchors(docs: DataFrame, p: Params) -> DataFrame:
    """(anchor): those that two ids or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            anchor, doc = (np.concatenate(c) for c in zip(*held, strict=True))
            order, at = _firsts(anchor)
            doc = doc[order]
            least, most = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (doc, doc)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[order][at].view(np.int64), least, most)], names=["anchor", "least", "most"])

        for ids, texts in _chunks(batches):
            found = read(texts, p)
            held.append((found.anchor, ids[0][found.text]))
            size += len(found.windows)
            if size >= p.block:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    rows = _wanted(docs).mapInArrow(run, "anchor bigint, least bigint, most bigint")
    return rows.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("anchor")


def _blocks(docs: DataFrame, seeds: Bitmap, p: Params) -> DataFrame:
    """(anchor, block, least, most, n, windows): distinct blocks of shared anchors, their windows, ids and how many texts have them."""
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            anchor, block, doc, many, windows = (np.concatenate(c) for c in zip(*held, strict=True))
            order, at = _firsts(block)
            doc, one = doc[order], order[at]
            least, most = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (doc, doc)
            own = Blocks(one, anchor[one], block[one], one, many[one], (np.cumsum(many) - many)[one], windows)
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(own.many)).astype(np.int32), pa.array(own.flat().view(np.int64)))
            columns = [own.anchor.view(np.int64), own.block.view(np.int64), least, most, np.diff(np.append(at, len(order)))]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=["anchor", "block", "least", "most", "n", "windows"])

        for ids, texts in _chunks(batches):
            found = read(texts, p)
            found = found.only(sent.value.has(found.anchor))
            held.append((found.anchor, found.block, ids[0][found.text], found.many, found.flat()))
            size += len(held[-1][-1])
            if size >= p.block:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    rows = _wanted(docs).mapInArrow(run, "anchor bigint, block bigint, least bigint, most bigint, n bigint, windows array<bigint>")
    return rows.groupBy("anchor", "block").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.first("windows").alias("windows"))


def _places(docs: DataFrame, owned: Bitmap, p: Params) -> DataFrame:
    """(doc, th, start, anchor, block): where texts have blocks that may have repeated windows."""
    sent = docs.sparkSession.sparkContext.broadcast(owned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            found = read(texts, p)
            found = found.only(sent.value.has(found.block))
            columns = [ids[0][found.text], ids[1][found.text], found.start, found.anchor.view(np.int64), found.block.view(np.int64)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["doc", "th", "start", "anchor", "block"])

    rows = docs.where("doc is not null and text is not null").select("doc", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc bigint, th bigint, start bigint, anchor bigint, block bigint")


def _spans(starts: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Maximal runs of words that windows from sorted starts cover."""
    cut = np.flatnonzero(np.diff(starts) > words)
    begin, end = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + words
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def _repeated(docs: DataFrame, p: Params) -> DataFrame:
    """(doc, th, starts): the first words of windows that a smaller id has too, of texts that have any."""
    seeds = Stored(_anchors(docs, p), "seeds")
    blocks = Stored(_blocks(docs, Bitmap(seeds.df, "anchor"), p), "blocks")
    seeds.drop()
    each = blocks.df.select("anchor", "block", "least", "most", "n", F.posexplode("windows").alias("at", "window"))
    windows = each.groupBy("anchor", "window").agg(F.min("least").alias("owner"), F.max("most").alias("last"), F.count("*").alias("uses")).where("owner < last")
    windows = Stored(windows, "windows")
    met = lookup(each.select("anchor", "block", "most", "n", "at", "window"), windows.df.select("anchor", "window", "owner", "uses"), ["anchor", "window"], "uses").where("owner < most")
    owned = met.groupBy("anchor", "block").agg(F.max("n").alias("uses"), F.collect_list(F.struct("at", "owner")).alias("owners"))  # as many as a block has windows
    owned = Stored(owned, "owned")
    blocks.drop()
    windows.drop()
    places = _places(docs, Bitmap(owned.df, "block"), p)
    hits = lookup(places, owned.df, ["anchor", "block"], "uses")
    own = F.transform(F.filter("owners", lambda o: o["owner"] < F.col("doc")), lambda o: o["at"] + F.col("start"))
    return hits.select("doc", "th", own.alias("s")).where(F.size("s") > 0).groupBy("doc", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("starts"))


def _cut(docs: DataFrame, p: Params, text: bool) -> DataFrame:
    """(doc, n_words, n_removed, spans and the kept text or its digest) of every row of (doc, text)."""
    found = Stored(_repeated(docs, p), "repeated").df
    rows = docs.select("doc", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = likely(rows, F.col("doc"), found, F.col("doc"))
    none = F.lit(None).cast("array<bigint>")
    rest = split.where("not _likely").select("doc", "text", none.alias("starts"))
    some = split.where("_likely").select("doc", "text", F.xxhash64("text").alias("th")).join(found, ["doc", "th"], "left").select("doc", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            lists = b.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, body in enumerate(_column(b, 1)):
                words = body.split()
                spans = _spans(values[at[i] : at[i + 1]], p.words) if at[i] < at[i + 1] else []
                kept, last = [], 0
                for s, e in spans:
                    kept += words[last:s]
                    last = e
                kept = b" ".join(kept + words[last:])
                out.append((len(words), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], kept.decode(errors="replace") if text else hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]], names=["doc", "n_words", "n_removed", "spans", "kept"])

    return rest.unionByName(some).mapInArrow(run, "doc bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string")


def _ready(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))


def repeats(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (words, the end exclusive): maximal repeats of texts that documents of smaller ids have too, window by window."""
    out = _cut(_ready(docs, id_col, text_col), p or Params(), text=False)
    return out.select(F.col("doc").alias("doc_id"), F.inline("spans"))


def remove(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, text: every row's text without its repeats, words joined by single blanks."""
    out = _cut(_ready(docs, id_col, text_col), p or Params(), text=True)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("text"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cut(_ready(table(spark, sf_dir, "documents"), "doc_id", "text"), Params(), text=False)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP12_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, row_number() over () nth from documents),
  g as (select nth, doc_id, unnest(range(1, len(w) - 11)) i, w from d where len(w) > 12),
  h as (select nth, doc_id, i, array_to_string(w[i : i + 12], ' ') s from g),
  f as (select s, min(doc_id) owner from h group by s having min(doc_id) < max(doc_id)),
  c as (select nth, unnest(range(i, i + 13)) i from h join f using (s) where owner < doc_id),
  r as (select nth, list(distinct i) gone from c group by nth)
select doc_id, len(w)::bigint n_words, coalesce(len(gone), 0)::bigint n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end, ' ')) kept_sha256
from d left join r using (nth)
"""
