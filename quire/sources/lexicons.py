"""Dictionaries in the StarDict format, catalogue feeds and release lists."""

from __future__ import annotations

import gzip
import struct
import xml.etree.ElementTree as ET
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.ordering import numbered
from quire.sources.batches import few


def discover(files: DataFrame) -> DataFrame:
    """(folder, name) of dictionaries among files (path): those with an index and a body."""
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*?)\.(?:idx|dict|dict\.dz|ifo|syn)$", 1).alias("name"), F.regexp_extract("path", r"\.(idx|dict|ifo|syn)(?:\.dz)?$", 1).alias("ext"))
    found = rows.where("ext <> ''").groupBy("folder", "name").agg(F.collect_set("ext").alias("exts"))
    return found.where("array_contains(exts, 'idx') and array_contains(exts, 'dict')").select("folder", "name").orderBy(F.lower("name"))


def info(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of .ifo files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.contains("value", F.lit("=")))
    return lines.select("path", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.regexp_replace("value", "^[^=]*=", "").alias("value"))


def _index(data: bytes, extra: int) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        end = data.index(b"\0", at)
        yield (data[at:end].decode("utf-8", "replace"), *struct.unpack_from(">II" if extra == 8 else ">I", data, end + 1))
        at = end + 1 + extra


def _dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, bytes]]:
    """Name, index and body of dictionaries from batches (name, ext, content) in which the files of a name follow each other."""
    last, have = None, {}

    def told() -> Iterator[tuple[str, bytes, bytes]]:
        if have:
            yield last, have.get("idx", b""), have["dict"] if "dict" in have else gzip.decompress(have["dict.dz"]) if "dict.dz" in have else b""

    for b in batches:
        for name, ext, content in zip(*b.columns, strict=True):
            if name.as_py() != last:
                yield from told()
                last, have = name.as_py(), {}
            have[ext.as_py()] = content.as_py() or b""
    yield from told()


def _ends(index: bytes) -> np.ndarray:
    """Where the headwords of an index end."""
    ends, at = array("q"), 0
    while at < len(index):
        at = index.index(b"\0", at)
        ends.append(at)
        at += 9
    if at > len(index):
        raise ValueError("an index ends within an entry")
    return np.frombuffer(ends, np.int64)


def _upto(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def _values(data: bytes | np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes from each cut to the next."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


def _decoded(values: pa.Array) -> pa.Array:
    try:
        return values.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())


def _entries(held: list[tuple[str, bytes, bytes, np.ndarray]]) -> pa.RecordBatch:
    """(name, ordinal, headword, definition) of dictionaries (name, index, body, ends of headwords), all read at once."""
    names, indexes, bodies, ends = zip(*held, strict=True)
    counts, data, body = np.array([len(e) for e in ends]), np.frombuffer(b"".join(indexes), np.uint8), b"".join(bodies)
    ends = np.concatenate([e + at for e, at in zip(ends, _upto([len(x) for x in indexes])[:-1], strict=True)])
    number = lambda k: sum(data[ends + k + i].astype(np.int64) << 24 - 8 * i for i in range(4))
    spots = _upto([len(x) for x in bodies])
    most = np.repeat(spots[1:], counts)
    begin = np.minimum(np.repeat(spots[:-1], counts) + number(1), most)
    end = np.minimum(begin + number(5), most)
    word = np.ones(len(data), bool)
    for i in range(9):
        word[ends + i] = False
    heads = _values(data[word], _upto(np.diff(ends, prepend=-9) - 9))
    if np.array_equal(begin[1:], end[:-1]):
        texts = _values(body, np.concatenate([begin, end[-1:]]) if len(end) else np.zeros(1))
    else:
        texts = pa.array([body[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
    ordinals = np.arange(len(ends)) - np.repeat(_upto(counts)[:-1], counts)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts))), pa.array(ordinals, pa.int64()), _decoded(heads), _decoded(texts)], names=["name", "ordinal", "headword", "definition"])


def read_entries(batches: Iterator[pa.RecordBatch], most: int = 1 << 16, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Entries of dictionaries from batches (name, ext, content) in which the files of a name follow each other.

    Dictionaries of ``most`` entries or ``size`` bytes in all are held and read together, so many small ones cost no more than a large one.
    """
    held, n, weight = [], 0, 0
    for name, index, body in _dictionaries(batches):
        ends = _ends(index)
        held.append((name, index, body, ends))
        n, weight = n + len(ends), weight + len(index) + len(body)
        if n >= most or weight >= size:
            yield from few(_entries(held), size)
            held, n, weight = [], 0, 0
    if held:
        yield from few(_entries(held), size)


def entries(files: DataFrame, together: bool = False) -> DataFrame:
    """(name, ordinal, headword, definition) of dictionaries from (path, content) of their .idx and .dict or .dict.dz.

    together: the files of a dictionary follow each other in a task, as ``packed`` leaves those of distinct names; others are brought together by name.
    """
    parts = files.select(F.regexp_extract("path", r"^(.*?)\.(?:idx|dict|dict\.dz)$", 1).alias("name"), F.regexp_extract("path", r"\.(idx|dict|dict\.dz)$", 1).alias("ext"), "content").where("name <> ''")
    if not together:
        parts = parts.repartition("name").sortWithinPartitions("name")
    return parts.mapInArrow(read_entries, "name string, ordinal bigint, headword string, definition string")


def synonyms(files: DataFrame) -> DataFrame:
    """(name, alt, ordinal) of .syn files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in _index(content, 4)], columns=["name", "alt", "ordinal"])

    rows = files.select(F.regexp_extract("path", r"^(.*)\.syn$", 1).alias("name"), "content").where("name <> ''")
    return rows.mapInPandas(run, "name string, alt string, ordinal bigint")


def _joined(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Neighbouring binary values as one, from each cut to the next."""
    if not len(values):
        return pa.array([b""] * (len(cuts) - 1), pa.binary())
    _, offsets, data = values.buffers()
    return _values(data or b"", np.frombuffer(offsets, np.int32)[values.offset + cuts])


def _files(dictionaries: pa.RecordBatch) -> pa.RecordBatch:
    """(path, content) of dictionaries (name, entries), three files each, all made at once."""
    names, lists = dictionaries.columns
    rows = len(names)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    heads, texts = (flat.flatten()[flat.type.get_field_index(c)] for c in ("headword", "definition"))
    if heads.null_count:
        have = pc.is_valid(heads)
        counts = np.bincount(np.repeat(np.arange(rows), counts)[have.to_numpy(zero_copy_only=False)], minlength=rows)
        heads, texts = heads.filter(have), texts.filter(have)
    heads, texts = heads.cast(pa.binary()), pc.fill_null(texts.cast(pa.binary()), b"")
    cuts, sizes = _upto(counts), pc.binary_length(texts).to_numpy(zero_copy_only=False)
    places = _upto(sizes)
    begin = places[:-1] - np.repeat(places[cuts[:-1]], counts)
    if len(begin) and (begin + sizes).max() >= 1 << 32:
        raise ValueError("a dictionary's body has over 4 GiB")
    ends = _values(np.stack([begin, sizes], 1).astype(">u4").tobytes(), np.arange(len(sizes) + 1) * 8)
    index = _joined(pc.binary_join_element_wise(heads, ends, pa.scalar(b"\0", pa.binary())), cuts)
    about = [
        f"StarDict's dict ifo file\nversion=2.4.2\nbookname={name}\nwordcount={n}\nidxfilesize={size}\nsametypesequence=m\n".encode()
        for name, n, size in zip(names.to_pylist(), counts.tolist(), pc.binary_length(index).to_pylist(), strict=True)
    ]
    content = pa.concat_arrays([index, _joined(texts, cuts), pa.array(about, pa.binary())]).take(pa.array(np.arange(3 * rows).reshape(3, rows).T.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([f"{name}.{ext}" for name in names.to_pylist() for ext in ("idx", "dict", "ifo")], pa.string()), content], names=["path", "content"])


def packed(dictionaries: DataFrame) -> DataFrame:
    """(path, content): the .idx, .dict and .ifo of dictionaries (name, entries: array of headword, definition).

    A dictionary is one file of each kind and so one row; entries are written in the order of the array, the files of a dictionary
    one after the other. Entries without a headword are left out, a definition that is null is empty. Bodies of over 4 GiB do not fit
    the format and are an error.
    """
    return dictionaries.select("name", "entries").mapInArrow(lambda batches: (_files(part) for b in batches for part in few(b)), "path string, content binary")


def merge(found: DataFrame, alts: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Dictionaries merged in an order: (ordinal, headword, definition), and synonyms with new ordinals."""
    rank = F.element_at(F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))]), F.col("name"))
    rows = found.withColumn("src", rank).where("src is not null")
    merged = rows.groupBy("headword").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "ordinal", "definition"))), lambda s: s["definition"]), "\n").alias("definition"))
    merged = numbered(merged.withColumn("k", F.lower("headword")), ["k", "headword"], "ordinal").select((F.col("ordinal") - 1).alias("ordinal"), "headword", "definition")
    old = alts.join(found.select("name", "ordinal", "headword"), ["name", "ordinal"]).select("alt", "headword").distinct()
    return merged, old.join(merged.select("headword", "ordinal"), "headword").select("alt", "ordinal")


#: Entries in a piece of a dictionary's files; a multiple of the strides of its sparse indexes.
PIECE = 4096
# The head and stride of page tables, the head, prefix and stride of sampled indexes.
OFT_HEAD, OFT_STRIDE = b"StarDict's Cache, Version: 0.2\xc1\xd1\xa4\x51\x00\x00\x00\x00", 32
CSPT_HEAD, CSPT_PREFIX, CSPT_STRIDE = b"CSPT\x01\x10\x10\x00", 16, 16


def _big(n: Column) -> Column:
    """A number as four bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def _little(n: Column) -> Column:
    digits = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def _placed(rows: DataFrame, sizes: list[str]) -> DataFrame:
    """Adds piece and, for each size, _<size>: the sum of those of smaller ordinals; piece by piece, of which sums are made first."""
    rows = rows.withColumn("piece", F.expr(f"ordinal div {PIECE}"))
    sums = rows.groupBy("piece").agg(*[F.sum(c).alias(c) for c in sizes])
    upto = W.orderBy("piece")  # a row a piece
    before = sums.select(F.col("piece").alias("_at"), *[(F.sum(c).over(upto) - F.col(c)).alias(f"_before_{c}") for c in sizes])
    within = W.partitionBy("piece").orderBy("ordinal")
    out = rows.join(before, F.col("piece") == F.col("_at"))
    return out.select(*rows.columns, *[(F.sum(c).over(within) - F.col(c) + F.col(f"_before_{c}")).alias(f"_{c}") for c in sizes])


def _sparse(rows: DataFrame, path: str, word: str) -> list[DataFrame]:
    """The page table and the sampled index of rows (ordinal, piece, word, entry, _entry)."""
    spark = rows.sparkSession
    joined = lambda c: F.expr(f"listagg({c}) within group (order by ordinal)")
    whole = rows.agg(F.coalesce(F.sum("entry"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).withColumn("piece", F.lit(1 << 40))
    pages = rows.where((F.col("ordinal") + 1) % OFT_STRIDE == 0).withColumn("b", _little(F.col("_entry") + F.col("entry"))).groupBy("piece").agg(joined("b").alias("content"))
    samples = rows.where(F.col("ordinal") % CSPT_STRIDE == 0)
    prefix = F.substring(F.concat(F.encode(word, "UTF-8"), F.lit(bytes(CSPT_PREFIX))), 1, CSPT_PREFIX)
    samples = samples.withColumn("b", F.concat(prefix, _little(F.col("_entry")))).groupBy("piece").agg(joined("b").alias("content"))
    head = lambda b: spark.range(1).select(F.lit(-1).cast("bigint").alias("piece"), F.lit(b).alias("content"))
    count = whole.select(F.lit(-1).cast("bigint").alias("piece"), F.concat(F.lit(CSPT_HEAD), _little(F.ceil(F.col("n") / CSPT_STRIDE))).alias("content"))
    oft = head(OFT_HEAD).unionByName(pages).unionByName(whole.select("piece", _little(F.col("bytes")).alias("content")))
    return [oft.withColumn("path", F.lit(f"{path}.oft")), count.unionByName(samples).withColumn("path", F.lit(f"{path}.oft.cspt"))]


def files_of(name: str, merged: DataFrame, alts: DataFrame, kind: str = "m") -> DataFrame:
    """(path, piece, content): the files of a dictionary from (ordinal, headword, definition) and synonyms (alt, ordinal).

    .idx, .dict, .syn, the page tables (.oft) and sampled indexes (.oft.cspt) of .idx and .syn, and .ifo. A file is its pieces in their order; a piece
    is written by one task and holds ``PIECE`` entries, those of .idx and .dict with one number the same ones. Ordinals count from 0
    without gaps, as from ``merge``. Offsets have 32 bits, so a body of over 4 GiB does not fit the format and is an error.
    """
    joined = lambda c: F.expr(f"listagg({c}) within group (order by ordinal)")
    word, text = F.encode("headword", "UTF-8"), F.encode(F.coalesce("definition", F.lit("")), "UTF-8")
    rows = merged.select("ordinal", "headword", text.alias("text"), F.octet_length(text).cast("bigint").alias("size"), (F.octet_length(word) + 9).cast("bigint").alias("entry"))
    rows = _placed(rows, ["size", "entry"])
    fits = F.when(F.col("_size") + F.col("size") < 1 << 32, F.col("_size")).otherwise(F.raise_error(F.lit("a dictionary's body has over 4 GiB")).cast("bigint"))
    index = rows.withColumn("b", F.concat(F.encode("headword", "UTF-8"), F.lit(b"\0"), _big(fits), _big(F.col("size"))))
    idx = index.groupBy("piece").agg(joined("b").alias("content")).withColumn("path", F.lit(f"{name}.idx"))
    body = rows.groupBy("piece").agg(joined("text").alias("content")).withColumn("path", F.lit(f"{name}.dict"))
    syn = alts.where("alt is not null").select("alt", F.col("ordinal").cast("bigint").alias("target"), F.lower("alt").alias("k"))
    syn = numbered(syn, ["k", "alt", "target"], "nth").select((F.col("nth") - 1).cast("bigint").alias("ordinal"), "alt", "target")
    syn = _placed(syn.withColumn("entry", (F.octet_length(F.encode("alt", "UTF-8")) + 5).cast("bigint")), ["entry"])
    named = syn.withColumn("b", F.concat(F.encode("alt", "UTF-8"), F.lit(b"\0"), _big(F.col("target"))))
    syns = named.groupBy("piece").agg(joined("b").alias("content")).withColumn("path", F.lit(f"{name}.syn"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counted = rows.select(one.alias("n"), F.col("entry").alias("bytes"), none.alias("m")).unionByName(syn.select(none.alias("n"), none.alias("bytes"), one.alias("m")))
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bytes", "m")])
    about = F.concat_ws("\n", F.lit("StarDict's dict ifo file"), F.lit("version=2.4.2"), F.lit(f"bookname={name}"), F.concat(F.lit("wordcount="), "n"), F.concat(F.lit("idxfilesize="), "bytes"), F.concat(F.lit("synwordcount="), "m"), F.lit(f"sametypesequence={kind}"))
    ifo = total.select(none.alias("piece"), F.encode(F.concat(about, F.lit("\n")), "UTF-8").alias("content"), F.lit(f"{name}.ifo").alias("path"))
    out = idx
    for part in (body, syns, ifo, *_sparse(rows, f"{name}.idx", "headword"), *_sparse(syn, f"{name}.syn", "alt")):
        out = out.unionByName(part)
    return out.select("path", "piece", "content")


def piece_entries(pieces: DataFrame) -> DataFrame:
    """(path, piece, headword, offset, size, definition) of a dictionary's pieces (path, piece, content), a piece of .idx with its piece of .dict."""
    side = lambda ext: pieces.where(F.col("path").endswith(f".{ext}")).select(F.regexp_replace("path", rf"\.{ext}$", "").alias("path"), "piece", F.col("content").alias(ext))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, piece, idx, body in zip(b["path"], b["piece"], b["idx"], b["dict"], strict=True):
                found = list(_index(idx, 8))
                first = found[0][1] if found else 0
                rows = [(path, piece, w, o, n, body[o - first : o - first + n].decode("utf-8", "replace")) for w, o, n in found]
                yield pd.DataFrame(rows, columns=["path", "piece", "headword", "offset", "size", "definition"])

    return side("idx").join(side("dict"), ["path", "piece"]).mapInPandas(run, "path string, piece bigint, headword string, offset bigint, size bigint, definition string")


def feed(pages: DataFrame, most: int = 50) -> DataFrame:
    """(path, ordinal, kind, title, author, href, id) of Atom catalogues (path, xml); kind is book, navigation, next, previous or search.

    An entry needs a title and a link; a book link beats a navigation link, a plain .epub link other book links.
    """

    def read(path: str, xml: str) -> list[tuple]:
        try:
            root = ET.fromstring(xml)
        except ET.ParseError:
            return []
        local = lambda n: n.tag.rsplit("}", 1)[-1]
        out: list[tuple] = []
        for n in root:
            if local(n) == "link" and n.get("rel") in ("next", "previous", "search") and n.get("href"):
                out.append((path, len(out), n.get("rel"), None, None, n.get("href"), None))
        for e in [n for n in root if local(n) == "entry"]:
            text = {local(n): " ".join("".join(n.itertext()).split()) for n in e if local(n) in ("title", "id", "author")}
            best = None
            for n in e:
                href, kind, rel = n.get("href"), n.get("type") or "", n.get("rel") or ""
                if local(n) != "link" or not href:
                    continue
                rank = 3 if "acquisition" in rel and "epub" in kind and href.endswith(".epub") else 2 if "acquisition" in rel and "epub" in kind else 1 if "atom+xml" in kind else 0
                if rank and (best is None or rank > best[0]):
                    best = (rank, href)
            if best and text.get("title") and sum(o[2] in ("book", "navigation") for o in out) < most:
                out.append((path, len(out), "book" if best[0] > 1 else "navigation", text["title"], text.get("author"), best[1], text.get("id")))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, x in zip(b["path"], b["xml"], strict=True) for r in read(p, x or "")]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "title", "author", "href", "id"])

    return pages.select("path", "xml").mapInPandas(run, "path string, ordinal bigint, kind string, title string, author string, href string, id string")


def releases(df: DataFrame, json_col: str, asset: str) -> DataFrame:
    """Adds tag, url, size, sha of the first asset whose name matches a pattern."""
    kind = "tag_name string, assets array<struct<name: string, browser_download_url: string, size: bigint, digest: string>>"
    hit = F.element_at(F.filter(F.col("_r.assets"), lambda a: a["name"].rlike(asset)), 1)
    got = df.withColumn("_r", F.from_json(json_col, kind)).withColumn("_a", F.when(F.size(F.filter(F.col("_r.assets"), lambda a: a["name"].rlike(asset))) > 0, hit))
    return got.select(*df.columns, F.col("_r.tag_name").alias("tag"), F.col("_a.browser_download_url").alias("url"), F.col("_a.size").alias("size"), F.regexp_replace("_a.digest", "^sha256:", "").alias("sha"))
