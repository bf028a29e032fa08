"""Listings, plain texts, append logs, versioned statistics, bitmap books; and the writers that go with them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout
from quire.operators import ordering

BOOKS = ("epub", "pdf", "txt", "md", "xtc", "xtch")
HIDDEN = ("System Volume Information", "LOST.DIR", "$RECYCLE.BIN")


def listing(spark: SparkSession, path: str, show_hidden: bool = False, books_only: bool = False) -> DataFrame:
    """(path, name, size, modified, is_epub) of the files under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = files.withColumn("name", F.regexp_extract("path", "[^/]*$", 0)).withColumn("is_epub", F.lower("name").endswith(".epub"))
    if not show_hidden:
        out = out.where(~F.col("name").startswith(".") & ~F.col("name").isin(*HIDDEN))
    if books_only:
        out = out.where(supported(F.col("name")))
    return out.select("path", "name", "size", "modified", "is_epub")


def supported(name: Column) -> Column:
    return name.rlike(rf"(?i)\.({'|'.join(BOOKS)})$")


def signature(files: DataFrame) -> DataFrame:
    """(folder, files, signature): a digest of each folder's names and sizes in natural order."""
    keyed = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.struct(ordering.natural_key(F.col("name")).alias("k"), "name", "size").alias("f"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat_ws(":", f["name"], f["size"])), "\n")
    return keyed.groupBy("folder").agg(F.count("*").alias("files"), F.sha2(text, 256).alias("signature"))


def next_books(files: DataFrame, current: str, k: int) -> DataFrame:
    """The k supported files that follow a name in natural order."""
    key = ordering.natural_key
    return files.where(supported(F.col("name"))).withColumn("k", key(F.col("name"))).where(F.col("k") > key(F.lit(current))).orderBy("k", "name").limit(k).drop("k")


def sort_listing(files: DataFrame) -> DataFrame:
    """Folders first, then by natural order; ``is_dir`` may be missing."""
    is_dir = F.col("is_dir") if "is_dir" in files.columns else F.lit(False)
    return files.orderBy(is_dir.desc(), ordering.natural_key(F.col("name")), "name")


def text_pages(spark: SparkSession, path: str, width: int = 40, lines: int = 20) -> DataFrame:
    """(path, page, first, last, text): plain texts wrapped to lines and cut in pages; first and last number lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), layout.wrap(F.regexp_replace("value", "\r\n?", "\n"), F.lit(width)).alias("lines"))
    n = F.ceil(F.size("lines") / lines).cast("int")
    cut = whole.select("path", "lines", F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    first = F.col("page") * lines
    return cut.select("path", "page", first.alias("first"), (F.least(first + lines, F.size("lines")) - 1).alias("last"), F.array_join(F.slice("lines", first + 1, lines), "\n").alias("text"))


def append_log(df: DataFrame, path: str, *cols: str) -> None:
    """Appends rows as lines of fields parted by "|"."""
    df.select(F.concat_ws("|", *cols).alias("value")).write.mode("append").text(path)


def recent_log(spark: SparkSession, path: str, order: str = "seq", n: int = 50) -> DataFrame:
    """The last n of lines "seq|word|status", newest first."""
    parts = F.split("value", r"\|")
    rows = spark.read.text(path).select(parts[0].try_cast("bigint").alias("seq"), parts[1].alias("word"), parts[2].alias("status"))
    return rows.where("seq is not null").orderBy(F.desc(order)).limit(n)


STATS = "version int, device string, sessions bigint, seconds bigint, pages bigint, longest bigint, tod array<bigint>, dow array<bigint>"


def read_stats(spark: SparkSession, path: str, newest: int = 3) -> DataFrame:
    """Statistics of devices from JSON lines; lines that are broken or of a newer version are skipped."""
    rows = spark.read.schema(STATS + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    ok = F.col("_broken").isNull() & F.col("device").isNotNull() & F.col("version").between(1, newest)
    return rows.where(ok).drop("_broken").withColumn("tod", F.coalesce("tod", F.array_repeat(F.lit(0).cast("bigint"), 4))).withColumn("dow", F.coalesce("dow", F.array_repeat(F.lit(0).cast("bigint"), 7)))


def write_stats(df: DataFrame, path: str, version: str) -> None:
    """Writes a version of its own beside those before; readers take the newest whole one."""
    df.write.mode("overwrite").json(f"{path}/version={version}")


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def checksum(df: DataFrame, *cols: str) -> str:
    """A digest of rows that does not depend on their order; duplicates count."""
    got = df.groupBy(F.sha2(F.concat_ws("\x1f", *cols), 256).alias("h")).count().agg(F.sum(F.xxhash64("h", "count").cast("decimal(38,0)")).alias("s"), F.sum("count").alias("n")).first()
    return f"{got['n'] or 0}:{got['s'] or 0}"


#: A prime and a base for hashes of sequences.
PRIME, BASE = (1 << 61) - 1, 0x1F35F3A7C2B4D609


def join_ledgers(first: tuple[int, int], second: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of one sequence after the other; associative, so pieces may be joined in any grouping, in their order."""
    return (first[0] * pow(BASE, second[1], PRIME) + second[0]) % PRIME, first[1] + second[1]


def ledger(df: DataFrame, order: list[str], *cols: str) -> str:
    """A digest of rows in an order: equal at any partitioning, another where two unequal rows change places.

    Rows are dealt by ranges of the order; a task folds its range into a hash and a length, and these, one for each range, are joined in their order.
    Rows equal in ``order`` go by their digests. A null is not an empty text.
    """
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in cols]), {"ignoreNullFields": "false"})
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint").alias("_h"))
    keys = [c for c in rows.columns if c != "_h"]
    ranged = rows.repartitionByRange(*keys, "_h") if keys else rows.repartitionByRange("_h")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done = None, (0, 0)
        for b in batches:
            for h in b["_h"].tolist():
                done = (done[0] * BASE + h) % PRIME, done[1] + 1
            at = int(b["at"].iloc[0]) if at is None and len(b) else at
        if at is not None:
            yield pd.DataFrame({"at": [at], "hash": [done[0]], "n": [done[1]]})

    pieces = ranged.sortWithinPartitions(*keys, "_h").select("_h", F.spark_partition_id().alias("at")).mapInPandas(fold, "at int, hash bigint, n bigint").collect()
    whole = (0, 0)
    for p in sorted(pieces, key=lambda r: r["at"]):
        whole = join_ledgers(whole, (p["hash"], p["n"]))
    return f"{whole[1]}:{whole[0]:016x}"


_HEADER, _PAGE = "<IBBHBBBBIQQQQ", "<QIHH"
# Magic numbers of bitmap books and their pages' depths.
MAGIC = {0x00435458: 1, 0x48435458: 2}


def bitmap_pages(files: DataFrame) -> DataFrame:
    """(path, page, at, size, width, height, depth, error) of bitmap books from (path, content); a bad file gives one row with its error."""

    def read(path: str, content: bytes) -> list[tuple]:
        try:
            magic, major, _, count, _, _, _, _, _, _, table, _, _ = struct.unpack_from(_HEADER, content)
            if magic not in MAGIC or major != 1:
                return [(path, None, None, None, None, None, None, "magic" if magic not in MAGIC else "version")]
            pages = [struct.unpack_from(_PAGE, content, table + i * struct.calcsize(_PAGE)) for i in range(count)]
        except struct.error:
            return [(path, None, None, None, None, None, None, "header")]
        return [(path, i, *p, MAGIC[magic], None if p[0] + p[1] <= len(content) else "range") for i, p in enumerate(pages)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in read(p, c)]
            yield pd.DataFrame(rows, columns=["path", "page", "at", "size", "width", "height", "depth", "error"]).astype({c: "Int64" for c in ("page", "at", "size", "width", "height", "depth")})

    return files.select("path", "content").mapInPandas(run, "path string, page bigint, at bigint, size bigint, width bigint, height bigint, depth bigint, error string")


_CHAPTERS_AT, _CHAPTER = 0x30, 96


def bitmap_chapters(files: DataFrame) -> DataFrame:
    """(path, chapter, name, first_page, last_page) of bitmap books from (path, content); pages from 0.

    Chapters that begin past the last page, or end before they begin, are left out; one that ends past it ends there.
    """

    def read(path: str, content: bytes) -> Iterator[tuple]:
        try:
            magic, major, _, count, _, _, _, has, _, _, table, data, _ = struct.unpack_from(_HEADER, content)
            at = struct.unpack_from("<Q", content, _CHAPTERS_AT)[0]
        except struct.error:
            return
        if magic not in MAGIC or major != 1 or has != 1 or at < _CHAPTERS_AT + 8:
            return
        end = next((x for x in (table, data) if at < x <= len(content)), len(content))
        n = 0
        for place in range(at, end - _CHAPTER + 1, _CHAPTER):
            name = content[place : place + 80].split(b"\0")[0].decode("utf-8", "replace")
            first, last = struct.unpack_from("<HH", content, place + 80)
            if not name and not first and not last:
                break
            first, last = max(first - 1, 0), min(max(last - 1, 0), count - 1)
            if first <= last:
                yield path, n, name, first, last
                n += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in read(p, c)]
            yield pd.DataFrame(rows, columns=["path", "chapter", "name", "first_page", "last_page"]).astype({c: "Int64" for c in ("chapter", "first_page", "last_page")})

    return files.select("path", "content").mapInPandas(run, "path string, chapter bigint, name string, first_page bigint, last_page bigint")
