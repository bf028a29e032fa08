"""ZIP archives and EPUB books: members, package, spine and contents, joined as tables."""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import joins
from quire.sources.batches import mapped
from quire.storage import Stored


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files; one file is read by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def members(files: DataFrame, with_content: bool = False, pattern: str | None = None, most: int = 64 << 20) -> DataFrame:
    """(path, ordinal, name, crc, packed, size, data, error) of archives (path, content), and file where the archives have it.

    ``data`` is read only if asked for, of names that match ``pattern``; members over ``most`` bytes carry an error.
    """
    import re

    wanted = re.compile(pattern) if pattern else None
    ids = [c for c in ("path", "file") if c in files.columns]

    def read(*row) -> Iterator[tuple]:
        *path, content = row
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                    data = error = None
                    if with_content and (wanted is None or wanted.search(m.filename)):
                        try:
                            data, error = (z.read(m), None) if m.file_size <= most else (None, "size")
                        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as x:
                            error = type(x).__name__
                    yield *path, i, m.filename, m.CRC, m.compress_size, m.file_size, data, error
        except zipfile.BadZipFile:
            yield *path, None, None, None, None, None, None, "archive"

    return mapped(files.select(*ids, "content"), read, ", ".join(f"{c} string" for c in ids) + ", ordinal bigint, name string, crc bigint, packed bigint, size bigint, data binary, error string")


def packed(folders: DataFrame) -> DataFrame:
    """(path, content): ZIP archives of folders (path, files: array of name, text), members deflated in the order given.

    An archive is one file and so one row. Files without a name are left out, a text that is null is empty.
    """

    def read(path: str, inside: list[dict] | None) -> Iterator[tuple]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in inside or ():
                if f["name"] is not None:
                    z.writestr(zipfile.ZipInfo(f["name"]), (f["text"] or "").encode(), zipfile.ZIP_DEFLATED, 1)
        yield path, out.getvalue()

    return mapped(folders.select("path", "files"), read, "path string, content binary")


def distinct_members(found: DataFrame) -> DataFrame:
    """The first of members with equal checksum and sizes."""
    w = W.partitionBy("crc", "packed", "size").orderBy("path", "ordinal")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _toc(root: ET.Element, base: str) -> list[tuple]:
    """(title, href, anchor, level) of an NCX or a navigation document."""
    out: list[tuple] = []

    def target(href: str) -> tuple[str, str]:
        file, _, anchor = href.partition("#")
        return posixpath.normpath(posixpath.join(base, unquote(file))) if file else "", anchor

    def ncx(node: ET.Element, level: int) -> None:
        for p in node:
            if _local(p.tag) == "navpoint":
                title = "".join("".join(x.itertext()) for x in p if _local(x.tag) == "navlabel").strip()
                src = next((x.get("src", "") for x in p if _local(x.tag) == "content"), "")
                out.append((title, *target(src), level))
                ncx(p, level + 1)

    def nav(node: ET.Element, level: int) -> None:
        for ol in node:
            if _local(ol.tag) != "ol":
                continue
            for li in ol:
                a = next((x for x in li if _local(x.tag) in ("a", "span")), None)
                if a is not None:
                    out.append((" ".join("".join(a.itertext()).split()), *target(a.get("href", "")), level))
                nav(li, level + 1)

    for node in root.iter():
        if _local(node.tag) == "navmap":
            ncx(node, 1)
        elif _local(node.tag) == "nav" and any(_local(k) == "type" and v == "toc" for k, v in node.attrib.items()):
            nav(node, 1)
    return out


def _package(content: bytes) -> list[tuple]:
    """Rows (part, ordinal, a, b, c, d): metadata, manifest, spine and toc of a book."""
    out: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(x.get("full-path") for x in container.iter() if _local(x.tag) == "rootfile")
        base, package = posixpath.dirname(opf), ET.fromstring(z.read(opf))
        full = lambda h: posixpath.normpath(posixpath.join(base, unquote(h)))
        manifest: dict[str, tuple] = {}
        toc = None
        for node in package.iter():
            tag = _local(node.tag)
            if tag in ("title", "creator", "language", "identifier", "publisher") and (node.text or "").strip():
                out.append(("metadata", len(out), tag, node.text.strip(), None, None))
            elif tag == "item":
                row = (node.get("id"), full(node.get("href", "")), node.get("media-type"), node.get("properties") or "")
                manifest.setdefault(row[0], row)
                out.append(("manifest", len(manifest), *row))
            elif tag == "itemref":
                out.append(("spine", len(out), node.get("idref"), node.get("linear", "yes"), None, None))
        names = set(z.namelist())
        for row in manifest.values():
            if "nav" in row[3].split() and row[1] in names or toc is None and row[2] == "application/x-dtbncx+xml" and row[1] in names:
                toc = row[1]
                if "nav" in row[3].split():
                    break
        if toc:
            out += [("toc", i, *r[:3], str(r[3])) for i, r in enumerate(_toc(ET.fromstring(z.read(toc)), posixpath.dirname(toc)))]
    return out


class Epub:
    """Tables of books (path, content): metadata, manifest, spine, toc, and sections joined from them.

    ``file`` is a digest of the content: books of one path are told apart by it, and rows that repeat a book are one book.
    """

    def __init__(self, files: DataFrame):
        def read(path: str, file: str, content: bytes) -> Iterator[tuple]:
            try:
                rows = _package(content)
            except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration) as x:
                rows = [("error", 0, type(x).__name__, None, None, None)]
            yield from ((path, file, *r) for r in rows)

        self.files = Stored(files.select("path", F.md5("content").alias("file"), "content"), "books").df  # met by four steps: files are made once
        rows = mapped(self.files, read, "path string, file string, part string, ordinal bigint, a string, b string, c string, d string")
        self.rows = Stored(rows.distinct(), "packages").df

    def part(self, name: str, **cols: str) -> DataFrame:
        return self.rows.where(F.col("part") == name).select("path", "file", "ordinal", *[F.col(k).alias(v) for k, v in cols.items()])

    def metadata(self) -> DataFrame:
        return self.part("metadata", a="name", b="value")

    def manifest(self) -> DataFrame:
        return self.part("manifest", a="id", b="href", c="media_type", d="properties")

    def errors(self) -> DataFrame:
        return self.part("error", a="error")

    def toc(self) -> DataFrame:
        """(path, file, toc_index, title, href, anchor, level)"""
        return self.part("toc", a="title", b="href", c="anchor", d="level").withColumn("level", F.col("level").cast("int")).withColumnRenamed("ordinal", "toc_index")

    def sections(self) -> DataFrame:
        """(path, file, section, href, size, cumulative, toc_index, title): the spine in order.

        Items that the manifest lacks are dropped, of repeated ids the first counts. A section takes the first entry of the
        contents that points to it, else that of the section before.
        """
        spine = self.part("spine", a="id").withColumnRenamed("ordinal", "at")
        book = ["path", "file"]
        items = joins.first_match(spine, self.manifest().select(*book, "id", "href", "ordinal"), [*book, "id"], [F.col("ordinal")], "inner")
        sizes = members(self.files).where("error is null").select(*book, F.col("name").alias("href"), "size").distinct()
        entries = self.toc().select(*book, "href", "toc_index", "title")
        rows = joins.first_match(items.join(sizes, [*book, "href"], "left"), entries, [*book, "href"], [F.col("toc_index")])
        w = W.partitionBy(*book).orderBy("at")
        upto = w.rowsBetween(W.unboundedPreceding, 0)
        return rows.select(
            *book, (F.row_number().over(w) - 1).alias("section"), "href", "size", F.sum(F.coalesce("size", F.lit(0))).over(upto).alias("cumulative"),
            F.last("toc_index", ignorenulls=True).over(upto).alias("toc_index"), F.last("title", ignorenulls=True).over(upto).alias("title"),
        )

    def chapters(self) -> DataFrame:
        """(path, file, section, href, html): the text of every section."""
        book = ["path", "file", "href"]
        text = members(self.files, True, r"(?i)\.x?html?$").select("path", "file", F.col("name").alias("href"), F.decode("data", "utf-8").alias("html"))
        return self.sections().select("section", *book).join(text.groupBy(*book).agg(F.first("html").alias("html")), book)


def write_xhtml(blocks: DataFrame, path: str) -> None:
    """Writes (doc, block, tag, text) as one XHTML body a document, escaped, each block with an anchor."""
    from quire.functions.text import xml_escape

    line = F.concat(F.lit("<"), F.col("tag"), F.lit(' id="b'), F.lpad(F.lower(F.hex("block")), 8, "0"), F.lit('">'), xml_escape(F.col("text")), F.lit("</"), F.col("tag"), F.lit(">"))
    body = blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", line.alias("line")))), lambda s: s["line"]), "").alias("body"))
    body.select("doc", F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("value")).write.mode("overwrite").partitionBy("doc").text(path)
