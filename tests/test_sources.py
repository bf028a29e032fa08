import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import layout
from quire.sources import books, files, lexicons, pdf


def epub(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        z.writestr("OEBPS/book.opf", """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>A Book</dc:title><dc:creator>Someone</dc:creator></metadata>
          <manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b%20c.xhtml" media-type="application/xhtml+xml"/><item id="b2" href="d.xhtml" media-type="application/xhtml+xml"/>
          <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/></manifest>
          <spine><itemref idref="a"/><itemref idref="b"/><itemref idref="gone"/><itemref idref="b2"/></spine></package>""")
        z.writestr("OEBPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a.xhtml">One</a><ol><li><a href="a.xhtml#x">One x</a></li></ol></li><li><a href="d.xhtml">Two</a></li></ol></nav></body></html>')
        z.writestr("OEBPS/a.xhtml", "<html><body><p>first</p></body></html>")
        z.writestr("OEBPS/b c.xhtml", "<html><body><p>second</p></body></html>")
        z.writestr("OEBPS/d.xhtml", "<html><body><p>third part</p></body></html>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    e = books.Epub(books.archives(spark, str(tmp_path)))
    s = e.sections().orderBy("section").collect()
    assert [(r["href"], r["toc_index"], r["title"]) for r in s] == [("OEBPS/a.xhtml", 0, "One"), ("OEBPS/b c.xhtml", 0, "One"), ("OEBPS/d.xhtml", 2, "Two")]
    assert s[-1]["cumulative"] == sum(r["size"] for r in s)
    assert [r["level"] for r in e.toc().orderBy("toc_index").collect()] == [1, 2, 1]
    assert {(r["name"], r["value"]) for r in e.metadata().collect()} == {("title", "A Book"), ("creator", "Someone")}
    assert e.errors().count() == 1
    assert "third part" in e.chapters().where("section = 2").first()["html"]


def test_members_dedup(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub([("x.css", "p{}"), ("y.css", "p{}")]))
    m = books.members(books.archives(spark, str(tmp_path)), True, r"\.css$")
    assert m.where("data is not null").count() == 2
    assert books.distinct_members(m.where("name like '%.css'")).count() == 1


def test_write_xhtml(spark, tmp_path):
    books.write_xhtml(spark.createDataFrame([(1, 0, "h1", "A & B"), (1, 1, "p", "<x>")], "doc int, block int, tag string, text string"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()["value"] == '<html><body><h1 id="b00000000">A &amp; B</h1><p id="b00000001">&lt;x&gt;</p></body></html>'


def pdf_file(packed):
    """A two-page file; its second page is added by an update; with object and cross-reference streams if packed."""
    cmap = b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <04> <0062> endbfrange"
    one = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ ET q /Artifact BMC BT /F1 8 Tf 1 0 0 1 10 10 Tm (noise) Tj ET EMC Q")
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 8 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 4 0 R /F2 6 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>",
        4: b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>",
        5: b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(one) + one + b"\nendstream",
        6: b"<< /Type /Font /Subtype /TrueType /ToUnicode 7 0 R >>",
        7: b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream",
        8: b"<< /First 9 0 R >>",
        9: b"<< /Title (Top) /First 10 0 R >>",
        10: b"<< /Title <FEFF00E9> /Parent 9 0 R >>",
    }
    out, at = bytearray(b"%PDF-1.5\n"), {}
    inside = [k for k in (1, 2, 3, 4, 8, 9, 10) if packed]
    for k, body in objects.items():
        if k not in inside:
            at[k] = len(out)
            out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    if packed:
        heads, data = [], b""
        for k in inside:
            heads.append(b"%d %d" % (k, len(data)))
            data += objects[k] + b" "
        head = b" ".join(heads) + b" "
        raw = zlib.compress(head + data)
        at[20] = len(out)
        out += b"20 0 obj\n<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(inside), len(head), len(raw)) + raw + b"\nendstream\nendobj\n"
        place = len(out)
        rows = b""
        for k in range(22):
            rows += struct.pack(">BHB", 1, at[k], 0) if k in at else struct.pack(">BHB", 2, 20, inside.index(k)) if k in inside else struct.pack(">BHB", 1, place, 0) if k == 21 else b"\0\0\0\0"
        up = b"".join(b"\2" + bytes((rows[i + j] - (rows[i - 4 + j] if i else 0)) & 255 for j in range(4)) for i in range(0, len(rows), 4))
        raw = zlib.compress(up)
        out += b"21 0 obj\n<< /Type /XRef /W [1 2 1] /Size 22 /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >>\nstream\n" % len(raw) + raw + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % place
        return bytes(out)
    place = len(out)
    out += b"xref\n0 11\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % at[k] for k in range(1, 11)) + b"trailer << /Size 11 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % place
    two = b"BT /F2 10 Tf 3 Tr 50 500 Td <010203> Tj ET"
    new = {2: objects[2].replace(b"[3 0 R]", b"[3 0 R 11 0 R]"), 11: b"<< /Type /Page /Parent 2 0 R /Contents 12 0 R >>", 12: b"<< /Length %d /Filter /ASCIIHexDecode >>\nstream\n" % (2 * len(two) + 1) + two.hex().encode() + b">\nendstream"}
    table = b""
    for k, body in new.items():
        table += b"%d 1\n%010d 00000 n \n" % (k, len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    return bytes(out) + b"xref\n" + table + b"trailer << /Size 13 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, len(out))


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, packed):
    df = spark.createDataFrame([("a", bytearray(pdf_file(packed))), ("b", bytearray(b"junk"))], "path string, content binary")
    rows = pdf.text_runs(df).orderBy("path", "page", "run").collect()
    good = [(r["page"], r["text"], round(r["x0"]), round(r["baseline"]), r["hidden"]) for r in rows if r["error"] is None]
    assert good == [(0, "Hello (you)", 72, 700, False), (0, "world", 72, 686, False)] + ([] if packed else [(1, "Abc", 50, 500, True)])
    assert [r["path"] for r in rows if r["error"]] == ["b"]
    assert [(r["title"], r["level"], r["parent"]) for r in pdf.outlines(df).orderBy("toc_index").collect()] == [("Top", 1, None), ("é", 2, 0)]


def test_pdf_filters():
    assert pdf.undo_predictor(bytes([1, 1, 2, 3, 2, 1, 1, 1]), {"Predictor": 15, "Columns": 3}) == bytes([1, 3, 6, 2, 4, 7])
    assert pdf.undo_predictor(bytes([4, 5, 6, 4, 1, 1]), {"Predictor": 15, "Columns": 2}) == bytes([5, 11, 6, 12])
    bomb = pdf.Stream({"Filter": "FlateDecode"}, zlib.compress(b"0" * (70 << 20)))
    with pytest.raises(ValueError, match="expansion"):
        pdf.Pdf.decode(pdf.Pdf(pdf_file(False)), bomb)


def test_dictionary(spark):
    words = [("alpha", "first"), ("beta", "second")]
    body, idx = b"", b""
    for w, d in words:
        idx += w.encode() + b"\0" + struct.pack(">II", len(body), len(d))
        body += d.encode()
    syn = b"a\0" + struct.pack(">I", 0)
    df = spark.createDataFrame([("/d/x.idx", bytearray(idx)), ("/d/x.dict", bytearray(body)), ("/d/x.syn", bytearray(syn)), ("/d/y.idx", bytearray(idx)), ("/d/y.dict", bytearray(body))], "path string, content binary")
    assert [(r["folder"], r["name"]) for r in lexicons.discover(df).collect()] == [("/d", "x"), ("/d", "y")]
    found, alts = lexicons.entries(df), lexicons.synonyms(df)
    merged, syns = lexicons.merge(found, alts, ["/d/y", "/d/x"])
    assert [(r["ordinal"], r["headword"], r["definition"]) for r in merged.orderBy("ordinal").collect()] == [(0, "alpha", "first\nfirst"), (1, "beta", "second\nsecond")]
    assert [(r["alt"], r["ordinal"]) for r in syns.collect()] == [("a", 0)]


def test_feed_and_releases(spark):
    xml = """<feed xmlns="http://www.w3.org/2005/Atom"><link rel="next" href="/2"/><entry><title>Book</title><author><name>Who</name></author><id>1</id>
      <link rel="subsection" type="application/atom+xml" href="/n"/><link rel="http://opds-spec.org/acquisition" type="application/epub+zip" href="/b.epub"/></entry>
      <entry><title>Shelf</title><link type="application/atom+xml;kind=navigation" href="/s"/></entry><entry><title>None</title></entry></feed>"""
    rows = lexicons.feed(spark.createDataFrame([("f", xml), ("g", "<broken")], "path string, xml string")).orderBy("ordinal").collect()
    assert [(r["kind"], r["title"], r["href"]) for r in rows] == [("next", None, "/2"), ("book", "Book", "/b.epub"), ("navigation", "Shelf", "/s")]
    js = '{"tag_name": "v2", "assets": [{"name": "x.txt"}, {"name": "fw.bin", "browser_download_url": "u", "size": 5, "digest": "sha256:ab"}]}'
    r = lexicons.releases(spark.createDataFrame([(js,)], "j string"), "j", r"\.bin$").first()
    assert (r["tag"], r["url"], r["size"], r["sha"]) == ("v2", "u", 5, "ab")


def test_files(spark, tmp_path):
    for name in ("b2.txt", "b10.TXT", ".hidden", "note.png"):
        (tmp_path / name).write_text("one two three\r\nfour " * 20)
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 3
    assert [r["name"] for r in files.next_books(found, "b2.txt", 5).collect()] == ["b10.TXT"]
    assert [r["name"] for r in files.sort_listing(found).collect()] == ["b2.txt", "b10.TXT", "note.png"]
    assert files.signature(found).first()["files"] == 3
    pages = files.text_pages(spark, str(tmp_path / "b2.txt"), 20, 4).orderBy("page").collect()
    assert [p["first"] for p in pages] == list(range(0, 4 * len(pages), 4)) and pages[0]["text"].startswith("one two three\nfour")


def test_logs_and_stats(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i}", "ok") for i in range(60)], "seq bigint, word string, status string")
    files.append_log(rows, str(tmp_path / "log"), "seq", "word", "status")
    assert [r["word"] for r in files.recent_log(spark, str(tmp_path / "log"), n=2).collect()] == ["w59", "w58"]
    (tmp_path / "s.json").write_text('{"version": 1, "device": "a", "sessions": 3}\n{"version": 9, "device": "b"}\n{broken\n{"version": 3, "device": "c", "tod": [1, 2, 3, 4]}\n')
    assert [(r["device"], r["tod"]) for r in files.read_stats(spark, str(tmp_path / "s.json")).orderBy("device").collect()] == [("a", [0, 0, 0, 0]), ("c", [1, 2, 3, 4])]
    files.write_stats(rows, str(tmp_path / "v"), "1")
    assert spark.read.json(str(tmp_path / "v")).count() == 60
    assert files.checksum(rows, "seq", "word") == files.checksum(rows.orderBy(F.desc("seq")), "seq", "word")


def test_bitmap_books(spark):
    head = struct.pack("<IBBHBBBBIQQQQ", 0x00435458, 1, 0, 2, 0, 0, 0, 0, 1, 0, 56, 88, 0) + bytes(8)
    good = head + struct.pack("<QIHH", 88, 4, 480, 800) + struct.pack("<QIHH", 92, 40, 480, 800) + bytes(8)
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"x" * 60)), ("c", bytearray(b"x"))], "path string, content binary")
    got = [(r["path"], r["page"], r["width"], r["error"]) for r in files.bitmap_pages(df).orderBy("path", "page").collect()]
    assert got == [("a", 0, 480, None), ("a", 1, 480, "range"), ("b", None, None, "magic"), ("c", None, None, "header")]


def locked(body, key, n):
    own = hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()
    return pdf.rc4(own[: min(len(key) + 5, 16)], body)


@pytest.mark.parametrize("revision", [2, 3])
def test_pdf_empty_password(spark, revision):
    owner, ident = bytes(range(32)), b"0123456789abcdef"
    size = 5 if revision == 2 else 16
    key = hashlib.md5(pdf._FILL + owner + (0xFFFFFFFC).to_bytes(4, "little") + ident).digest()[:size]
    if revision == 2:
        user = pdf.rc4(key, pdf._FILL)
    else:
        for _ in range(50):
            key = hashlib.md5(key).digest()[:size]
        user = hashlib.md5(pdf._FILL + ident).digest()
        for i in range(20):
            user = pdf.rc4(bytes(c ^ i for c in key), user)
        user += bytes(16)
    page = locked(b"BT /F1 12 Tf 72 700 Td (secret words) Tj ET", key, 5)

    def whole(u):
        title = locked(b"Top", key, 9).hex().encode()
        lock = b"<< /Filter /Standard /V %d /R %d /Length %d /P -4 /O <%s> /U <%s> >>" % (revision - 1, revision, 8 * size, owner.hex().encode(), u.hex().encode())
        bodies = {1: b"<< /Pages 2 0 R /Outlines 8 0 R >>", 2: b"<< /Kids [3 0 R] /Resources << /Font << /F1 4 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", 4: b"<< /Type /Font /Subtype /Type1 >>",
                  5: b"<< /Length %d >>\nstream\n" % len(page) + page + b"\nendstream", 7: lock, 8: b"<< /First 9 0 R >>", 9: b"<< /Title <" + title + b"> >>"}
        out, rows = bytearray(b"%PDF-1.4\n"), b""
        for k, body in bodies.items():
            rows += b"%d 1\n%010d 00000 n \n" % (k, len(out))
            out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
        return bytes(out) + b"xref\n" + rows + b"trailer << /Size 10 /Root 1 0 R /Encrypt 7 0 R /ID [<%s> <00>] >>\nstartxref\n%d\n%%%%EOF" % (ident.hex().encode(), len(out))

    df = spark.createDataFrame([("a", bytearray(whole(user))), ("b", bytearray(whole(bytes(32))))], "path string, content binary")
    assert [(r["path"], r["text"], r["error"]) for r in pdf.text_runs(df).orderBy("path").collect()] == [("a", "secret words", None), ("b", None, "encrypted")]
    assert [r["title"] for r in pdf.outlines(df).collect()] == ["Top"]


def test_rc4():
    assert pdf.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def test_named_destinations(spark):
    bodies = [b"", b"<< /Pages 2 0 R /Dests << /old [4 0 R /Fit] >> /Names << /Dests 5 0 R >> >>", b"<< /Kids [3 0 R 4 0 R] >>", b"<< /Type /Page >>", b"<< /Type /Page >>",
              b"<< /Kids [6 0 R 7 0 R 5 0 R] >>", b"<< /Limits [(a) (c)] /Names [(a) [3 0 R /Fit] (c) << /D [4 0 R /Fit] >>] >>", b"<< /Limits [(m) (z)] /Names [(m) [99 0 R /Fit] (z) [3 0 R /Fit]] >>"]
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in enumerate(bodies) if k) + b"trailer << /Root 1 0 R >>"
    got = pdf.named_destinations(spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(b"junk"))], "path string, content binary")).collect()
    assert sorted((r["name"], r["page"]) for r in got) == [("a", 0), ("c", 1), ("m", None), ("old", 1), ("z", 0)]
    file = pdf.Pdf(body)
    assert [file.destination(n) for n in (b"a", b"c", b"m", b"z", b"old", b"b", b"none")] == [0, 1, None, 0, 1, None, None]


def test_bitmap_chapters(spark):
    def book(has, chapters):
        rows = b"".join(struct.pack("<80sHH12x", name, a, b) for name, a, b in chapters)
        return struct.pack("<IBBHBBBBIQQQQ", 0x00435458, 1, 0, 10, 0, 0, 0, has, 0, 0, 56 + len(rows), 56 + len(rows), 0)[:48] + struct.pack("<Q", 56) + rows

    rows = [(b"One", 1, 4), (b"Far", 30, 31), (b"Back", 6, 5), (b"Two", 5, 99), (b"", 0, 0), (b"after the end", 1, 2)]
    df = spark.createDataFrame([("a", bytearray(book(1, rows))), ("b", bytearray(book(0, rows))), ("c", bytearray(b"x"))], "path string, content binary")
    assert [tuple(r) for r in files.bitmap_chapters(df).orderBy("chapter").collect()] == [("a", 0, "One", 0, 3), ("a", 1, "Two", 4, 9)]


def test_rotated(spark):
    df = spark.createDataFrame([(10, 0), (0, 0), (0, -1), (10, 5), (10, 6), (-10, -6)], "dx int, dy int")
    assert [r[0] for r in df.select(layout.rotated(F.col("dx"), F.col("dy"))).collect()] == [False, False, True, False, True, True]


def test_a_ledger_depends_on_order_alone(spark):
    rows = [(i, f"f{i % 7}", None if i % 5 == 0 else i * i) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, path string, size bigint")
    one = files.ledger(df.coalesce(1), ["seq"], "path", "size")
    assert {files.ledger(df.repartition(n), ["seq"], "path", "size") for n in (2, 5)} == {one} and one.startswith("300:")
    swapped = [(1 if i == 2 else 2 if i == 1 else i, p, z) for i, p, z in rows]
    assert files.ledger(spark.createDataFrame(swapped, df.schema), ["seq"], "path", "size") != one
    assert files.ledger(df.limit(0), ["seq"], "path") == "0:0000000000000000"
    assert files.ledger(df.where("seq < 2").union(df.where("seq < 2")), ["seq"], "path") == files.ledger(df.where("seq < 2").union(df.where("seq < 2")).repartition(3), ["seq"], "path")
    pieces = [(h * 17 % files.PRIME, 1) for h in range(9)]
    left = right = (0, 0)
    for p in pieces:
        left = files.join_ledgers(left, p)
    for p in reversed(pieces):
        right = files.join_ledgers(p, right)
    assert left == right
