"""Files of a dictionary against plain byte strings."""

import gzip
import struct

import pyarrow as pa
import pytest

from quire.plans import catalog
from quire.sources import lexicons
from quire.sources.batches import few


def plain(entries, syns):
    """The files of sorted (headword, definition) and (alt, ordinal) as byte strings."""
    body, idx, ends, starts = b"", b"", [], []
    for w, t in entries:
        starts.append(len(idx))
        idx += w.encode() + b"\0" + struct.pack(">II", len(body), len((t or "").encode()))
        body += (t or "").encode()
        ends.append(len(idx))

    def sparse(words, starts, ends, total):
        pages = [e for i, e in enumerate(ends) if (i + 1) % 32 == 0]
        oft = lexicons.OFT_HEAD + b"".join(struct.pack("<I", p) for p in [*pages, total])
        picked = [(w.encode()[:16].ljust(16, b"\0"), s) for i, (w, s) in enumerate(zip(words, starts, strict=True)) if i % 16 == 0]
        return oft, b"CSPT" + struct.pack("<BBHI", 1, 16, 16, len(picked)) + b"".join(w + struct.pack("<I", s) for w, s in picked)

    syn, at, upto = b"", [], []
    for a, n in syns:
        at.append(len(syn))
        syn += a.encode() + b"\0" + struct.pack(">I", n)
        upto.append(len(syn))
    oft, cspt = sparse([w for w, _ in entries], starts, ends, len(idx))
    syn_oft, syn_cspt = sparse([a for a, _ in syns], at, upto, len(syn))
    return {"x.idx": idx, "x.dict": body, "x.syn": syn, "x.idx.oft": oft, "x.idx.oft.cspt": cspt, "x.syn.oft": syn_oft, "x.syn.oft.cspt": syn_cspt}


def joined(pieces):
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["path"], r["piece"])):
        out[r["path"]] = out.get(r["path"], b"") + bytes(r["content"])
    return out


def test_files_equal_plain_bytes(spark, monkeypatch):
    monkeypatch.setattr(lexicons, "PIECE", 64)
    words = sorted({f"{p}{i}" for i in range(150) for p in ("Ä", "b", "C" * 20)}, key=lambda w: (w.lower(), w))
    entries = [(w, None if i % 17 == 0 else f"é{w}\n" * (i % 4)) for i, w in enumerate(words)]
    merged = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(entries)], "ordinal bigint, headword string, definition string").repartition(5)
    alts = [(f"{'Aa'[i % 2]}{i % 90}", i % 40) for i in range(100)]
    got = joined(lexicons.files_of("x", merged, spark.createDataFrame(alts, "alt string, ordinal bigint").repartition(3)))
    want = plain(entries, sorted(alts, key=lambda a: (a[0].lower(), a[0], a[1])))
    assert {k: v for k, v in got.items() if k != "x.ifo"} == want
    about = got["x.ifo"].decode().split("\n")
    assert f"wordcount={len(words)}" in about and f"idxfilesize={len(want['x.idx'])}" in about and "synwordcount=100" in about
    back = lexicons.piece_entries(lexicons.files_of("x", merged, spark.createDataFrame([], "alt string, ordinal bigint"))).collect()
    assert {r["headword"]: r["definition"] for r in back} == {w: t or "" for w, t in entries} and len({r["piece"] for r in back}) == 8
    files = spark.createDataFrame(list(got.items()), "path string, content binary")
    assert {(r["headword"], r["definition"]) for r in lexicons.entries(files).collect()} == {(w, t or "") for w, t in entries}


def test_an_empty_dictionary(spark):
    none = spark.createDataFrame([], "ordinal bigint, headword string, definition string")
    got = joined(lexicons.files_of("x", none, spark.createDataFrame([], "alt string, ordinal bigint")))
    assert got["x.idx.oft"] == lexicons.OFT_HEAD + bytes(4) and got["x.syn.oft.cspt"] == b"CSPT" + struct.pack("<BBHI", 1, 16, 16, 0) and "x.idx" not in got


def test_merged_dictionaries_keep_their_synonyms(spark):
    found = spark.createDataFrame([("a", 0, "pear", "1"), ("a", 1, "Apple", "2"), ("b", 0, "apple", "3"), ("b", 1, "pear", "4")], "name string, ordinal bigint, headword string, definition string")
    alts = spark.createDataFrame([("a", "pome", 0), ("b", "malus", 0)], "name string, alt string, ordinal bigint")
    got = joined(lexicons.files_of("m", *lexicons.merge(found, alts, ["b", "a"])))
    assert got["m.dict"] == b"234\n1" and got["m.syn"] == b"malus\0" + struct.pack(">I", 1) + b"pome\0" + struct.pack(">I", 2)


def index_of(entries):
    return b"".join(w + b"\0" + struct.pack(">II", o, n) for w, o, n in entries)


#: Indexes and bodies: one after the other, with gaps, overlaps, places beyond the body, bytes that are no text, zeros in numbers, no entries, no body.
ODD = {
    "a": ([(b"x", 0, 2), ("é".encode(), 2, 3)], b"12345"), "b": ([(b"", 3, 2), (b"y" * 300, 0, 4)], b"abcde"), "c": ([(b"z", 1, 9), (b"w", 70000, 1)], b"abc"), "d": ([(b"\xff", 0, 1)], b"\xc3"),
    "e": ([], b"rest"), "f": ([(b"n", 0, 1), (b"m", 0, 256)], b"s" * 256), "g": ([(b"lone", 0, 4)], None),
}


def odd_rows():
    return sorted((k, i, w.decode("utf-8", "replace"), (body or b"")[o : o + n].decode("utf-8", "replace")) for k, (entries, body) in ODD.items() for i, (w, o, n) in enumerate(entries))


@pytest.mark.parametrize("most", [1, 3, 100])
def test_files_of_many_dictionaries_are_read_together(most):
    files = [(k, ext, c) for k, (entries, body) in ODD.items() for ext, c in (("dict", body), ("idx", index_of(entries))) if c is not None]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("name", "ext", "content"), f, strict=True)) for f in files[i : i + 3]]) for i in range(0, len(files), 3)]
    read = list(lexicons.read_entries(iter(batches), most))
    assert sorted(tuple(r.values()) for b in read for r in b.to_pylist()) == odd_rows() and (most < 100 or len(read) == 1)
    with pytest.raises(ValueError):
        list(lexicons.read_entries(iter([pa.RecordBatch.from_pylist([{"name": "x", "ext": "idx", "content": b"cut\0" + bytes(7)}])])))
    assert list(lexicons.read_entries(iter([]))) == []


def test_files_far_apart_meet_by_name(spark):
    files = [(f"{k}.idx", index_of(entries)) for k, (entries, _) in ODD.items()] + [("x.txt", b"")]
    files += [(f"{k}.dict.dz", gzip.compress(body)) if k in "ac" else (f"{k}.dict", body) for k, (_, body) in reversed(ODD.items()) if body is not None]
    got = lexicons.entries(spark.createDataFrame(files, "path string, content binary").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == odd_rows()


def test_dictionaries_are_packed_as_plain_bytes(spark):
    made = {"a": [("w", "one"), (None, "lost"), ("é", None), ("", "ü")], "b": [], "c": None, "d": [(None, "x")], "e": [("last", "")]}
    rows = spark.createDataFrame(list(made.items()), "name string, entries array<struct<headword: string, definition: string>>").coalesce(1)
    want = []
    for k, entries in made.items():
        at, index, body = 0, [], b""
        for w, t in entries or []:
            if w is not None:
                text = (t or "").encode()
                index.append((w.encode(), at, len(text)))
                at, body = at + len(text), body + text
        idx = index_of(index)
        about = f"StarDict's dict ifo file\nversion=2.4.2\nbookname={k}\nwordcount={len(index)}\nidxfilesize={len(idx)}\nsametypesequence=m\n"
        want += [(f"{k}.idx", idx), (f"{k}.dict", body), (f"{k}.ifo", about.encode())]
    assert [(r["path"], bytes(r["content"])) for r in lexicons.packed(rows).collect()] == want
    batch = pa.RecordBatch.from_pylist([{"name": k, "entries": [{"headword": w, "definition": t} for w, t in e] if e is not None else None} for k, e in made.items()])
    whole = lexicons._files(batch).to_pylist()
    assert [r for part in few(batch, 1) for r in lexicons._files(part).to_pylist()] == whole == [{"path": p, "content": c} for p, c in want]


def test_dictionaries_of_documents(spark, tmp_path):
    """Small dictionaries share a call of Python, repeated rows are dropped before they are packed, ids may be negative."""
    docs = [(-7, "a b"), (None, "c "), (None, "c "), (3, ""), (3, None), (3, "a b"), (-7, "a b")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["dictionary_entries"](spark, str(tmp_path))
    want = {(i, n, w, f"about {w} {n}") for i, t in docs if t is not None for n, w in enumerate(t.split(" "))}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "InPandas" not in found._jdf.queryExecution().toString()
