import hashlib

from pyspark.sql import Row

from quire.plans import catalog


def tables(spark, folder, **rows):
    for name, of in rows.items():
        spark.createDataFrame([Row(**r) for r in of]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_natural_order_numbers_every_customer(spark, tmp_path):
    d = tables(spark, tmp_path, customer=[{"c_custkey": k, "c_name": f"Customer#{k}"} for k in (2, 2999, 3000, 10, 14999)])
    got = {r["name"]: r["place"] for r in catalog.QUERIES["natural_order"](spark, d).collect()}
    assert sorted(got, key=got.get) == [f"Customer#{k}-{k % 12}" for k in (2, 10, 2999, 3000, 14999)]


def test_texts_count_to_their_end(spark, tmp_path):
    long = "word " * 100
    d = tables(spark, tmp_path, documents=[{"doc_id": 1, "text": long + "<a>"}, {"doc_id": 2, "text": long + "<b>-"}], benchmark=[{"item_id": 1, "text": "other " * 20 + "x"}])
    e = tables(spark, tmp_path / "e", documents=[{"doc_id": 1, "text": long + "<c>"}, {"doc_id": 2, "text": long + "<b>-"}], benchmark=[{"item_id": 1, "text": "other " * 20 + "y"}])
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r["doc_id"]: (r["escaped"], r["joined"]) for r in catalog.QUERIES["markup_escape"](spark, d).collect()}
    assert got == {1: (digest(long + "&lt;a&gt;"), digest(long + "<a>")), 2: (digest(long + "&lt;b&gt;-"), digest(long + "<b>"))}
    merged = [{r["head"]: r["definition"] for r in catalog.QUERIES["dictionary_merge"](spark, x).collect()} for x in (d, e)]
    assert all(merged[0][h] != merged[1][h] for h in ("word", "other"))


def test_suggestions_for_every_word(spark, tmp_path):
    d = tables(spark, tmp_path, benchmark=[{"text": "zebra zebras ox or cat cart understanding understandings"}])
    got = {(r["w"], r["cand"], r["d"]) for r in catalog.QUERIES["fuzzy_suggestions"](spark, d).collect()}
    pairs = {("zebra", "zebras", 1), ("or", "ox", 1), ("cart", "cat", 1), ("understanding", "understandings", 1)}
    assert got == pairs | {(b, a, n) for a, b, n in pairs}


def test_every_document_and_word(spark, tmp_path):
    d = tables(spark, tmp_path, documents=[{"doc_id": 1, "text": "Able x"}, {"doc_id": 2, "text": "Zoo"}], conversations=[{"conv_id": 1, "turn": 0, "text": "\u00ab\u00e9t\u00e9\u00bb (two) \u4e2d\u6587\u3002 e\u0301!"}])
    assert {(r["doc_id"], r["size"], r["name"]) for r in catalog.QUERIES["batch_lookup"](spark, d).collect()} == {(1, 6, "able"), (2, 3, "zoo")}
    got = {r["i"]: (r["core"], r["looked_up"]) for r in catalog.QUERIES["word_trimming"](spark, d).collect()}
    assert got == {0: ("\u00e9t\u00e9", True), 1: ("two", True), 2: ("\u4e2d\u6587", True), 3: ("e\u0301", True)}
