"""Searches, near-duplicates, toxicity, SentencePiece, HTML: brute force and edge cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quire.llm import ann, exact_topk, html_extract, near_dup, registry, sentencepiece_codec, toxicity, vectors


# --- SentencePiece ---


def test_codec_equals_library(spark):
    import sentencepiece

    path = sentencepiece_codec.model_path()
    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(1)
    texts = [None, "", " ", "▁", "  a  ", "\n\t", "é日😀 \x00", "<s> </s> <0x0A>", "a" * 50_000, "word " * 20_000] + ["".join(rnd.choice("ab  ▁\n\té日😀<s>.") for _ in range(rnd.randint(1, 15))) for _ in range(500)]
    df = spark.createDataFrame([(i if i else None, t, i, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, k int, ids int")
    rows = {r["doc_id"]: r for r in sentencepiece_codec.encode(df, path).collect()}
    digests = {r["doc_id"]: r for r in sentencepiece_codec.encode_digest(df, path).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t) if t else []
        r, d = rows[i if i else None], digests[i if i else None]
        assert r["ids"] == ids and r["decoded"] == (sp.decode(ids) if ids else "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(r["decoded"]))
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, path).drop("decoded"), path)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {k: r["decoded"] for k, r in rows.items()}


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_codec_blocks_and_wide_numbers(spark, block):
    path = sentencepiece_codec.model_path()
    texts = ["a b a c", "b  b", None, "", " ".join(f"w{i}" for i in range(70_000)), "a"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    p = sentencepiece_codec.Params(block_chunks=block, block_chars=50 * block)
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode(df, path, params=p).collect()}
    sp = sentencepiece_codec.Codec(path).sp
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == (sp.encode(t) if t else []) and got[i]["decoded"] == (t or "")


def test_a_chunk_is_segmented_once(spark):
    path = sentencepiece_codec.model_path()
    docs = spark.createDataFrame([(i, "the same words " * 9) for i in range(40)], "id bigint, text string").repartition(8)
    rows = sentencepiece_codec._blocks(docs, sentencepiece_codec.Params(block_chunks=1)).where("bucket is not null")
    lists = rows.select("bucket", "chunks").collect()
    chunks = [c for r in lists for c in r["chunks"].split(" ")]
    assert len(chunks) == 4 * 40 and len(set(chunks)) == 4  # the trailing blank is a chunk of its own
    assert len({(r["bucket"], c) for r in lists for c in r["chunks"].split(" ")}) == 4  # each in one place
    assert sentencepiece_codec.encode_digest(spark.createDataFrame([], "doc_id bigint, text string"), path).count() == 0


# --- searches ---


def vector_rows():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 8))
    v[::3] = v[0]  # a third of the rows
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    bad = [(2000, None, 0), (2001, [0.0] * 8, 0), (2002, [1.0, None] + [0.0] * 6, 0), (2003, [float("nan")] * 8, 0), (2004, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (2005, [], 0), (2006, [1.0] * 3, 0)]
    return rows + bad + [(7, [9.0] * 8, 1)]


SCHEMA = "vec_id bigint, embedding array<double>, id int"


def test_usable(spark):
    got = vectors.usable(spark.createDataFrame(vector_rows(), SCHEMA), "vec_id", "embedding", True).collect()
    assert sorted(r["id"] for r in got) == sorted([*range(1500), 7, 2006])
    assert {r["id"] for r in vectors.usable(spark.createDataFrame(vector_rows(), SCHEMA), "vec_id", "embedding", False).collect()} >= {2001, 2005}
    assert vectors.usable(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", True).count() == 0
    floats = spark.createDataFrame([(1, [0.5])], "vec_id int, embedding array<float>")
    assert dict(vectors.usable(floats, "vec_id", "embedding", True).dtypes) == {"id": "bigint", "v": "array<float>"}
    assert vectors.matrix([[1.0], [1.0, 2.0, 3.0], []], 2).tolist() == [[1, 0], [1, 2], [0, 0]]


def padded(rows, nonzero):
    """(id, vector of 8) of the rows that take part."""
    out = [(i, np.array((list(v) + [0.0] * 8)[:8])) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, v) for i, v in out if not nonzero or v.any()]


def brute(vecs, score, k):
    ids = sorted(vecs)
    return {q: sorted(((-score(vecs[q], vecs[i]), i) for i in ids if i != q))[:k] for q in ids if q % 50 == 0}


def test_ann_recall_and_order(spark):
    v = vectors.usable(spark.createDataFrame(vector_rows(), SCHEMA), "vec_id", "embedding", True)
    v = v.where("id <> 7 and id < 2000")
    vecs = {r["id"]: np.array(r["v"]) for r in v.collect()}
    p = ann.Params(list_target=40, list_rows=50, probes=20)
    got = collections.defaultdict(list)
    for r in ann.Index(v, 5, p).search(v.where("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(vecs, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)), 5)
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    hit = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want if q % 3)
    assert hit >= 0.9 * 5 * sum(1 for q in want if q % 3)
    for q in want:
        if q % 3 == 0:  # of the hot vector the smallest ids
            assert [i for i, _ in got[q]] == [i for i in range(0, 1500, 3) if i != q][:5]
        for i, s in got[q]:
            assert abs(s - vecs[q] @ vecs[i] / np.sqrt((vecs[q] @ vecs[q]) * (vecs[i] @ vecs[i]))) < 1e-12


def test_ann_reads_as_many_lists_as_recall_takes(spark):
    rng = np.random.default_rng(5)
    vecs = dict(enumerate(rng.normal(size=(3000, 32))))
    v = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in vecs.items()], "id bigint, v array<double>")
    got = collections.defaultdict(set)
    for r in ann.Index(v, 5, ann.Params(list_target=20, probes=6, least_rows=1)).search(v.where("id % 50 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute(vecs, lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)), 5)
    assert sum(len({i for _, i in want[q]} & got[q]) for q in want) >= 0.97 * 5 * len(want)


def test_ann_small_tables(spark):
    none = vectors.usable(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", True)
    assert ann.Index(none, 5).search(none).count() == 0
    few = vectors.usable(spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [1e200, 1e200], 0), (51, [1e-200, 0.0], 0)], SCHEMA), "vec_id", "embedding", True)
    rows = ann.Index(few, 5).search(few.where("id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in rows] == [(0, 1, 51, 1.0), (0, 2, 50, 0.707107), (50, 1, 0, 0.707107), (50, 2, 51, 0.707107)]


@pytest.mark.parametrize("block", [4096, 7])
def test_topk_equals_brute_force(spark, block):
    rows = [*vector_rows(), (50, [2.0] * 8, 0), (100, [1.0] * 3, 0)]  # two rows of one query
    v = vectors.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", False)
    took = [(i, np.floor(256 * x).astype(int)) for i, x in padded(rows, False)]
    found = collections.defaultdict(list)
    for q, x in took:
        if q % 50 == 0:
            found[q] += [(-int(x @ y), i) for i, y in took if i != q]
    want = [(q, n + 1, i, -s) for q, x in found.items() for n, (s, i) in enumerate(sorted(x)[:5])]
    got = [tuple(r) for r in exact_topk.search(v, v.where("id % 50 = 0"), 5, 256.0, block).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_ann_searches_rows_that_repeat_an_id_or_are_short(spark):
    rows = [*vector_rows(), (3000, [0.0, 0.0, 5.0], 0), (3050, [0.0, 0.0, 7.0, 0.0], 0), (8, [0.0, 0.0, 1.0] + [0.0] * 5, 0)]
    v = vectors.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", True)
    got = [r["vec_id"] for r in ann.Index(v, 5, ann.Params(list_target=40)).search(v.where("id % 50 = 0")).where("query_id = 3000").orderBy("rank").collect()]
    assert got[:2] == [8, 3050] and len(got) == 5


def test_topk_small_and_huge(spark):
    rows = [(0, [1e15, -1e15], 0), (1, [1e15, 3.0], 0), (2, [-1e15, 5.0], 0), (50, [1e300, 1.0], 0), (51, [0.0, 0.0], 0)]
    v = vectors.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", False)
    got = sorted(tuple(r) for r in exact_topk.search(v, v.where("id % 50 = 0"), 9).collect())
    big = 2**63 - 1
    q0 = [r[2:] for r in got if r[0] == 0]
    assert [r[0] for r in q0] == [1, 50, 51, 2] and q0[0][1] == big and q0[-1][1] == -big
    assert len([r for r in got if r[0] == 50]) == 4
    none = v.limit(0)
    assert exact_topk.search(none, none, 5).count() == 0


# --- near-duplicates ---


def shingles(t, n):
    w = [x for x in (t or "").encode().lower().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_groups(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids, default=None), bool(ids) and rows[i][0] == min(ids)) for i in g]
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvw")
    base = [word() for _ in range(120)]
    rows = []
    for _ in range(150):  # one large group of near copies, some linked only through others
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    passage = " ".join(base[:50])
    rows += [f"{passage} {' '.join(word() for _ in range(100))}" for _ in range(60)]
    rows += [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(100)]
    rows += ["Same TEXT here now"] * 40 + ["same  text\nhere\tnow", "a b", "A  B", "a", None, "", " \n", "é É", "é é"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(None, "same text here now"), (None, "alone and without id"), (4, rows[0]), (5, rows[1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("leaf", "levels"), [(1000, 16), (20, 16), (20, 1)])
def test_near_duplicates_equal_brute_force(spark, leaf, levels):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, uid int")
    got = near_dup.groups(df, near_dup.Params(leaf=leaf, levels=levels)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute_groups(rows, 3, 85)


def test_near_duplicates_other_parameters(spark):
    rows = corpus()[:200]
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), near_dup.Params(words=5, percent=80, pairs=3, pair_bytes=2000)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_groups(rows, 5, 80)
    assert near_dup.groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_full_sets_are_made_of_likely_pairs_only(spark):
    rnd, common = random.Random(8), [f"c{i}" for i in range(300)]
    half = [" ".join(common + [f"w{i}x{j}" for j in range(200)]) for i in range(60)]  # alike enough to meet in nodes, not to link
    alone = [f"v{j}" for j in range(400)]
    near = [" ".join(alone[:k] + [str(rnd.random())] + alone[k + 1 :]) for k in (100, 300)]
    rows = list(enumerate(half + near))
    join = near_dup.Join(spark.createDataFrame(rows, "doc bigint, text string"), near_dup.Params())
    join.grow()
    assert join.full.count() == 2
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: min(i, 60) for i, _ in rows}


def test_components_of_chains(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LOCAL_EDGES", 40)
    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 90)] + [(5, 5)]
    rnd.shuffle(chain)
    got = {r["uid"]: r["label"] for r in near_dup.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(90)}


# --- toxicity ---


def test_network_gradients():
    p = toxicity.Params(length=5, word_dim=3, char_dim=2, hidden=3, attention=2)
    net = toxicity.Network.fresh(p, {"aa": 1, "bb": 2}, np.array([0.5, -0.5], np.float32))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, ids = ["aa", "bb", "cc"], np.array([[1, 3], [2, 1], [3, 0], [1, 0], [0, 0]])
    d = np.array([1.0, -2.0])
    pad = lambda t: np.concatenate([np.zeros((1, t.shape[1])), t])

    def loss():
        x = net.inputs(words)[0].astype(np.float64)
        return net.forward(tuple(map(pad, net.project(x))), ids)[0] @ d

    x = net.inputs(words)[0].astype(np.float64)
    g, _ = net.backward(net.forward(tuple(map(pad, net.project(x))), ids, keep=True)[1], d)
    for k in ("o", "c", "a", "A", "Uf", "Ub"):
        flat = net.w[k].reshape(-1)
        for i in range(min(4, len(flat))):
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[i]) < 1e-3, k


def test_windows_cover_all_words():
    p = toxicity.Params()
    for n in range(0, 200):
        assert {i for s in toxicity.starts(n, p) for i in range(s, s + p.length)} >= set(range(n))


def toxic_corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rnd.randint(5, 150))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vilewx", "nastyq"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*[(i, t, 1.0) for i, t in rows], (None, None, 0.0), (900, "", 0.0), (901, "vilewx " * 30_000, 0.0), (902, "plain abc " * 30_000, 0.0)], "doc_id bigint, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (10**9, 1)], "doc_id bigint, toxic int")
    fitted = toxicity.fit(docs, lab, toxicity.Params(steps=150))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, fitted, ["doc_id"]).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out("doc_id")).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i in held]
    assert len(right) > 50 and np.mean(right) >= 0.95
    assert got[901] >= 0.5 > got[902] and None in got and 0 <= got[900] <= 1
    assert toxicity.score(docs.limit(0), fitted, ["doc_id"]).count() == 0


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none), ["doc_id"], out_col="score").collect()] == [0.0, 0.0]


def test_scores_do_not_depend_on_batches():
    rows, labels = toxic_corpus()
    net, point, slope = toxicity.train([w.split() for _, w in rows[:80]], [y for _, y in labels[:80]], 0.25, toxicity.Params(steps=5, epochs=1))
    scorer = toxicity.Scorer(net, point, slope)
    texts = [t for _, t in rows[:60]] + [None, ""]
    assert np.allclose(scorer(texts), [toxicity.Scorer(net, point, slope)([t])[0] for t in texts], atol=1e-5)


def test_network_equals_plain_loops():
    p = toxicity.Params(length=6, word_dim=3, char_dim=2, hidden=3, attention=2, buckets=31)
    net = toxicity.Network.fresh(p, {"aa": 1, "bb": 2}, np.array([0.5, -0.5], np.float32))
    words, sig = ["aa", "bb", "cc"], lambda x: 1 / (1 + np.exp(-x))
    x = net.inputs(words)[0]
    for k, w in enumerate(words):  # a word's own vector, and the mean of its trigrams' vectors
        c = [ord(a) for a in f" {w} "]
        grams = [net.w["char"][(c[i] * 7919 + c[i + 1] * 104729 + c[i + 2]) % 31] for i in range(len(c) - 2)]
        assert np.allclose(x[k], np.concatenate([net.w["word"][net.vocabulary.get(w, 0)], np.mean(grams, axis=0)]), atol=1e-6)
    window = [1, 3, 2, 2, 0, 0]

    def read(side, seq):
        state, out = np.zeros(3), []
        for i in seq:
            if i:
                a, g = x[i - 1] @ net.w[f"W{side}"] + net.w[f"b{side}"], state @ net.w[f"U{side}"]
                z, r = sig(a[:3] + g[:3]), sig(a[3:6] + g[3:6])
                state = z * state + (1 - z) * np.tanh(a[6:] + r * g[6:])
            out.append(state)
        return out

    states = [np.concatenate(s) for s in zip(read("f", window), read("b", window[::-1])[::-1])]
    e = np.array([np.tanh(s @ net.w["A"]) @ net.w["a"] for s, i in zip(states, window) if i])
    alpha = np.exp(e) / np.exp(e).sum()
    want = sum(a * s for a, s in zip(alpha, states)) @ net.w["o"] + net.w["c"][0]
    pad = lambda t: np.concatenate([np.zeros((1, t.shape[1]), np.float32), t])
    got, _ = net.forward(tuple(map(pad, net.project(x))), np.array(window)[:, None])
    assert abs(got[0] - want) < 1e-4


def test_training_reads_whole_texts_and_repeated_ids_once(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows, labels = [], []
    for i in range(600):  # the word that tells is somewhere in a text of more windows than are learned from
        w = [word() for _ in range(250)]
        if i % 2:
            w[rnd.randrange(len(w))] = "vilewx"
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    docs = spark.createDataFrame(rows + [rows[1]] * 30 + [(1, "another text of that id")], "doc_id bigint, text string")
    fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), toxicity.Params(steps=200))
    got = {r["doc_id"]: r["s"] for r in toxicity.score(docs, fitted, ["doc_id"]).groupBy("doc_id").agg(F.max("score").alias("s")).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out("doc_id")).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in labels if i in held]) >= 0.9
    few = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), toxicity.Params(sample_chars=10))
    assert few == 0.0


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="ads-free"><header class="top"><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="ad">Buy {n}</div>{body}<aside id="sidebar">Side {n}</aside><form><p>Mail</p></form>
<section class="comments"><article class="comment"><p>Nice {n}</p></article></section><footer>&copy; x</footer></body></html>"""


def test_articles(spark):
    art = "<article><header><h1>Head &amp; {n}</h1></header><p><b>Bold  one.<br>two<p>Para\n{n} <i>it</i>alic<ul><li>x<li>y</ul><div class='share-buttons'>Share</div><p>Common passage</p><table><tr><td>1<td>2</table></article>"
    want = "Head & {n}\nBold one. two\nPara {n} italic\nx\ny\nShare\nCommon passage\n1\n2"
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i, body=art.format(n=i)), "x") for i in range(12)]
    rows += [(20, "http://one.org/", PAGE.format(n=1, body=art.format(n=1)), "x"), (21, None, None, "x"), (22, "u", "", "x"), (None, "http://h0.org/", "plain", "x"), (0, *rows[0][1:])]
    rows += [(30 + i, f"http://m.org/{i}", PAGE.format(n=i, body=f"<main><h1>M{i}</h1><p>text {i}</p></main>"), "x") for i in range(4)]
    rows += [(40 + i, f"http://d.org/{i}", PAGE.format(n=i, body=f"<div><p>text {i}</p><p><a href='/x'>more</a></p></div><p>Constant line</p>"), "x") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    for i in [*range(12)]:
        assert got[i]["text"] == want.format(n=i)
    assert got[20]["text"] == want.format(n=1) and got[21]["text"] == got[22]["text"] == "" and got[None]["text"] == "plain"
    assert got[32]["text"] == "M2\ntext 2" and got[43]["text"] == "text 3"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[1]["url"] == "http://h1.org/1"
    assert html_extract.extract(df, html_extract.Params(broadcast_hosts=0)).count() == len(rows)
    assert html_extract.extract(df.limit(0)).count() == 0


def brute_template(pages, p):
    """Equal vectors, one order, nesting: the definitions, over pairs and by exhaustive search."""
    words = html_extract.Words()
    toks = [html_extract.tokens(html_extract.read(x), words)[0].tolist() for x in pages]
    vector = collections.defaultdict(lambda: [0] * len(toks))
    for n, ts in enumerate(toks):
        for t in ts:
            vector[t][n] += 1
    classes = collections.defaultdict(set)
    for t, v in vector.items():
        seen = sum(x > 0 for x in v)
        if seen >= p.pages and seen > p.share * len(toks):
            classes[tuple(v)].add(t)
    out = []
    for v, members in classes.items():
        mean = sorted(members, key=lambda t: (sum(ts.index(t) for ts, n in zip(toks, v) if n), html_extract._signed(t)))
        place, bad = {t: i for i, t in enumerate(mean)}, set()
        for ts in toks:
            row = [place[t] for t in ts if t in members]
            for k in range(max(collections.Counter(row).values(), default=0)):
                turn = [i for j, i in enumerate(row) if row[: j + 1].count(i) == k + 1]
                best = [[i] for i in turn]  # longest increasing run, quadratic
                for j in range(len(turn)):
                    best[j] = max([best[h] + [turn[j]] for h in range(j) if turn[h] < turn[j]] + [[turn[j]]], key=len)
                longest = max(map(len, best))
                if longest < len(turn):
                    bad |= set(turn) - html_extract.longest_run(turn)
                    assert len(html_extract.longest_run(turn)) == longest
        left = [t for i, t in enumerate(mean) if i not in bad]
        if len(mean) >= p.size and len(left) >= p.size and all((row := [t for t in ts if t in set(left)]) == left * (len(row) // len(left)) for ts in toks):
            out.append((sum(x > 0 for x in v), left))

    def spans(c, ts):
        at = [i for i, t in enumerate(ts) if t in set(c)]
        return [at[i : i + len(c)] for i in range(0, len(at), len(c))]

    def nests(c, d):
        for one, other in ((c, d), (d, c)):
            gaps = set()
            for ts in toks:
                for s in spans(one, ts):
                    holds = [sum(s[0] > x for x in o) for o in spans(other, ts) if o[0] < s[0] < o[-1]]
                    if any(o[0] < s[0] < o[-1] < s[-1] or any(s[0] < x < s[-1] for x in o) and o[0] < s[0] for o in spans(other, ts)):
                        return False
                    gaps.add(holds[0] if holds else None)
            if len(gaps) > 1:
                return False
        return True

    kept = []
    for _, c in sorted(out, key=lambda x: (-x[0], -len(x[1]), [html_extract._signed(t) for t in x[1]])):
        if all(nests(c, d) for d in kept):
            kept.append(c)
    return {tuple(html_extract._signed(t) for t in c) for c in kept}


@pytest.mark.parametrize("cell", [500, 4])
def test_template_equals_brute_force(spark, cell):
    rnd = random.Random(11)
    word = lambda: rnd.choice(["sun", "moon", "star", "sky", "rain", "wind"])
    lists = lambda n: "".join(f"<ul><li><a>more</a> <i>{word()}</i></li></ul>" for _ in range(n))
    rows = []
    for n in range(9):
        body = "".join(f"<p>{' '.join(word() for _ in range(rnd.randint(1, 12)))}</p>" for _ in range(rnd.randint(1, 4)))
        swapped = "<b></b><u></u><s></s>" if n % 2 else "<s></s><u></u><b></b>"
        rows.append(("h", f"<html><body><div class=x><h1>Title {word()}</h1>{body}</div>{swapped}<div class=y>{lists(1 + n % 3)}</div><p>always the same</p></body></html>"))
    rows += [rows[0]] * 2
    p = html_extract.Params(cell_pages=cell, pages=3)
    got = html_extract.templates(spark.createDataFrame(rows, "host string, html string"), p).first()
    want = brute_template([h for _, h in rows], p)
    assert {tuple(c) for c in got["classes"]} == want and len(want) >= 2
    marks = {html_extract._signed(i[1]) for i in html_extract.read(rows[0][1]) if i[0] == html_extract.START and i[2][1] in ("s", "b")}
    assert len(marks) == 2 and not marks <= {t for c in got["classes"] for t in c}  # of tokens that swap places not both stay


def test_slots_decide_where_no_name_tells(spark):
    page = lambda n: f"<html><body><div class=a><a href=/>Home</a><a href=/x>News</a></div><div class=b><div class=c>by {n}</div><div class=d><p>own text {n} goes on {n * n} for long</p><p>All rights</p><p>one more {n}</p></div></div><div class=e>foot</div></body></html>"
    rows = [(i, "http://h.org/x", page(i)) for i in range(40)] + [(90, "http://h.org/x", page(3)), (91, "http://h.org/y", "<html><body><p>other layout</p></body></html>")]
    for cell in (500, 10):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), html_extract.Params(cell_pages=cell, broadcast_hosts=cell - 10)).collect()}
        assert got[3] == got[90] == "own text 3 goes on 9 for long\none more 3" and got[91] == "other layout"


def test_articles_keep_all_that_is_theirs():
    text = lambda s: html_extract.tags_text(html_extract.read(s))
    assert text("<article><p>a</p><math><mi>x</mi></math><div class='search-engines'><p>On search</p></div><noscript><p>n</p></noscript><ul><li><a>link</a></ul></article><nav>no</nav>") == "a\nx\nOn search\nn\nlink"
    assert text("<div class=ad>Buy</div><p>text <a>with link</a></p><ul><li><a>menu</a></ul>") == "text with link"


def test_broken_markup_is_read():
    read = lambda s: html_extract.tags_text(html_extract.read(s))
    assert read("<article><p>a<p>b<!-- open") == "a\nb"
    assert read("<article><p title='a>b'>x</p><p a=\"un<b>y</b></p>").startswith("x\n")
    assert read("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p></article>") == "deep\nafter"
    assert read("<article><p>1 < 2 &lt; 3</p></article>") == "1 < 2 < 3"
    assert len(read("<article>" + '<p a="' * 20_000)) >= 0


# --- the pipeline ---


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0)], docs.schema))
    kept = cp.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if r[3]}
    got = collections.Counter(r["doc_id"] for r in kept.collect())
    assert set(got) == want | {None} and max(got.values()) == 1
    red = cp.redact_personal_data(spark, kept, SMALL)
    assert red.columns == docs.columns and red.count() == kept.count()
    assert red.where("text like '%@%.%' and text rlike '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
    assert red.where("n_chars <> length(text)").count() == 0
    mix = cp.mix_to_weights(spark, red, SMALL)
    assert mix.columns == docs.columns
    out = cp.encode(spark, mix, SMALL)
    assert out.count() == mix.count() and out.where("size(ids) = 0").count() == mix.where("coalesce(text, '') = ''").count()
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "sentencepiece"]


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = ["toxicity_score", "uid", "label", "kept_id", "nth", "node", "c", "rate", "t", "ids", "_likely"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, F.lit(7))
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0), (10**6, "", "en", None, 0), (3 * 10**6, "alpha beta gamma delta epsilon zeta", "en", "s", 0), (3 * 10**6, "one two three four five six seven", "en", "s", 0)], docs.schema)
    for n in names:
        extra = extra.withColumn(n, F.lit(7))
    wide = wide.unionByName(wide.limit(9)).unionByName(extra)
    (tmp_path / "a").mkdir()
    wide.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    kept = cp.drop_near_duplicates(spark, wide, SMALL)
    assert kept.columns == wide.columns and kept.where("doc_id = 3000000").count() == 2  # two texts of one id, linked with nothing
    assert max(collections.Counter(r["doc_id"] for r in kept.where("text <> '' and doc_id <> 3000000").collect()).values()) == 1
    out = cp.run(spark, str(tmp_path / "a")).collect()
    assert len(out) > 50 and all(r["ids"] is not None for r in out)
    (tmp_path / "b").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "b")).count() == 0


def test_toxic_documents_go(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = cp.drop_toxic(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").join(out.select("doc_id", F.lit(1).alias("stays")), "doc_id", "left")
    share = {r["toxic"]: r["s"] for r in labels.groupBy("toxic").agg(F.avg(F.coalesce("stays", F.lit(0))).alias("s")).collect()}
    assert share[0] > 0.97 and share[1] < 0.4


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_templates_do_not_depend_on_cells(spark):
    rnd = random.Random(3)
    part = lambda i: f"<div class=k{i}><b>part {i}</b><i></i></div>"
    page = lambda n: "<html><body>" + "".join(part(i) for i in range(6) if rnd.random() < (1, 0.9, 0.75, 0.6, 0.55, 0.5)[i]) + f"<div class=text><p>own {n} words {n * n}</p></div></body></html>"
    rows = [(host, page(n)) for host, many in (("a", 24), ("b", 41), ("c", 7)) for n in range(many)] + [("d", "<html><body><p>one</p><p>copy</p></body></html>")] * 9
    df = spark.createDataFrame(rows, "host string, html string")
    pages = spark.createDataFrame([(7 if host == "d" else n, f"http://{host}/", h) for n, (host, h) in enumerate(rows)], "page_id bigint, url string, html string")
    got, texts = [], []
    for p in ({}, {"cell_pages": 6}, {"cell_pages": 2}, {"cell_chars": 300}):
        found = html_extract.templates(df, html_extract.Params(**p)).collect()
        got.append({r["host"]: (r["classes"], r["held"], r["weighed"]) for r in found})
        texts.append(sorted((r["url"], r["page_id"], r["text"]) for r in html_extract.extract(pages, html_extract.Params(**p)).collect()))
    assert set(got[0]) == set("abcd") and all(x == got[0] for x in got)
    assert len(texts[0]) == len(rows) and all(x == texts[0] for x in texts)
