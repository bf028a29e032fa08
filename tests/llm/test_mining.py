"""Collocations, shared passages and conversation repair against brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F

from quire.llm import collocations, common, conversations, registry, substrings


@pytest.mark.parametrize("name", ["op11_collocations", "op12_substring_dedup", "op13_conversation_repair"])
def test_matches_sql(spark, duck, name):
    same(spark, duck, name, registry.QUERIES, registry.ORACLE)


# --- collocations ---


def phrases(rows, p):
    """{(lang, phrase): (a, l, r, n, score)} of candidates that stay, by definition."""
    count, words = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, p.most_words + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    out = {}
    for (lang, w), a in count.items():
        inside = lambda b: any(b[i : i + len(w)] == w for i in range(len(b) - len(w) + 1))  # noqa: B023, E731
        if len(w) < 2 or a < p.least or any(g == lang and len(b) > len(w) and c >= p.least and inside(b) and 100 * c >= p.covered * a for (g, b), c in count.items()):
            continue
        cut = min((10**6 * a * a // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang, " ".join(w)] = (a, count[lang, w[: cut[1]]], count[lang, w[cut[1] :]], words[lang], cut[0])
    return out


def sentences(rnd, n):
    stock = ["red fox", "the red fox runs", "New York", "of the", "a\tb", "é ß", "x y z x y z", "THE"]
    return [(rnd.choice(["en", "de", None]), rnd.choice([None, ""] + [" ".join(rnd.choice(stock) + rnd.choice(["", ".", ",", "\n", "\x0b", " "]) for _ in range(rnd.randint(1, 12)))] * 8)) for _ in range(n)]


@pytest.mark.parametrize(("most", "block"), [(3, 7), (3, 10**6), (4, 100), (2, 50)])
def test_collocations_equal_brute_force(spark, most, block):
    rows, p = sentences(random.Random(1), 120), collocations.Params(most_words=most, least=4, block=block)
    df = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(df, p).collect()}
    assert got == phrases(rows, p) and len(got) > 10


def test_collocations_rank_ties_by_bytes(spark):
    texts = [("en", f"{a} {b}") for a, b in (("é", "b"), ("z", "b2"), ("😀", "b3"), ("ﬀ", "b4"))] * 3
    df = spark.createDataFrame(texts, "lang string, text string")
    got = collocations.collocations(df, collocations.Params(least=3, top=3)).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in got] == [(1, "z b2", 10**6), (2, "é b", 10**6), (3, "ﬀ b4", 10**6)]
    assert collocations.collocations(df.limit(0)).count() == 0
    none = df.select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("text"))
    assert collocations.collocations(none).count() == 0


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 11)
    text = b"one two three. four  five\tsix," * 9
    whole = [w for part in collocations._tokens(text) for w in part]
    assert whole == text.translate(collocations._MAP).replace(b".", b" . ").split()


def test_scores_past_64_bits_are_exact(spark):
    one = spark.sql("select cast(3000000000000 as bigint) a, cast(4000000000000 as bigint) l, cast(5000000000001 as bigint) r")
    assert one.selectExpr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r) as s").first()[0] == 10**6 * 9 * 10**24 // (4 * 10**12 * 5000000000001)


# --- keys and bitmaps ---


def test_bitmap_has_all_its_keys(spark):
    keys = spark.range(-500, 5000, 7).select(F.xxhash64("id").alias("k"))
    found = common.Bitmap(keys, "k")
    import numpy as np

    own = np.array([r[0] for r in keys.collect()]).view(np.uint64)
    assert found.has(own).all() and found.bits >= 16 * len(own)
    others = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert found.has(others).mean() < 0.1
    assert not common.Bitmap(keys.limit(0), "k").has(own).any() and common.bits_for(10**12) == common.BITS


def test_lookup_keeps_all_rows_of_hot_keys(spark):
    left = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 1, id) as k")
    right = left.groupBy("k").agg(F.count("*").alias("uses")).withColumn("v", -F.col("k"))
    got = common.lookup(left, right, ["k"], "uses")
    assert got.columns == ["k", "id", "v"] and got.where("v = -k").select("id").distinct().count() == 6000 == got.count()


# --- shared passages ---


def cut_by_hand(rows, k):
    """[(doc, words, removed, kept)] with every window compared."""
    least = {}
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - k + 1) if d is not None else ():
            s = tuple(w[i : i + k])
            least[s] = min(least.get(s, d), d)
    out = []
    for d, w in texts:
        gone = {j for i in range(len(w) - k + 1) if d is not None and least[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def passages(rnd, n, k):
    stock = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(k - 2, 4 * k))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(stock) if rnd.random() < 0.4 else " ".join(rnd.choice(["x", "y", "é", "zz" * 50]) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.choice([i, i, i, i // 2, None]), rnd.choice(["  ", "\n", "\t"]).join(parts)))
    return rows + rows[:5] + [(3, None), (4, ""), (10**12, "w " * 400), (-7, "w " * 40), (5, " ".join("uvw"))]


@pytest.mark.parametrize(("words", "seed", "block"), [(13, 5, 10**6), (13, 5, 60), (6, 6, 10**6), (7, 1, 90), (1, 1, 10**6)])
def test_removal_equals_every_window_compared(spark, words, seed, block):
    rows = passages(random.Random(words), 150, words)
    p = substrings.Params(words=words, seed=seed, block=block)
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id bigint, text string, doc int, kept string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substrings.remove(df, p).collect()), key=str)
    want = cut_by_hand(rows, words)
    assert got == want and sum(r[2] for r in want) > 100
    spans = substrings.repeats(df, p).collect()
    assert sum(r["end"] - r["start"] for r in spans) == sum(r[2] for r in want)
    assert substrings.remove(df.limit(0), p).count() == 0


def test_words_and_windows_are_hashed_by_content():
    import numpy as np

    begin, first, second = substrings._words(np.frombuffer(b" ab cd ab\n" + b"q" * 300 + b" " + b"q" * 301, dtype=np.uint8))
    assert begin.tolist() == [1, 4, 7, 10, 311] and first[0] == first[2] and second[0] == second[2] and len(set(first.tolist())) == 4
    values = np.arange(40, dtype=np.uint64) % np.uint64(9)
    for k in (1, 2, 5, 13):
        rolled = substrings._rolled(values, k)
        assert len(rolled) == 40 - k + 1
        for i, j in itertools.combinations(range(len(rolled)), 2):
            assert (rolled[i] == rolled[j]) == (values[i : i + k].tolist() == values[j : j + k].tolist())


# --- conversations ---


def cheapest(rows):
    """(cost, audit) over rows (initial, fault) by trying all edits."""

    @functools.cache
    def best(i, state, inserted):
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        needed = "a" if state == "u" else "u"
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        add = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        if inserted < 3:
            add(3, "I", best(i, needed, inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            add(4, "D", best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                add(3 + extra, "R", best(i + 1, needed, 0))
                if initial in step:
                    add(extra, "K", best(i + 1, step[initial], 0))
        return min(found, default=None)

    return best(0, "", 0)


def repaired(conv, rows, damage):
    """The query's row of one conversation, step by step."""
    name = lambda x: " " if x is None else str(x)
    kept = []
    for turn, role, text in rows:
        d = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 9
        role, text = name(role), name(text)
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in kept:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        marked.append((role[:1], "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = [t for t, _, _ in kept if t is not None]
    cost, audit = cheapest(tuple(marked))
    out, i, state = [], 0, ""
    for e in audit:
        needed = "assistant" if state == "u" else "user"
        role, text = ("", "") if e == "I" else kept[i][1:]
        i += e != "I"
        if e != "D":
            role = role if e == "K" else needed
            out.append(f"{role}:{text}")
            state = role[:1]
    count = collections.Counter(f for _, f in marked)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def talks(rnd, n):
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
    text = lambda: rnd.choice(["Yes.", "No!", "what", "  ", "", None, "a?\n ", "é…", "x. y", " "])
    return {c: [(rnd.choice([None, *range(9)]), role(), text()) for _ in range(rnd.randint(1, 9))] for c in [None, *range(n)]}


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("damage", [False, True])
def test_repair_equals_trying_all_edits(spark, damage):
    by = talks(random.Random(damage), 80)
    rows = [(c, *r, 1, "s") for c, of in by.items() for r in of]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, kind int, signature string").repartition(3)
    df = conversations.damage(df) if damage else df
    got = [tuple(r[c] for c in COLUMNS) for r in conversations.audits(df).collect()]
    assert sorted(got, key=str) == sorted((repaired(c, of, damage) for c, of in by.items()), key=str)
    whole = conversations.repair(df).orderBy("conv_id", "position").collect()
    for c, group in itertools.groupby(whole, key=lambda r: r["conv_id"]):
        roles = "".join(r["role"][:1] for r in group)
        assert re.fullmatch("(s?(ua)+)?", roles), (c, roles)


def test_signatures_of_all_kinds():
    for sig in ("", "d", "s", "S", "ua", "uu", "au", "xx", "suaUAd", "aasd", "UuAaXx", "ssua"):
        fault = lambda c: "blank" if c == "d" else "truncated" if c.isupper() else ""
        assert conversations.solve(sig) == cheapest(tuple((c.lower(), fault(c)) for c in sig)), sig
    cost, audit = conversations.solve("uaUAdx" * 20_000)
    assert len(audit) >= 120_000 and cost > 0


def test_conversations_of_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.audits(empty).count() == 0 and conversations.repair(empty).count() == 0
    gone = spark.createDataFrame([("a", 1, "user", "x.", True)], "conv_id string, turn int, role string, text string, gone boolean")
    assert [tuple(r) for r in conversations.audits(gone).collect()] == [("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_all_thirteen_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert registry.QUERIES["op13_conversation_repair"] is conversations.op13_conversation_repair and SMALL
