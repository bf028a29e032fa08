"""Both directions against the standard's own examples and its rules on random lines."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import bidi

#: Capitals stand for letters that run right to left.
HEBREW = {c: chr(0x5D0 + i) for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
BACK = {v: k for k, v in HEBREW.items()}


def seen(text, base):
    return "".join(BACK.get(c, c) for c in bidi.reordered("".join(HEBREW.get(c, c) for c in text), base))


@pytest.mark.parametrize(
    ("text", "base", "want"),
    [
        ("car means CAR.", 0, "car means RAC."), ("car MEANS CAR.", 1, ".RAC SNAEM car"), ('he said "THE VALUES ARE 123, 456, 789, OK".', 0, 'he said "KO ,789 ,456 ,123 ERA SEULAV EHT".'),
        ("IT IS A bmw 500, OK.", 1, ".KO ,bmw 500 A SI TI"), ("AB 12-3 CD", 1, "DC 12-3 BA"), ("A $5 B", 1, "B $5 A"), ("a (B) c", 0, "a (B) c"), ("A (b) C", 1, "C (b) A"), ("AB(CD)e", 0, "(DC)BAe"), ("x AB  ", 0, "x BA  "),
        ("ab", 0, "ab"), ("", 0, ""), ("12 AB", 0, "12 BA"), ("A1B", 0, "B1A"),
    ],
)
def test_examples(text, base, want):
    assert seen(text, base) == want


def by_rules(text, base):
    """Levels by the rules, each a pass over whole lists with its neighbours looked up anew."""
    side, n = "R" if base else "L", len(text)
    t = [unicodedata.bidirectional(c) for c in text]
    strong = lambda i, of: next((t[k] for k in range(i - 1, -1, -1) if t[k] in of), side)
    for i in range(n):
        if t[i] == "NSM":
            t[i] = t[i - 1] if i else side
    en = [i for i in range(n) if t[i] == "EN" and strong(i, ("L", "R", "AL")) == "AL"]
    t = ["AN" if i in en else x for i, x in enumerate(t)]
    t = ["R" if x == "AL" else x for x in t]
    for i in range(1, n - 1):
        if t[i - 1] == t[i + 1] == "EN" and t[i] in ("ES", "CS") or t[i - 1] == t[i + 1] == "AN" and t[i] == "CS":
            t[i] = t[i - 1]
    for _ in range(n):  # signs become numbers next to numbers, one by one
        t = ["EN" if x == "ET" and ((i and t[i - 1] == "EN") or (i + 1 < n and t[i + 1] == "EN")) else x for i, x in enumerate(t)]
    t = ["ON" if x in ("ES", "ET", "CS", "WS", "S", "B") else x for x in t]
    t = ["L" if x == "EN" and strong(i, ("L", "R")) == "L" else x for i, x in enumerate(t)]
    way = lambda i: None if t[i] == "ON" else "L" if t[i] == "L" else "R"
    left = [next((way(k) for k in range(i, -1, -1) if way(k)), side) for i in range(n)]
    right = [next((way(k) for k in range(i, n) if way(k)), side) for i in range(n)]
    t = [(left[i] if left[i] == right[i] else side) if x == "ON" else x for i, x in enumerate(t)]
    out = [base + ({"L": 0, "R": 1}.get(x, 2) if not base else {"L": 1, "R": 0}.get(x, 1)) for x in t]
    end = len(text.rstrip(" "))
    return out[:end] + [base] * (n - end)


def test_levels_equal_the_rules():
    rnd = random.Random(7)
    for _ in range(3000):
        text = "".join(rnd.choice("aאבا١12 +-$,.!:/́") for _ in range(rnd.randint(0, 12)))
        for base in (0, 1):
            assert bidi.levels(text, base) == by_rules(text, base), (text, base)
            assert sorted(bidi.reordered(text, base)) == sorted(text)


def test_letters_join(spark):
    beh, alef, lam, dal = "بالد"
    assert bidi.joined(beh + beh + beh) == "ﺑﺒﺐ" and bidi.joined(dal + beh) == "ﺩﺏ" and bidi.joined(beh + dal) == "ﺑﺪ"
    assert bidi.joined(lam + alef) == "ﻻ" and bidi.joined(beh + lam + alef) == "ﺑﻼ" and bidi.joined(beh + "َ" + beh) == "ﺑَﺐ"
    df = spark.createDataFrame([("ab",), (None,), ("",), ("12 אב\nגד",), (beh + beh,)], "t string")
    got = [r[0] for r in df.select(bidi.visual_order(F.col("t"))).collect()]
    assert got == ["ab", None, "", "בא 12\nדג", "ﺐﺑ"]
    assert df.select(bidi.line_levels(F.col("t"))).collect()[3][0] is not None
