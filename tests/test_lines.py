"""Lines with parted words against all ways of breaking."""

import functools
import random

from pyspark.sql import functions as F

from quire.functions import layout

PATTERNS = ["1ti", "1ta", "1na", "a1b"]


def fewest(words, width):
    """The least number of lines over all ways of breaking at the places that patterns allow."""
    h, room = layout.Hyphenator(PATTERNS, 2, 3), width - 1
    pieces = []
    for w in words:
        at = [0, *[i for i in h.positions(w) if 0 < i < len(w)], len(w)]
        parts = [w[a:b] for a, b in zip(at, at[1:], strict=False)]
        cut = [(p[i : i + room], i + room >= len(p)) for p in parts for i in range(0, len(p), room)]
        pieces += [(t, k == 0, k == len(cut) - 1, soft and not t.endswith("-")) for k, (t, soft) in enumerate(cut)]

    @functools.cache
    def best(i):
        if i == len(pieces):
            return 0
        found, line = [], ""
        for j in range(i, len(pieces)):
            t, first, last, soft = pieces[j]
            line += (" " if line and first else "") + t
            if j > i and len(line) > width:
                break
            if len(line) + (soft and not last) <= width:
                found.append(1 + best(j + 1))
        return min(found) if found else 10**6

    return best(0)


def test_greedy_lines_are_the_fewest(spark):
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choice(["ti", "ta", "na", "b", "ab", "xy", "-"]) for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n ")], "i int, t string")
    for width in (7, 12, 30):
        got = {r["i"]: r["lines"] for r in df.select("i", layout.hyphenated_lines(F.col("t"), width, PATTERNS).alias("lines")).collect()}
        for i, t in enumerate(texts):
            lines = got[i]
            assert all(len(x) <= width for x in lines) and len(lines) == fewest(tuple(t.split()), width), (t, lines)
            assert sorted("".join(lines).replace("-", "").replace(" ", "")) == sorted(t.replace("-", "").replace(" ", ""))
        assert got[900] is None and got[901] == [] and got[902] == []


def test_parted_words(spark):
    one = lambda t, w: spark.createDataFrame([(t,)], "t string").select(layout.hyphenated_lines(F.col("t"), w, PATTERNS)).first()[0]
    assert one("bananatita go", 8) == ["banana-", "tita go"] and one("well-known xx", 8) == ["well-", "known xx"] and one("abcdefghij", 5) == ["abcd", "efgh", "ij"]
