"""Styled spans of dictionary HTML against a plain stack and hand-made definitions."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import spans

SHAPE = ["text", "bold", "italic", "underline", "strike", "indent", "item", "newline"]


def told(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string").repartition(2)
    rows = spans.styled_spans(df, ["id"]).orderBy("id", "span").collect()
    return [[tuple(r[c] for c in SHAPE) for r in rows if r["id"] == i] for i in range(len(pages))]


def stacked(html):
    """The spans of well nested HTML by a stack."""
    out, stack, style = [], [], dict.fromkeys(("b", "i", "u", "s", "q"), 0)
    pending, newline, item, away = "", False, False, 0
    sets = {"b": "b", "strong": "b", "code": "b", "h1": "b", "i": "i", "em": "i", "u": "u", "s": "s", "li": "q", "blockquote": "q"}

    def push():
        nonlocal pending, newline, item
        if pending:
            out.append((pending, style["b"] > 0, style["i"] > 0, style["u"] > 0, style["s"] > 0, style["q"], item, newline))
            pending, newline, item = "", False, False

    for t in re.findall(r"<[^>]*>|\n|[^<\n]+", html):
        name = t.strip("</>").split(" ")[0].lower()
        if not t.startswith("<"):
            if away:
                continue
            if t == "\n":
                push()
                newline = True
            else:
                pending += t
        elif name == "br":
            if not away:
                push()
                newline = True
        elif t.startswith("</"):
            stack.pop()
            if away:
                away -= 1
                continue
            push()
            if name in ("p", "div", "ul", "h1", "blockquote"):
                newline = True
            if name in sets:
                style[sets[name]] -= 1
        else:
            stack.append(name)
            if away or name == "svg":
                if not away:
                    push()
                away += 1
                continue
            if name in (*sets, "p", "div", "ul", "sup"):
                push()
            if name in ("p", "div", "ul", "h1", "blockquote", "li"):
                newline = True
            item = item or name == "li"
            if name in sets:
                style[sets[name]] += 1
    push()
    return out


def nested(rnd, depth=0):
    parts = []
    for _ in range(rnd.randint(1, 4)):
        k = rnd.random()
        if k < 0.45 or depth > 4:
            parts.append(rnd.choice(["ab ", "c", "\n", "d e", "x\ny"]))
        elif k < 0.55:
            parts.append(rnd.choice(["<br>", "<br/>"]))
        else:
            tag = rnd.choice(["b", "strong", "i", "em", "u", "s", "code", "p", "div", "ul", "li", "h1", "blockquote", "span", "sup", "svg", "font", "td"])
            parts.append(f"<{tag}>{nested(rnd, depth + 1)}</{tag}>")
    return "".join(parts)


def test_spans_equal_a_stack(spark):
    rnd = random.Random(3)
    pages = [nested(rnd) for _ in range(120)]
    assert told(spark, *pages) == [stacked(p) for p in pages]


def test_spans_of_odd_definitions(spark):
    plain, bold = (False,) * 4, (True, False, False, False)
    got = told(spark, None, "", "a<b>b", "</b>a</i>", "<abbr title='long &amp; x'>s</abbr>.", "<t:word>hidden</t:word>!", 'x<img src="a>b">y', "1 < 2 &lt;&#9632;\t&zzz;&#x41;&nbsp;&#xD800;", "<!-- c -->t\r\nu", "<abbr title='o'>a<abbr title='i'>b</abbr></abbr>")
    assert got[:2] == [[], []]
    assert got[2] == [("a", *plain, 0, False, False), ("b", *bold, 0, False, False)]
    assert got[3] == [("a", *plain, 0, False, False)]
    assert [s[0] for s in got[4]] == ["s", " (long & x)", "."] and [s[0] for s in got[5]] == ["word", "!"]
    assert [s[0] for s in got[6]] == ["xy"] and [s[0] for s in got[7]] == ["1 < 2 <• &zzz;A &#xD800;"]
    assert [(s[0], s[-1]) for s in got[8]] == [("t", False), ("u", True)]
    assert [s[0] for s in got[9]] == ["a", "b", " (i)", " (o)"]


def test_spans_put_together_are_the_plain_text(spark):
    rnd = random.Random(8)
    pages = [re.sub("svg", "u", nested(rnd)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = spans.styled_spans(df, ["id"])
    piece = F.concat(F.when(F.col("newline"), "\n").otherwise(""), "text")
    joined = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", piece.alias("t")))), lambda s: s["t"]), "").alias("joined"), F.max("end").alias("end"), F.sum(F.length("text")).alias("n"))
    both = df.select("id", markup.plain_text(F.regexp_replace("html", "</?(?:blockquote)>", "<br>")).alias("plain")).join(joined, "id", "left").collect()
    for r in both:
        assert "".join((r["joined"] or "").split()) == "".join(r["plain"].split()) and r["end"] == r["n"]


def test_definitions_are_dealt_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARE", 10)
    rows = spark.createDataFrame([(i, "<b>x</b> y") for i in range(12)] + [(12, None)], "k int, html string")
    assert spans.dealt(rows, ["k"], "html").rdd.getNumPartitions() == 12
    assert spans.dealt(rows.limit(0), ["k"], "html").rdd.getNumPartitions() == 4
    got = sorted((r["k"], r["span"], r["text"], r["bold"]) for r in spans.styled_spans(rows, ["k"]).collect())
    assert got == sorted(x for i in range(12) for x in ((i, 0, "x", True), (i, 1, " y", False)))
