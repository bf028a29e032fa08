"""Words on lines and pages: wrapping, breaking, hyphenation, normal forms, image classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form; texts without combining marks are passed through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def wrap_text(text: str, width: int) -> list[str]:
    lines = []
    for para in text.replace("\r\n", "\n").split("\n"):
        line = ""
        for word in para.split(" "):
            while len(word) > width:  # a word longer than a line is cut
                if line:
                    lines.append(line)
                    line = ""
                lines.append(word[:width])
                word = word[width:]
            if line and len(line) + 1 + len(word) > width:
                lines.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        lines.append(line)
    return lines


@F.pandas_udf(T.ArrayType(T.StringType()))
def wrap(text: pd.Series, width: pd.Series) -> pd.Series:
    """Greedy lines of at most ``width`` characters; line ends of the text stay."""
    return pd.Series([wrap_text(t or "", int(w)) for t, w in zip(text, width, strict=True)])


def best_ends(widths: list[int], width: int) -> list[int]:
    """Ends (exclusive) of lines with the least sum of squared slack, the last line free; ties take the longer line."""
    n = len(widths)
    cost, end = [0.0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        best, used = None, -1
        for j in range(i, n):
            used += widths[j] + 1
            if used > width and j > i:
                break
            slack = 0.0 if j == n - 1 else float(max(0, width - used)) ** 2
            total = slack + cost[j + 1]
            if best is None or total <= best:
                best, end[i] = total, j + 1
        cost[i] = best
    out, i = [], 0
    while i < n:
        i = end[i]
        out.append(i)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def best_breaks(widths: pd.Series, width: pd.Series) -> pd.Series:
    """Ends of lines (see ``best_ends``); null where there are no widths, a null width is 0."""
    return pd.Series([None if w is None else best_ends([0 if x is None or x != x else int(x) for x in w], int(n)) for w, n in zip(widths, width, strict=True)])


class Hyphenator:
    """Liang's algorithm over patterns such as "hy3ph" (digits between letters, "." at a word's end)."""

    def __init__(self, patterns: list[str], before: int = 2, after: int = 3):
        self.before, self.after, self.known = before, after, {}
        for p in patterns:
            letters, levels = "", [0]
            for c in p:
                if c.isdigit():
                    levels[-1] = int(c)
                else:
                    letters += c
                    levels.append(0)
            self.known[letters] = levels
        self.longest = max(map(len, self.known), default=0)

    def positions(self, word: str) -> list[int]:
        """Where a word may break. Its own hyphens come first, then apostrophes part it, then patterns decide."""
        if "-" in word:
            return [i + 1 for i, c in enumerate(word) if c == "-" and 0 < i < len(word) - 1]
        out, start = [], 0
        for part in word.replace("’", "'").split("'"):
            out += [start + i for i in self._plain(part)]
            start += len(part) + 1
        return out

    def _plain(self, word: str) -> list[int]:
        marked = f".{word.lower()}."
        level = [0] * (len(marked) + 1)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + self.longest) + 1):
                for k, v in enumerate(self.known.get(marked[i:j], ())):
                    level[i + k] = max(level[i + k], v)
        return [i for i in range(self.before, len(word) - self.after + 1) if level[i + 1] % 2]


# Primary language tags that are hyphenated, and the least letters before and after a break.
LANGUAGES = {"en": (3, 3), "fr": (2, 2), "de": (2, 2), "ru": (2, 2), "es": (2, 2), "it": (2, 2), "pl": (2, 2), "pt": (2, 2), "sv": (2, 2), "uk": (2, 2)}


def hyphenator(tag: str | None, patterns: dict[str, list[str]]) -> Hyphenator | None:
    """The hyphenator of a language tag ("en-GB" is "en") with the caller's patterns by primary tag; None where there is none."""
    primary = (tag or "").replace("_", "-").split("-")[0].lower()
    return Hyphenator(patterns[primary], *LANGUAGES[primary]) if primary in LANGUAGES and primary in patterns else None


def hyphenate(word: Column, patterns: list[str], before: int = 2, after: int = 3) -> Column:
    """array<int>: break positions of each word by the given patterns."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        h = Hyphenator(patterns, before, after)
        known: dict[str, list[int]] = {w: h.positions(w) for w in s.dropna().unique()}
        return s.map(lambda w: None if w is None else known[w])

    return run(word)


def hyphenated_lines(text: Column, width: int, patterns: list[str], before: int = 2, after: int = 3) -> Column:
    """array<string>: greedy lines of at most ``width`` characters whose last word may be parted where patterns and its own hyphens allow.

    A word that does not fit leaves its longest beginning that fits with a hyphen, which its own hyphens need no second of. Pieces that no
    line can hold with a hyphen are cut one short of the width. White space parts words; null texts give null, empty ones no line. So no breaking at these
    places has fewer lines. The lines are folded from the words' pieces, in the engine.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    places = break_places(words, patterns, before, after)
    cut = lambda w, at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.substring(w, F.element_at(at, i) + 1, F.element_at(at, i + 1) - F.element_at(at, i)))
    room = max(1, width - 1)
    hard = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / room).cast("int")), lambda i: F.substring(p, i * room + 1, F.lit(room)))

    def pieces(w: Column, at: Column) -> Column:
        """A word's pieces: (text, whether it begins the word, whether it ends it, whether a hyphen has to follow where it is parted)."""
        whole = F.concat(F.array(F.lit(0)), F.filter(at, lambda i: (i > 0) & (i < F.length(w))), F.array(F.length(w)))
        soft = F.transform(cut(w, whole), lambda p: F.when(F.length(p) <= room, F.array(p)).otherwise(hard(p)))
        flat = F.flatten(F.transform(soft, lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("t"), ((i == F.size(ps) - 1) & ~p.endswith("-")).alias("soft")))))
        return F.transform(flat, lambda p, i: F.struct(p["t"].alias("t"), (i == 0).alias("first"), (i == F.size(flat) - 1).alias("last"), p["soft"].alias("soft")))

    every = F.flatten(F.zip_with(words, places, pieces))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(False).alias("soft"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["line"] == "", p["t"]).otherwise(F.concat(a["line"], F.when(p["first"], " ").otherwise(""), p["t"]))
        hyphen = p["soft"] & ~p["last"]
        fits = (a["line"] == "") | (F.length(joined) + hyphen.cast("int") <= width)
        done = F.concat(a["line"], F.when(~p["first"] & a["soft"], "-").otherwise(""))
        return F.struct(F.when(fits, a["lines"]).otherwise(F.concat(a["lines"], F.array(done))).alias("lines"), F.when(fits, joined).otherwise(p["t"]).alias("line"), hyphen.alias("soft"))

    return F.aggregate(every, start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def break_places(words: Column, patterns: list[str], before: int, after: int) -> Column:
    """array<array<int>>: where each word of an array may break."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(s: pd.Series) -> pd.Series:
        h, known = Hyphenator(patterns, before, after), {}

        def places(w: str) -> list[int]:
            if w not in known:
                known[w] = h.positions(w)
            return known[w]

        return s.map(lambda ws: None if ws is None else [places(w) for w in ws])

    return run(words)


def image_class(w: Column, h: Column, repeats: Column, page: Column, cover: Column, first: Column, near: Column) -> Column:
    """What an image on a page is for; all but keep and cover are left out."""
    short, long = F.least(w, h), F.greatest(w, h)
    return (
        F.when((w <= 0) | (h <= 0), "invalid").when((short <= 3) & (long >= 16 * short), "rule").when((w <= 24) & (h <= 24), "tiny").when(repeats >= 3, "repeated")
        .when((page < 8) & (cover >= 0.35) & first, "cover").when(cover >= 0.8, "background").when(~near, "no_text").otherwise("keep")
    )


def rotated(dx: Column, dy: Column) -> Column:
    """Whether a run's baseline rises or falls by more than half of its way."""
    return (dy != 0) & ((dx == 0) | (2 * F.abs(dy) > F.abs(dx)))
