"""Text of both directions in the order that it is seen: levels, reversal, mirrored characters, joined letters.

A line is one run of the standard's algorithm: marks that open and close embeddings, overrides and isolates are passed over, which is
the one part of it left out. Types are resolved in passes over a line that each keep a few facts of what came before.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that mirror each other; the first six open and close pairs that enclose.
MIRRORED = dict(zip("()[]{}<>«»‹›", ")(][}{><»«›‹", strict=True))
OPENING, CLOSING = "([{", ")]}"
PASSED_OVER = ("LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI", "BN")


def base_level(text: str) -> int:
    """1 where the first strong character runs right to left, else 0."""
    first = next((t for t in map(unicodedata.bidirectional, text) if t in ("L", "R", "AL")), "L")
    return int(first != "L")


def _weak(types: list[str], base: str) -> list[str]:
    """Types with numbers, their signs and marks resolved."""
    out, before = [], base
    for t in types:
        before = before if t == "NSM" else t
        out.append(before)
    strong = base
    for i, t in enumerate(out):
        strong = t if t in ("L", "R", "AL") else strong
        if t == "EN" and strong == "AL":
            out[i] = "AN"
    out = ["R" if t == "AL" else t for t in out]
    for i in range(1, len(out) - 1):
        a, t, z = out[i - 1], out[i], out[i + 1]
        if a == z and (t in ("ES", "CS") and a == "EN" or t == "CS" and a == "AN"):
            out[i] = a
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and out[j] == "ET":
            j += 1
        if j > i and ((i and out[i - 1] == "EN") or (j < len(out) and out[j] == "EN")):
            out[i:j] = ["EN"] * (j - i)
        i = max(j, i + 1)
    strong = base
    for i, t in enumerate(out):
        strong = t if t in ("L", "R") else strong
        out[i] = "ON" if t in ("ES", "ET", "CS") else "L" if t == "EN" and strong == "L" else t
    return out


def _side(t: str) -> str | None:
    return "R" if t in ("R", "EN", "AN") else "L" if t == "L" else None


def _pairs(chars: list[str], types: list[str]) -> list[tuple[int, int]]:
    held, found = [], []
    for i, c in enumerate(chars):
        if types[i] != "ON":
            continue
        if c in OPENING:
            held.append(i)
        elif c in CLOSING:
            at = next((k for k in range(len(held) - 1, -1, -1) if chars[held[k]] == OPENING[CLOSING.index(c)]), None)
            if at is not None:
                found.append((held[at], i))
                del held[at:]
    return sorted(found)


def _neutral(chars: list[str], types: list[str], base: str) -> list[str]:
    """Types with brackets and neutral characters resolved."""
    out = list(types)
    for a, z in _pairs(chars, types):
        inside = {_side(t) for t in out[a + 1 : z]} - {None}
        if base in inside:
            out[a] = out[z] = base
        elif inside:
            before = next((s for t in reversed(out[:a]) if (s := _side(t))), base)
            out[a] = out[z] = before if before != base else base
    i = 0
    while i < len(out):
        j = i
        while j < len(out) and _side(out[j]) is None:
            j += 1
        if j > i:
            left = _side(out[i - 1]) if i else base
            right = _side(out[j]) if j < len(out) else base
            out[i:j] = [left if left == right else base] * (j - i)
        i = max(j, i + 1)
    return out


def levels(text: str, base: int) -> list[int]:
    """The level of each character of a line: even ones run left to right."""
    types = [unicodedata.bidirectional(c) or "L" for c in text]
    kept = [i for i, t in enumerate(types) if t not in PASSED_OVER]
    side = "R" if base else "L"
    weak = _weak([types[i] for i in kept], side)
    found = _neutral([text[i] for i in kept], ["ON" if t in ("B", "S", "WS") else t for t in weak], side)
    out = [base] * len(text)
    for i, t in zip(kept, found, strict=True):
        out[i] = base + (t == "R") + 2 * (t in ("EN", "AN")) if base == 0 else base + (t in ("L", "EN", "AN"))
    for i in range(1, len(text)):  # what is passed over goes with what is before it
        if types[i] in PASSED_OVER:
            out[i] = out[i - 1]
    end = True
    for i in range(len(text) - 1, -1, -1):  # blanks before an end or a tab are the line's
        end = types[i] in ("S", "B") or end and types[i] in ("WS", *PASSED_OVER)
        out[i] = base if end else out[i]
    return out


def reordered(text: str, base: int | None = None) -> str:
    """A line in the order that it is seen."""
    base = base_level(text) if base is None else base
    found = levels(text, base)
    chars = [MIRRORED.get(c, c) if n % 2 else c for c, n in zip(text, found, strict=True)]
    order = list(range(len(text)))
    for n in range(max(found, default=0), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and found[order[j]] >= n:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(chars[i] for i in order)


@functools.cache
def _forms() -> tuple[dict[str, dict[str, str]], dict[tuple[str, str], dict[str, str]]]:
    """The isolated, final, initial and medial forms of letters, and of pairs that are written as one, as the character data tells."""
    one: dict[str, dict[str, str]] = {}
    two: dict[tuple[str, str], dict[str, str]] = {}
    for code in (*range(0xFB50, 0xFDFC), *range(0xFE80, 0xFEFD)):
        parts = unicodedata.decomposition(chr(code)).split()
        if not parts or parts[0] not in ("<isolated>", "<final>", "<initial>", "<medial>"):
            continue
        base = [chr(int(p, 16)) for p in parts[1:]]
        kind = parts[0].strip("<>")
        if len(base) == 1:
            one.setdefault(base[0], {}).setdefault(kind, chr(code))
        elif len(base) == 2 and base[0] == "ل" and code >= 0xFEF5:
            two.setdefault((base[0], base[1]), {})[kind] = chr(code)
    return one, two


def joined(text: str) -> str:
    """Arabic letters in the forms that their neighbours give them; marks between letters part nothing, lam and alef become one."""
    one, two = _forms()
    if not any(c in one for c in text):
        return text
    solid = [i for i, c in enumerate(text) if unicodedata.category(c) != "Mn"]
    onward = lambda c: "initial" in one.get(c, ()) or c == "ـ"  # noqa: E731  joins what follows
    back = lambda c: "final" in one.get(c, ()) or c == "ـ"
    out, gone = list(text), set()
    for k, i in enumerate(solid):
        c = text[i]
        if i in gone or c not in one:
            continue
        before = k > 0 and onward(text[solid[k - 1]]) and back(c)
        after = solid[k + 1] if k + 1 < len(solid) else None
        if after is not None and (c, text[after]) in two:
            out[i], out[after] = two[c, text[after]]["final" if before else "isolated"], ""
            gone.add(after)
            continue
        ahead = after is not None and onward(c) and back(text[after])
        kind = "medial" if before and ahead else "final" if before else "initial" if ahead else "isolated"
        out[i] = one[c].get(kind, c)
    return "".join(out)


def visual_order(c: Column, base: int | None = None, shape: bool = True) -> Column:
    """Text in the order that it is seen, line by line, its letters joined. ``base`` is the level of all lines, else each line's own."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii() and not base:
            return t
        return "\n".join(reordered(joined(line) if shape else line, base) for line in t.split("\n"))

    return F.pandas_udf(lambda s: s.map(one), T.StringType())(c)


def line_levels(c: Column, base: int | None = None) -> Column:
    """array<int>: the level of each character of a line."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else levels(t, base_level(t) if base is None else base))

    return run(c)
