"""Main text of pages by equivalence-class template deduction.

Tokens of a page are its start tags and end tags, told apart by the path from the root (tag names with class and id), and
its words, told apart by the path around them.

1. Occurrence vectors: how often a token is on each page of a host. Tokens with equal vectors form a class, if they are on
   more than ``share`` of the host's pages (``pages`` at least). Vectors are compared by support, total and a sum of hashes
   of (page, count).
2. Order: on every page the tokens of a class must follow one another in one order, over and over. Tokens that are out of
   place on some page (not in the longest run that keeps the order) leave the class; a class whose rounds run into each
   other goes.
3. Nesting: classes are taken from the most frequent and largest on; one whose instances cross those of a class taken
   before, or lie sometimes in one gap of it and sometimes elsewhere, goes. Those taken, each in one gap of another or at
   the top, are the host's template; ``size`` tokens make a class at least.
4. Slots are what lies between neighbouring tokens of the template. An article's slots are those inside a container, an
   element of the template: articles, else main elements, else the innermost element, once on a page, that holds
   ``weight`` of the words in the host's slots. Tag and class names only choose among slots: menus, headers, footers,
   sidebars, notices, adverts, forms and comments are told by element, role, or a class or id that is such a name.

In articles and main elements nothing else is dropped, so passages that many pages share stay; in a container found by
weight, blocks of nothing but template words go. Pages without the container, and hosts with too few pages for a template,
are read by their tags alone.

Scale: pages are dealt once into cells of a host (``cell_pages`` pages, ``cell_chars`` characters), packed by the task that
reads them, stored in buckets by (host, cell), and not shuffled again; a host with a third of all pages is many cells. Each cell gives one row a token that
is on more than ``share`` / 2 of its pages, so words of single articles are not shuffled; where the cells that do not tell of
a token leave open whether it is on more than ``share`` of the host's pages, the host's tokens are counted again in all of its
cells. So a template is the same in one cell and in many. It holds no more tokens than a few average pages. The sizes of hosts with more than
one cell are sent to all tasks up to ``broadcast_hosts`` hosts, else joined by a shuffle.

Defined results: null or empty html gives an empty text; a null url, or one without a host, counts as host ''; repeated
rows repeat, and exact copies of a page count as pages; null ids stay null; broken markup is read as browsers do (unclosed
paragraphs and items end at the next, comments and scripts at the end); very long pages are read whole; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Bucketed, Stored, table
from quire.llm.url_filter import parts

_REST = r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|select|title|button)\b{_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][^\s/<>]*)({_REST})>|<(/?)([a-z][^\s/<>]*)([^<>]*)>|<[!?/][^>]*>|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_BREAK = frozenset(["br", "wbr", "img"])
#: A start of the first ends an open one of the second, unless one of the third lies between.
ENDS = {t: ("p", frozenset("table td th caption button object".split())) for t in BLOCK - frozenset("body head html td th tr tbody thead tfoot caption li dd dt".split())}
ENDS |= {"li": ("li", frozenset(["ul", "ol", "menu"])), "tr": ("tr", frozenset(["table"])), "td": ("td", frozenset(["tr", "table"])), "th": ("th", frozenset(["tr", "table"])), "dt": ("dd", frozenset(["dl"])), "dd": ("dt", frozenset(["dl"])), "option": ("option", frozenset(["select"]))}
BOILER_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole class or id names of parts that are not the article.
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sidebar comment comments cookie cookies cookie-notice cookie-banner consent notice notices "
    "nav navbar navigation menu breadcrumb breadcrumbs footer newsletter".split()
)
START, END, TEXT, SINGLE = range(4)
_M = 2**64 - 1


@dataclass(frozen=True)
class Params:
    size: int = 3
    pages: int = 3
    share: float = 0.5
    weight: float = 0.6
    cell_pages: int = 500
    cell_chars: int = 8_000_000
    broadcast_hosts: int = 100_000


def _kind(tag: str, attrs: str) -> tuple[str, str, bool, int, bool]:
    """(name in paths, tag, boilerplate, rank as a container: 2 article, 1 main, boilerplate outside a container)."""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
    names = set(found.get("class", "").lower().split()) | {found.get("id", "").lower()}
    role = found.get("role", "").lower()
    name = f"{tag}.{found.get('class', '')}#{re.sub('[0-9]+', '0', found.get('id', ''))}"
    if tag in ("html", "body"):
        return name, tag, False, 0, False
    rank = 2 if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower() else 1 if tag == "main" or role == "main" else 0
    return name, tag, tag in BOILER_TAGS or role in BOILER_ROLES or bool(names & BOILER_NAMES), rank, tag == "header" or "header" in names


def read(page: str) -> list[tuple]:
    """The page as (START, path, kind, block), (END, path, tag, block), (SINGLE, path, kind, block) and (TEXT, path, text, block).

    Every start has its end. A block is a number that changes where block elements begin and end.
    """
    import xxhash

    digest, out, block = xxhash.xxh3_64_intdigest, [], 0
    stack: list[tuple[str, int]] = [("", 1)]
    opened: dict[str, int] = {}
    kinds: dict[tuple[str, str], tuple] = {}
    paths: dict[tuple[int, str], int] = {}

    def close(to: int) -> None:
        nonlocal block
        while len(stack) > to:
            tag, path = stack.pop()
            opened[tag] -= 1
            if tag in BLOCK:
                block += 1
            out.append((END, path, tag, block))

    for m in TOKEN.finditer(page):
        text = m[8]
        if text is not None:
            out.append((TEXT, stack[-1][1], text, block))
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if opened.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
            elif tag in BLOCK:
                block += 1
            continue
        if tag in ENDS:
            end, scope = ENDS[tag]
            for end in (end, "td") if tag == "th" else (end, "th") if tag == "td" else (end, tag) if tag in ("dt", "dd") else (end,):
                if opened.get(end):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == end:
                            close(i)
                            break
                        if stack[i][0] in scope:
                            break
        if tag in BLOCK:
            block += 1
        attrs = m[4] or m[7] or ""
        kind = kinds.get((tag, attrs))
        if kind is None:
            kind = kinds[tag, attrs] = _kind(tag, attrs)
        above = stack[-1][1]
        path = paths.get((above, kind[0]))
        if path is None:
            path = paths[above, kind[0]] = digest(f"{above}/{kind[0]}")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            out.append((SINGLE, path, kind, block))
            if tag in INLINE_BREAK:
                out.append((TEXT, above, " ", block))
            continue
        out.append((START, path, kind, block))
        stack.append((tag, path))
        opened[tag] = opened.get(tag, 0) + 1
    close(1)
    return out


class Words(dict):
    """Tokens of words: for each path a table of the words met there."""

    def __missing__(self, path: int) -> _Path:
        if sum(map(len, self.values())) > 400_000:
            self.clear()
        self[path] = found = _Path(path)
        return found


class _Path(dict):
    def __init__(self, path: int):
        import xxhash

        self.path, self.digest = path, xxhash.xxh3_64_intdigest

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = t = self.digest(word.encode("utf-8", "replace"), seed=self.path)
        return t


def tokens(items: list[tuple], words: Words) -> tuple[np.ndarray, list[int]]:
    """The tokens of a page in page order, and where each item's begin."""
    out: list[int] = []
    at: list[int] = []
    for op, path, x, _ in items:
        at.append(len(out))
        if op == TEXT:
            out += map(words[path].__getitem__, x.split())
        elif op == END:
            out.append(path * 3 + 1 & _M)
        else:
            out.append(path)
    return np.fromiter(out, np.uint64, len(out)), [*at, len(out)]


def vectors(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, rows of support, total, two sums of hashes of (page, count), sum of first positions)."""
    import xxhash

    words, toks, rows = Words(), [], []
    for page in pages:
        t, first, n = np.unique(tokens(read(page), words)[0], return_index=True, return_counts=True)
        x = (np.uint64(xxhash.xxh3_64_intdigest(page.encode("utf-8", "replace"))) ^ (n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
        toks.append(t)
        rows.append(np.stack([np.ones(len(t), np.int64), n, (x >> np.uint64(33)).astype(np.int64), (x & np.uint64(0x7FFFFFFF)).astype(np.int64), first], axis=1))
    if not toks:
        return np.zeros(0, np.uint64), np.zeros((0, 5), np.int64)
    t, r = np.concatenate(toks), np.concatenate(rows)
    order = np.argsort(t, kind="stable")
    t, r = t[order], r[order]
    begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    return t[begin], np.stack([np.add.reduceat(r[:, i], begin) for i in range(5)], axis=1) if len(t) else np.zeros((0, 5), np.int64)


class Template:
    """Classes of tokens, and which tokens of a page are theirs."""

    def __init__(self, classes):
        self.sizes = [len(c) for c in classes]
        self.places = {int(t) & _M: (c, i) for c, toks in enumerate(classes) for i, t in enumerate(toks)}
        self.sorted = np.array(sorted(self.places), dtype=np.uint64)

    def hits(self, toks: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(toks), dtype=bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, toks), len(self.sorted) - 1)] == toks


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def longest_run(seq: list[int]) -> set[int]:
    """The members of a longest increasing subsequence of distinct numbers."""
    ends, at, before = [], [], []
    for i, x in enumerate(seq):
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
        at[k : k + 1] = [i]
        before.append(at[k - 1] if k else -1)
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(seq[i])
        i = before[i]
    return out


def misplaced(toks: np.ndarray, of: Template) -> set[tuple[int, int]]:
    """(class, place) of tokens out of order on this page; place -1: the rounds of the class run into each other."""
    seen: dict[int, list[list[int]]] = {}
    at = np.flatnonzero(of.hits(toks))
    for pos, t in zip(at.tolist(), toks[at].tolist(), strict=True):
        c, i = of.places[t]
        seen.setdefault(c, [[] for _ in range(of.sizes[c])])[i].append(pos)
    bad = set()
    for c, pos in seen.items():
        if len({len(p) for p in pos}) > 1:  # different vectors with equal hashes
            bad.add((c, -1))
            continue
        last = -1
        for k in range(len(pos[0])):
            turn = [p[k] for p in pos]
            if any(a >= b for a, b in zip(turn, turn[1:])):
                kept = longest_run([i for _, i in sorted((p, i) for i, p in enumerate(turn))])
                bad |= {(c, i) for i in range(len(turn)) if i not in kept}
                turn = [turn[i] for i in sorted(kept)]
            if turn[0] <= last:
                bad.add((c, -1))
            last = turn[-1]
    return bad


def relations(toks: np.ndarray, of: Template, into: Counter) -> None:
    """Counts ("total", c, 0, 0) instances, ("inside", c, d, gap) those in a gap of d, ("cross", c, d, 0) those that cross d's."""
    open_: list[list[int]] = []
    for t in toks[of.hits(toks)].tolist():
        c, i = of.places[t]
        if i == 0:
            for d, gap in open_:
                into["inside", c, d, gap] += 1
            into["total", c, 0, 0] += 1
            open_.append([c, 0])
        else:
            k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == c)
            for d, _ in open_[k + 1 :]:
                into["cross", min(c, d), max(c, d), 0] += 1
            open_[k][1] = i
            if i == of.sizes[c] - 1:
                del open_[k]


def weigh(items: list[tuple], toks: np.ndarray, at: list[int], of: Template, into: Counter) -> None:
    """Counts ("words", path, depth and rank, boilerplate) words in slots that no link holds, for each template element around them."""
    stack: list[tuple[int, int, bool, bool, int]] = []  # path or 0, depth and rank, boilerplate, link, containers around
    free = np.concatenate([[0], np.cumsum(~of.hits(toks))])
    free = (free[at[1:]] - free[at[:-1]]).tolist()
    for (op, path, x, _), n in zip(items, free, strict=True):
        if op == START:
            _, tag, bad, rank, edge = x
            _, _, boiler, link, inside = stack[-1] if stack else (0, 0, False, False, 0)
            boiler = boiler or bad or edge and not inside
            mine = path in of.places
            if mine:
                into["words", _signed(path), 4 * len(stack) + rank, int(boiler)] += 0
            stack.append((path if mine else 0, 4 * len(stack) + rank, boiler, link or tag == "a", inside or rank))
        elif op == END:
            stack.pop()
        elif op == TEXT and n and stack and not stack[-1][3]:
            for p, depth, boiler, _, _ in stack:
                if p:
                    into["words", _signed(p), depth, int(boiler)] += n


def nest(classes: list[list[int]], support: list[int], found: Counter) -> list[int]:
    """The classes of a template: from the most frequent and largest on, each that nests with those before."""
    total = {c: n for (k, c, _, _), n in found.items() if k == "total"}
    inside: dict[tuple[int, int], dict[int, int]] = {}
    for (k, c, d, gap), n in found.items():
        if k == "inside":
            inside.setdefault((c, d), {})[gap] = n

    def strays(c: int, d: int) -> bool:
        gaps = inside.get((c, d))
        return bool(gaps) and (len(gaps) > 1 or sum(gaps.values()) < total[c])

    kept: list[int] = []
    for c in sorted(range(len(classes)), key=lambda c: (-support[c], -len(classes[c]), classes[c])):
        if all(("cross", min(c, d), max(c, d), 0) not in found and not strays(c, d) and not strays(d, c) for d in kept):
            kept.append(c)
    return kept


def containers(template: set[int], once: set[int], found: Counter, weight: float) -> tuple[list[int], bool]:
    """(paths of the article's containers, whether they were found by weight) among the template's elements."""
    all_ = [(n, depth // 4, depth % 4, p) for (k, p, depth, boiler), n in found.items() if k == "words" and not boiler and p in template]
    for rank in (2, 1):
        got = [p for n, _, r, p in all_ if r == rank]
        if got:
            return sorted(got), False
    all_ = [x for x in all_ if x[3] in once]
    most = max((n for n, *_ in all_), default=0)
    heavy = [(n, -depth, p) for n, depth, _, p in all_ if most and n >= weight * most]
    return ([min(heavy)[2]] if heavy else []), True


def _lines(chosen: list[tuple[int, str]]) -> str:
    out, last = [], None
    for block, text in chosen:
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    lines = (" ".join((html.unescape(s) if "&" in (s := "".join(b)) else s).split()) for b in out)
    return "\n".join(x for x in lines if x)


def slots_text(items: list[tuple], held: set[int], by_weight: bool, of: Template, words: Words) -> str:
    """The text of the article's slots: of what lies in the containers and is no boilerplate."""
    chosen, own = [], set()
    stack = [(False, False)]  # boilerplate, in a container
    for op, path, x, block in items:
        if op == START:
            boiler, inside = stack[-1]
            _, _, bad, _, edge = x
            inside = inside or path in held and not boiler and not bad
            stack.append((boiler or bad or edge and not inside, inside))
        elif op == END:
            stack.pop()
        elif op == TEXT and stack[-1] == (False, True):
            chosen.append((block, x))
            if by_weight and any(words[path][w] not in of.places for w in x.split()):
                own.add(block)
    return _lines([c for c in chosen if c[0] in own] if by_weight else chosen)


def tags_text(items: list[tuple]) -> str:
    """The text of a page read by its tags alone: articles, else main elements, else all; never boilerplate."""
    best = {0: [], 1: [], 2: []}
    free: dict[int, list[int]] = {}  # words of a list item's block, unlinked and linked
    stack = [(False, 0, False, False, False)]  # boilerplate, rank, link, list item, boilerplate outside a container
    for op, _, x, block in items:
        if op == START:
            boiler, above, link, item, edge = stack[-1]
            _, tag, bad, rank, head = x
            boiler = boiler or bad
            stack.append((boiler, above if boiler else max(above, rank), link or tag == "a", item or tag == "li", edge or head and not above))
        elif op == END:
            stack.pop()
        elif op == TEXT:
            boiler, rank, link, item, edge = stack[-1]
            if not boiler:
                for r in range(rank + 1):
                    if r or not edge:
                        best[r].append((block, x))
                if item and not rank:
                    free.setdefault(block, [0, 0])[link] += len(x.split())
    for r in (2, 1):
        if any(t.strip() for _, t in best[r]):
            return _lines(best[r])
    return _lines([(b, t) for b, t in best[0] if b not in free or free[b][0] or not free[b][1]])  # items of nothing but links are a menu


CLASSES = "classes array<array<bigint>>, support array<bigint>, once array<boolean>"


#: Characters of pages that a task gathers before it packs them.
PACKED = 16_000_000


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of pages as compressed lists, one for each cell."""
    import zstandard

    squeeze, held, size = zstandard.ZstdCompressor(level=3).compress, {}, 0

    def flush() -> Iterator[pd.DataFrame]:
        rows = [(*key, squeeze(pickle.dumps(got))) for key, got in held.items()]
        for i in range(0, len(rows), 64):
            yield pd.DataFrame(rows[i : i + 64], columns=["host", "cell", "cells", "pages", "packed"])

    for b in batches:
        counts = b["pages"].astype("float").fillna(0).astype("int64")
        for host, cell, cells, n, i, u, page in zip(b["host"], b["cell"], b["cells"], counts, b["id"].astype(object).where(b["id"].notna(), None), b["u"], b["html"], strict=True):
            held.setdefault((host, cell, cells, n), []).append((i, u, page))
            size += len(page) + 100
            if size > PACKED:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _unpack(packed: pd.Series) -> list[tuple]:
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    return [row for p in packed for row in pickle.loads(loose(p))]


class Deduction:
    """Templates of all hosts of pages (id, u, html, host): ``cells`` holds the pages, ``templates`` a row for each host."""

    def __init__(self, pages: DataFrame, params: Params | None = None):
        self.p = p = params or Params()
        sizes = pages.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))
        many = sizes.select("host", "pages", F.ceil(F.greatest(F.col("pages") / p.cell_pages, F.col("chars") / p.cell_chars)).cast("int").alias("cells")).where("cells > 1")
        many = Stored(many, "hosts")
        few = many.df.limit(p.broadcast_hosts + 1).count() <= p.broadcast_hosts
        dealt = pages.join(F.broadcast(many.df) if few else many.df, "host", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("html", "id", "u"), F.col("cells")).cast("int"))
        self.kind = pages.schema["id"].dataType.simpleString()
        rows = dealt.select("host", "cell", "cells", "pages", "id", "u", "html").mapInPandas(_pack, "host string, cell int, cells int, pages bigint, packed binary")
        self.cells = Bucketed(rows, ["host", "cell"], "pages")
        many.drop()
        self._deduce()

    def _pass(self, step, found: DataFrame, shape: str, all_: bool = False) -> DataFrame:
        """Runs step(pages, one row of found or None) for each cell; found is (host, cells, ...); ``all_``: also with pages of hosts it lacks."""
        each = found.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))

        def run(pages: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(given) and not all_:
                return step([], None)
            return step(_unpack(pages["packed"]), given.iloc[0] if len(given) else None)

        return self.cells.df.groupBy("host", "cell").cogroup(each.groupBy("host", "cell")).applyInPandas(run, shape)

    def _deduce(self) -> None:
        p = self.p

        sums_ = ["seen", "support", "total", "x", "y", "at"]
        shape = "host string, cells int, pages bigint, tok bigint, seen bigint, support bigint, total bigint, x bigint, y bigint, at bigint"

        def told_of(host: str, cells: int, pages: int, seen: int, toks: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["support", "total", "x", "y", "at"])
            return out.assign(host=host, cells=cells, pages=pages, seen=seen, tok=toks.view(np.int64))[["host", "cells", "pages", "tok", *sums_]]

        def count(pages: pd.DataFrame) -> pd.DataFrame:
            host, cells, mine = pages["host"].iloc[0], int(pages["cells"].iloc[0]), _unpack(pages["packed"])
            n = len(mine)
            all_ = int(pages["pages"].iloc[0]) if cells > 1 else n
            toks, rows = vectors([h for _, _, h in mine if h])
            often = rows[:, 0] > p.share / 2 * n if cells > 1 else (rows[:, 0] > p.share * n) & (rows[:, 0] >= p.pages)
            return told_of(host, cells, all_, n, toks[often], rows[often])

        def recount(pages: list[tuple], given: pd.Series | None) -> pd.DataFrame:
            toks, rows = vectors([h for _, _, h in pages if h]) if given is not None else vectors([])
            asked = np.isin(toks.view(np.int64), given["unsure"]) if given is not None else np.zeros(0, bool)
            return told_of(*((given["host"], given["cells"], given["pages"]) if given is not None else ("", 0, 0)), len(pages), toks[asked], rows[asked])

        def classes(rows: DataFrame, last: bool) -> DataFrame:
            """A row a host: its classes, or the tokens to count again (``unsure``) where cells have not told of some that may be frequent."""
            sums = rows.groupBy("host", "tok").agg(F.max("cells").alias("cells"), F.max("pages").alias("pages"), *[F.sum(c).alias(c) for c in sums_])
            lacking = F.lit(0) if last else F.col("pages") - F.col("seen")  # in a cell that has not told of it, a token is on half of ``share`` at most
            often = sums.withColumn("sure", lacking == 0).where((F.col("support") + p.share / 2 * lacking > p.share * F.col("pages")) & ((F.col("support") >= p.pages) | ~F.col("sure")))
            # where tokens keep one order, so do the sums of their positions
            equal = often.groupBy("host", "cells", "pages", "sure", "support", "total", "x", "y").agg(F.array_sort(F.collect_list(F.struct("at", "tok"))).alias("toks"))
            if last:
                equal = equal.where(F.size("toks") >= p.size)
            else:
                equal = equal.where((F.size("toks") >= p.size) | (F.col("cells") > 1))
            one = F.when(F.col("sure") & (F.size("toks") >= p.size), F.struct(F.col("toks.tok").alias("toks"), "support", (F.col("total") == F.col("support")).alias("once")))
            by_host = equal.groupBy("host", "cells", "pages").agg(F.array_sort(F.collect_list(one)).alias("c"), F.when(~F.bool_and("sure"), F.flatten(F.collect_list("toks.tok"))).alias("unsure"))
            return by_host.select("host", "cells", "pages", F.col("c.toks").alias("classes"), F.col("c.support").alias("support"), F.col("c.once").alias("once"), "unsure").where("size(classes) > 0 or unsure is not null")

        found = Stored(classes(self.cells.df.groupBy("host", "cell").applyInPandas(count, shape), False), "classes")
        unsure = found.df.where("unsure is not null")
        if unsure.limit(1).count():
            again = Stored(classes(self._pass(recount, unsure.select("host", "cells", "pages", "unsure"), shape), True), "classes")
            both = Stored(found.df.where("unsure is null").unionByName(again.df), "classes")
            found.drop()
            again.drop()
            found = both
        found.df = found.df.select("host", "cells", "classes", "support", "once")

        def look(pages: list[tuple], given: pd.Series | None) -> pd.DataFrame:
            into: Counter = Counter()
            if given is not None and len(pages):
                words, of = Words(), Template(given["classes"])
                for _, _, h in pages:
                    if h:
                        items = read(h)
                        toks, at = tokens(items, words)
                        bad = misplaced(toks, of)
                        into.update({("bad", c, i, 0): 1 for c, i in bad})
                        if not bad:  # else this host is looked at again, without them
                            relations(toks, of, into)
                            weigh(items, toks, at, of, into)
            host = given["host"] if given is not None else ""
            return pd.DataFrame([(host, *k, n) for k, n in into.items()], columns=["host", "kind", "a", "b", "gap", "n"])

        def clean(given: pd.DataFrame, bad: pd.DataFrame) -> pd.DataFrame:
            if not len(given):
                return pd.DataFrame([], columns=["host", "cells", "classes", "support", "once"])
            row, gone = given.iloc[0], set(zip(bad["a"].tolist(), bad["b"].tolist(), strict=True))
            left = [[int(t) for i, t in enumerate(toks) if (c, i) not in gone] if (c, -1) not in gone else [] for c, toks in enumerate(row["classes"])]
            good = [c for c, toks in enumerate(left) if len(toks) >= p.size]
            out = {"host": [row["host"]], "cells": [row["cells"]], "classes": [[left[c] for c in good]], "support": [[int(row["support"][c]) for c in good]], "once": [[bool(row["once"][c]) for c in good]]}
            return pd.DataFrame(out) if good else pd.DataFrame([], columns=list(out))

        told = "host string, kind string, a bigint, b bigint, gap int, n bigint"
        summed = lambda rows: Stored(rows.groupBy("host", "kind", "a", "b", "gap").agg(F.sum("n").alias("n")), "seen")
        seen = summed(self._pass(look, found.df, told))
        held, evidence = found, seen.df
        bad = seen.df.where("kind = 'bad'")
        if bad.limit(1).count():
            hosts = bad.select("host").distinct()
            again = found.df.join(hosts, "host", "left_semi").groupBy("host").cogroup(bad.groupBy("host")).applyInPandas(clean, f"host string, cells int, {CLASSES}")
            again = Stored(again, "ordered")
            held = Stored(found.df.join(hosts, "host", "left_anti").unionByName(again.df), "classes")
            evidence = seen.df.join(hosts, "host", "left_anti").unionByName(summed(self._pass(look, again.df, told)).df)
            again.drop()

        def choose(given: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
            if not len(given):
                return pd.DataFrame([], columns=["host", "cells", "classes", "held", "weighed"])
            row = given.iloc[0]
            found = Counter(dict(zip(zip(seen["kind"], seen["a"], seen["b"], seen["gap"], strict=True), seen["n"].tolist(), strict=True)))
            classes = [[int(t) for t in toks] for toks in row["classes"]]
            kept = nest(classes, [int(s) for s in row["support"]], found)
            once = {t for c in kept if row["once"][c] for t in classes[c]}
            held, weighed = containers({t for c in kept for t in classes[c]}, once, found, p.weight)
            return pd.DataFrame({"host": [row["host"]], "cells": [row["cells"]], "classes": [[classes[c] for c in kept]], "held": [held], "weighed": [weighed]})

        chosen = held.df.groupBy("host").cogroup(evidence.groupBy("host")).applyInPandas(choose, "host string, cells int, classes array<array<bigint>>, held array<bigint>, weighed boolean")
        self.templates = Stored(chosen, "templates")
        for x in {found, seen, held}:
            x.drop()

    def texts(self) -> DataFrame:
        """(id, u, text) of every page."""
        def cut(pages: list[tuple], given: pd.Series | None) -> pd.DataFrame:
            words, held = Words(), set() if given is None else {int(t) & _M for t in given["held"]}
            of, weighed = (Template([]), False) if given is None else (Template(given["classes"]), bool(given["weighed"]))

            def one(page: str) -> str:
                items = read(page)
                return held and slots_text(items, held, weighed, of, words) or tags_text(items)

            return pd.DataFrame([(i, u, one(h) if h else "") for i, u, h in pages], columns=["id", "u", "text"], dtype=object)  # a cell may hold no pages

        return self._pass(cut, self.templates.df, f"id {self.kind}, u string, text string", all_=True)


def templates(pages: DataFrame, params: Params | None = None) -> DataFrame:
    """(host, classes array<array<bigint>>, held array<bigint>, weighed) of pages (host, html): nested classes in order, and containers."""
    rows = pages.select(F.lit(0).alias("id"), F.lit("").alias("u"), F.coalesce("html", F.lit("")).alias("html"), "host")
    return Deduction(rows, params).templates.df.drop("cells")


def extract(pages: DataFrame, params: Params | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars, one row a page."""
    pages = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("u"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).withColumn("host", F.expr(parts("u")[0]))
    out = Deduction(pages, params).texts()
    return out.select(F.col("id").alias(id_col), F.col("u").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

