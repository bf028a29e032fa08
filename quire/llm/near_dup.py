"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct shingles of ``words`` words; documents link whose Jaccard similarity reaches
``percent`` / 100, and the components of links are the groups.

1. One pass makes each document's set hash, set size and a signature of minwise values. Equal sets become one class.
2. ``trees`` independent trees branch the classes. A node picks coordinates of the signature by a hash of its path, and a
   class enters the child of the minwise tokens that it holds there; two levels are taken at once, and below the root each
   node does so twice. Similar sets tend to take the same paths, all others part. Nodes of one class end.
3. Nodes of at most ``leaf`` classes are compared exhaustively by signature. Larger nodes are cut in blocks, in each of
   which all classes are compared with the smallest. At every second level, nodes that links found so far connect end, as
   do nodes that they connect but for a few classes, after comparing these few with all; the rest branch again. What is
   still large after ``levels`` levels is compared block by block, so no node is ever cut short.
4. Pairs that the signature doesn't rule out (four standard deviations under the threshold) are confirmed on full sets,
   in groups of some hundred pairs of one node, bounded in bytes. Full sets are made once, of the classes that such a pair of the
   first level or a large node holds, and stored in buckets by class; texts of other documents are told by a bitmap of fixed size and
   stay where they are. First only a forest of each node's pairs is,
   so their number follows the rows; pairs left out whose ends links have not connected are confirmed within their node.
5. Components by forests of dealt edges, joined by alternating stars where one task can't hold them, in shared storage.

At similarity ``percent`` one tree finds a pair in a large group about every second time; with 16 trees, whose first two
levels draw on different coordinates, about one pair in 50,000 is missed, and in groups of up to ``leaf`` classes one in
10**8.
No group is collected: nodes are counted by partial sums, leaves are bounded, hot classes meet only in joins that Spark
splits. Sets are of 64-bit shingle hashes.

Defined results: null and empty texts, and texts without a word, have an empty set and link with nothing; a text of fewer
than ``words`` words has the whole sequence as its one shingle. A null id is never kept and names no component unless all
of a component's ids are null. Rows that repeat an id and text are one class; all rows with the component's id are kept.
An empty table gives an empty result. Very long texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import Bucketed, Stored, likely, table

#: Minwise coordinates of a signature (32 bits; trees branch on these), and bins of one permutation (8 bits; to compare).
HEAD, TAIL = 128, 256
SIGMAS = 4.0
WORDS_KNOWN = 200_000


@dataclass(frozen=True)
class Params:
    words: int = 3
    percent: int = 85
    trees: int = 16
    leaf: int = 1000
    levels: int = 16
    pairs: int = 256  #: pairs of one node that are confirmed together at most
    pair_bytes: int = 8_000_000  #: and bytes of their sets


_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K2
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes; the hash of each distinct word is kept, in a bounded table."""

    def __init__(self, words: int):
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh3_64_intdigest, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct uint64 hashes. Words part at ASCII white space; A-Z are lower-cased, nothing else is."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > WORDS_KNOWN:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.hash(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        n = self.words if len(h) >= self.words else len(h)
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out = _mix(out * _K1 + h[i : len(h) - n + 1 + i] * _K3 + np.uint64(i))
        return np.unique(out)


_R = np.random.default_rng(20240229)
_A = _R.integers(0, 2**63, HEAD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, HEAD, dtype=np.uint64)
_EDGES = np.arange(TAIL, dtype=np.uint64) << np.uint64(56)


def signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """Of a nonempty set: HEAD minwise values of 32 bits, and of each of TAIL bins of one permutation the least (0: none)."""
    low = np.full(HEAD, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * _A + _B).min(axis=0))
    x = np.sort(_mix(s * _K1))
    at = np.searchsorted(x, _EDGES)
    first = x[np.minimum(at, len(x) - 1)]
    tail = 1 + _mix(first) % np.uint64(255)
    tail[(at == len(x)) | ((first >> np.uint64(56)) != np.arange(TAIL, dtype=np.uint64))] = 0
    return (_mix(low) >> np.uint64(32)).astype("<u4").tobytes(), tail.astype(np.uint8).tobytes()


def sets_of(docs: DataFrame, p: Params) -> DataFrame:
    """(doc, th, uid, n, head, sig) of docs (doc, text); th hashes the text, uid the set; uid and signature are null for an empty set."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        make = Shingler(p.words)
        for b in batches:
            uid, n, head, sig = [], [], [], []
            for t in b["text"]:
                s = make.of(t)
                n.append(len(s))
                uid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if len(s) else None)
                x, y = signature(s) if len(s) else (None, None)
                head.append(x)
                sig.append(y)
            yield pd.DataFrame({"doc": b["doc"], "th": b["th"], "uid": pd.array(uid, dtype="Int64"), "n": n, "head": head, "sig": sig})

    return docs.select("doc", "text", F.xxhash64("text").alias("th")).mapInPandas(run, f"doc {kind}, th bigint, uid bigint, n bigint, head binary, sig binary")


def _alike(uid: np.ndarray, n: np.ndarray, sig: list[bytes], p: Params, group: np.ndarray, star: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of a node, of different groups, whose signatures and sizes allow a link, and their shares of equal bins;
    if ``star`` only pairs with the first.

    Signatures allow it unless the share of equal bins, among those that either set has, is SIGMAS standard deviations
    under the threshold.
    """
    tail = np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(sig), -1)
    bound, left, right, share = p.percent / 100, [], [], []
    for i in range(1 if star else len(uid) - 1):
        j = slice(i + 1, None)
        at = np.flatnonzero((100 * np.minimum(n[i], n[j]) >= p.percent * np.maximum(n[i], n[j])) & (group[j] != group[i])) + i + 1
        if len(at):
            mine, theirs = tail[i], tail[at]
            held = ((mine > 0) | (theirs > 0)).sum(axis=1)
            same = ((theirs == mine) & (mine > 0)).sum(axis=1)
            union = (n[i] + n[at]) / (1 + bound)  # at the threshold; the bins held are a sample of it without replacement
            ok = same >= held * bound - SIGMAS * np.sqrt(held * bound * (1 - bound) * np.maximum(0.05, 1 - held / union))
            left += [i] * int(ok.sum())
            right += at[ok].tolist()
            share += (same[ok] / held[ok]).tolist()
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(share)


def _tree(x: np.ndarray, y: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """Indices of the pairs of a forest that connects what the pairs connect, the likeliest links first."""
    up, kept = list(range(n)), []
    for i in np.argsort(-share, kind="stable").tolist():
        a, b = int(x[i]), int(y[i])
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole nodes, and where each begins and ends, from rows sorted by node."""
    rest: pd.DataFrame | None = None

    def cut(b: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        at = (np.flatnonzero(np.diff(b["node"].to_numpy())) + 1).tolist()
        return b, list(zip([0, *at], [*at, len(b)], strict=True)) if len(b) else []

    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = b["node"].to_numpy() == b["node"].iloc[-1] if len(b) else np.zeros(0, bool)
        rest = b[last]
        yield cut(b[~last])
    if rest is not None:
        yield cut(rest)


def _compare(rows: DataFrame, p: Params, parts: int) -> DataFrame:
    """(node, a, b, w), a < b, w the bytes of both sets: of each node of rows (node, uid, n, sig, star) the pairs of a forest over those that may link.

    A node with further such pairs also gives a row without b.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, nodes in _whole(batches):
            node, uid, n, sig, star = b["node"].to_numpy(), b["uid"].to_numpy(), b["n"].to_numpy(), b["sig"].tolist(), b["star"].to_numpy()
            out, dense = [(np.zeros(0, np.int64),) * 4], []
            for i, j in nodes:
                if j - i < 2:
                    continue
                x, y, share = _alike(uid[i:j], n[i:j], sig[i:j], p, uid[i:j], star[i])
                if len(x) > 1 and not star[i]:
                    kept = _tree(x, y, share, j - i)
                    if len(kept) < len(x):
                        dense.append(node[i])
                    x, y = x[kept], y[kept]
                if len(x):
                    out.append((np.full(len(x), node[i]), uid[i:j][x], uid[i:j][y], 8 * (n[i:j][x] + n[i:j][y])))
            nodes_, a, c, w = (np.concatenate([o[k] for o in out]) for k in range(4))
            found = pd.DataFrame({"node": nodes_, "a": np.minimum(a, c), "b": pd.array(np.maximum(a, c), dtype="Int64"), "w": w})
            yield pd.concat([found, pd.DataFrame({"node": dense, "a": 0, "b": pd.array([None] * len(dense), dtype="Int64"), "w": 0})]) if dense else found

    return rows.repartition(parts, "node").sortWithinPartitions("node", "uid").mapInPandas(run, "node bigint, a bigint, b bigint, w bigint")


def _similar(x: np.ndarray, y: np.ndarray, p: Params) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= p.percent * (len(x) + len(y) - both)


def _link(rows: DataFrame, p: Params, parts: int) -> DataFrame:
    """Links (a, b) that join different labels within each node of rows (node, uid, n, sig, label, s).

    Every pair that may link and whose ends are not connected yet is confirmed on the sets s; a link joins its ends' labels,
    so a node gives fewer links than it has classes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, nodes in _whole(batches):
            uid, n, sig, label, sets = b["uid"].to_numpy(), b["n"].to_numpy(), b["sig"].tolist(), b["label"].to_numpy(), b["s"].tolist()
            out = []
            for i, j in nodes:
                x, y, share = _alike(uid[i:j], n[i:j], sig[i:j], p, label[i:j])
                held = {k: np.frombuffer(sets[i + k], dtype=np.uint64) for k in {*x.tolist(), *y.tolist()}}
                up: dict[int, int] = {}

                def root(k: int, up=up) -> int:
                    while k in up:
                        k = up[k]
                    return k

                for k in np.argsort(-share, kind="stable").tolist():
                    v, w = int(x[k]), int(y[k])
                    a, c = root(int(label[i + v])), root(int(label[i + w]))
                    if a != c and _similar(held[v], held[w], p):
                        up[a] = c
                        out.append((uid[i + v], uid[i + w]))
            yield pd.DataFrame(out, columns=["a", "b"])

    return rows.repartition(parts, "node").sortWithinPartitions("node", "uid").mapInPandas(run, "a bigint, b bigint")


#: Edges whose components one task finds by itself.
LOCAL_EDGES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): each end u of a partition's edges with the smallest end v that these edges connect it to, u > v."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ends = list(parent)
    yield pd.DataFrame({"u": np.array(ends, dtype=np.int64), "v": np.array([root(x) for x in ends], dtype=np.int64)})


def components(links: DataFrame, hold=Stored) -> DataFrame:
    """(uid, label): for every end of links (a, b) the smallest uid of its component.

    Edges are dealt to tasks of at most about LOCAL_EDGES, each of which leaves a forest of stars; if there is more than
    one task, alternating large and small stars join the forests.
    """
    dealt = links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v")
    parts = 1 + dealt.count() // LOCAL_EDGES
    edges = hold(dealt.repartition(parts).mapInPandas(_forest, "u bigint, v bigint"), "forest")
    if parts == 1:
        return _labels(edges.df)
    before = None
    while True:
        both = edges.df.unionByName(edges.df.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(low, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        held = Stored(large, "large")
        low = held.df.groupBy("u").agg(F.min("v").alias("m"))
        small = held.df.join(low, "u").where("v <> m").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).where("u <> v").distinct()
        after = hold(small, "small")
        now = after.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        held.drop()
        edges.drop()
        edges = after
        if now == before:
            break
        before = now
    return _labels(edges.df)


def _labels(stars: DataFrame) -> DataFrame:
    return stars.selectExpr("u as uid", "v as label").unionByName(stars.selectExpr("v as uid", "v as label").distinct())


class Join:
    """The steps of the join over documents (doc, text)."""

    def __init__(self, docs: DataFrame, p: Params):
        self.p, self.docs, self.spark = p, docs, docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.held: list[Stored] = []
        made = Stored(sets_of(docs, p), "sets")
        self.members = Stored(made.df.select("doc", "th", "uid", "n"), "members").df
        self.classes = self._hold(made.df.where("uid is not null").groupBy("uid").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("sig").alias("sig")), "classes").df
        made.drop()
        self.links: list[DataFrame] = []
        self.pairs: list[DataFrame] = []
        self.dense: list[DataFrame] = []

    def _hold(self, df: DataFrame, name: str) -> Stored:
        """A stored table that goes when the join is done."""
        self.held.append(Stored(df, name))
        return self.held[-1]

    def _child(self, node: str, pick: str) -> str:
        return f"xxhash64({node}, {pick}, substring(head, 4 * cast({pick} as int) + 1, 4))"

    def grow(self) -> None:
        """Branches until no node is large, and gathers the pairs of all nodes."""
        p = self.p
        first = self._child("cast(t as bigint)", f"(t * 37) % {HEAD}")
        roots = f"transform(sequence(0, {p.trees - 1}), t -> {self._child(first, f'(t * 37 + {HEAD // 2 + 1}) % {HEAD}')})"
        rows, source, level = self.classes.selectExpr("uid", f"explode({roots}) as node"), self.classes, 1
        while True:
            held = Stored(rows, "rows")
            sizes = held.df.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
            kept = self._hold(held.df.join(sizes, "node"), "nodes")
            held.drop()
            large = kept.df.where(f"size > {p.leaf}")
            # small nodes whole; of larger ones blocks of about leaf classes, in each the smallest against the others
            block = f"xxhash64(node, 'block', pmod(xxhash64(uid, node), cast(ceil(size / {p.leaf}D) as bigint)))"
            self._collect(kept.df.selectExpr(f"if(size > {p.leaf}, {block}, node) as node", "uid", f"size > {p.leaf} as star"), source)
            if level == 1:  # every pair of a later level is of large nodes' classes, and a forest has the ends of all its node's pairs
                ends = self.pairs[0].select(F.explode(F.array("a", "b")).alias("uid"))
                self._make_sets(ends.unionByName(large.select("uid")).distinct())
            if not large.limit(1).count():
                return
            if level % 2 == 1:
                large = self._apart(large)
                if not large.limit(1).count():
                    return
            if level >= p.levels:
                return self._rest(large)
            if level == 1:
                source = self._hold(self.classes.join(large.select("uid").distinct(), "uid", "left_semi"), "large").df
            pick = lambda i, j: f"pmod(xxhash64(node, {i}, {j}), {HEAD})"
            children = ", ".join(self._child(self._child("node", pick(i, 0)), pick(i, 1)) for i in range(2))
            rows = large.select("node", "uid").join(source.select("uid", "head"), "uid").selectExpr("uid", f"explode(array_distinct(array({children}))) as node")
            level += 1

    def _collect(self, rows: DataFrame, source: DataFrame) -> None:
        """Gathers pairs of rows (node, uid, star), and the rows of nodes that have more."""
        full = rows.join(source.select("uid", "n", "sig"), "uid").select("node", "uid", "n", "sig", "star")
        found = self._hold(_compare(full, self.p, self.parts), "pairs").df
        self.pairs.append(found.where("b is not null"))
        self.dense.append(rows.select("node", "uid").join(found.where("b is null").select("node"), "node", "left_semi"))

    def _within(self, rows: DataFrame) -> None:
        """Adds the links that join labels within nodes of rows (node, uid, label); sets travel with the rows."""
        whole = rows.join(self.classes.select("uid", "n", "sig"), "uid").join(self.full, "uid").select("node", "uid", "n", "sig", "label", "s")
        self.links.append(self._hold(_link(whole, self.p, self.parts), "within").df)

    def settle(self) -> DataFrame:
        """Labels of components. Pairs left out of forests are confirmed after all where forests did not connect them."""
        labels = components(self.confirmed(), self._hold)
        rows = self.dense[0]
        for x in self.dense[1:]:
            rows = rows.unionByName(x)
        named = self._hold(rows.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid")), "dense").df
        apart = named.groupBy("node").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("node")
        apart = self._hold(named.join(apart, "node", "left_semi"), "unsettled").df
        if not apart.limit(1).count():
            return labels
        self._within(apart)
        return components(self.confirmed(), self._hold)

    def _apart(self, large: DataFrame) -> DataFrame:
        """The rows of large nodes that must branch on.

        A node ends if its classes are connected. It also ends if all but ``leaf`` of them are: these few are compared
        with the whole node, in blocks, which settles every link that could still connect anything in it.
        """
        p = self.p
        named = self._hold(large.select("node", "uid", "size").join(components(self.confirmed(), self._hold), "uid", "left").withColumn("label", F.coalesce("label", "uid")), "named").df
        most = named.groupBy("node", "label").agg(F.count("*").alias("n"), F.max("size").alias("size")).groupBy("node").agg(F.max(F.struct("n", "label")).alias("m"), F.max("size").alias("size"))
        most = self._hold(most.selectExpr("node", "m.label as main", "m.n as n", "size - m.n as others").where("others > 0"), "main").df
        few = named.drop("size").join(most.where(f"others <= {p.leaf}"), "node").withColumn("k", F.ceil(F.col("n") / F.lit(float(p.leaf))).cast("int"))
        spread = few.selectExpr("node", "uid", "label", "explode(if(label = main, array(cast(pmod(xxhash64(uid, node), k) as int)), sequence(0, k - 1))) as i")
        self._within(self._hold(spread.selectExpr("xxhash64(node, 'few', i) as node", "uid", "label"), "few").df)
        return self._hold(named.join(most.where(f"others > {p.leaf}").select("node"), "node", "left_semi"), "apart").df

    def _rest(self, large: DataFrame) -> None:
        """Compares what no level has parted, block by block: every pair of blocks of a node is a small node."""
        half = max(1, self.p.leaf // 2)
        cut = large.selectExpr("node", "uid", f"cast(ceil(size / {half}D) as bigint) as k").selectExpr("node", "uid", "k", "pmod(xxhash64(uid, node, 'rest'), k) as i")
        both = cut.selectExpr("uid", "explode(transform(sequence(0L, k - 1), j -> xxhash64(node, least(i, j), greatest(i, j)))) as node")
        self._collect(both.selectExpr("node", "uid", "false as star"), self.classes)

    def confirmed(self) -> DataFrame:
        """Links (a, b) among the pairs gathered, confirmed on full sets; what was confirmed before is not done again."""
        if self.pairs:
            pairs = self.pairs[0]
            for x in self.pairs[1:]:
                pairs = pairs.unionByName(x)
            self.pairs = []
            pairs = pairs.groupBy("a", "b").agg(F.min("node").alias("node"), F.min("w").alias("w"))
            self.links.append(self._hold(self._confirm(self._hold(pairs, "distinct").df), "links").df)
        out = self.links[0]
        for x in self.links[1:]:
            out = out.unionByName(x)
        return out

    def _make_sets(self, wanted: DataFrame) -> None:
        """Stores (uid, s), the full sets of the classes wanted, made again from the text of one document of each.

        A bitmap of fixed size keeps most other texts out of the join; later joins by class don't shuffle the sets again.
        """
        p = self.p
        heads = self._hold(self.classes.join(wanted, "uid", "left_semi").select("uid", F.col("doc").alias("head")), "heads").df
        some = likely(self.docs.select("doc", "text"), F.col("doc"), heads, F.col("head")).where("_likely").select("doc", "text")
        docs = some.join(heads, F.col("doc").eqNullSafe(F.col("head"))).select("uid", "text")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import xxhash

            make = Shingler(p.words)
            for b in batches:
                uid, out = [], []
                for u, t in zip(b["uid"], b["text"], strict=True):
                    s = make.of(t).tobytes()
                    if s and xxhash.xxh3_64_intdigest(s) - 2**63 == u:  # else another row of the same id
                        uid.append(u)
                        out.append(s)
                yield pd.DataFrame({"uid": np.array(uid, dtype=np.int64), "s": out})

        once = docs.mapInPandas(sets, "uid bigint, s binary").dropDuplicates(["uid"])
        self.held.append(Bucketed(once, ["uid"], "full"))
        self.full = self.held[-1].df

    def _confirm(self, pairs: DataFrame) -> DataFrame:
        p = self.p
        at = W.partitionBy("node").orderBy("a", "b")
        cut = pairs.withColumn("i", F.row_number().over(at)).withColumn("sum", F.sum("w").over(at.rowsBetween(W.unboundedPreceding, 0)))
        n, size = pairs.agg(F.count("*"), F.sum("w")).first()
        groups = int(max(self.parts, n // 20_000, (size or 0) // (4 * p.pair_bytes)))
        key = F.pmod(F.xxhash64("node", F.floor((F.col("i") - 1) / p.pairs), F.floor(F.col("sum") / p.pair_bytes)), F.lit(groups)).alias("g")
        left = self._hold(cut.select(key, "a", "b"), "dealt").df
        ends = left.selectExpr("g", "a as uid").unionByName(left.selectExpr("g", "b as uid")).distinct()
        right = ends.join(self.full, "uid").select(F.col("g").alias("k"), "uid", "s")

        def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            held = {u: np.frombuffer(s, dtype=np.uint64) for u, s in zip(right["uid"], right["s"], strict=True)}
            good = [_similar(held[a], held[b], p) for a, b in zip(left["a"], left["b"], strict=True)]
            return left.loc[np.array(good, dtype=bool), ["a", "b"]]

        return left.groupBy("g").cogroup(right.groupBy("k")).applyInPandas(check, "a bigint, b bigint")


def groups(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable by links), kept, one row a document.

    With ``detail`` also text_hash (xxhash64 of the text) and label, which names the component where ids repeat (null: an
    empty set, alone).
    """
    join = Join(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")), params or Params())
    join.grow()
    labels = join.settle()
    named = join.classes.select("uid", "doc").join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    first = named.groupBy("label").agg(F.min("doc").alias("component"))
    final = Stored(named.join(first, "label").select("uid", "label", "component"), "final").df
    for x in join.held:
        x.drop()
    out = join.members.join(final, "uid", "left").withColumn("component", F.when(F.col("uid").isNull(), F.col("doc")).otherwise(F.col("component")))
    more = [F.col("th").alias("text_hash"), "label"] if detail else []
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(False)).alias("kept"), *more)


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
  s as (select rid, doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
  x as (select rid, unnest(s) g from s),
  c as (select a.rid a, b.rid b, count(*) n from x a join x b on a.g = b.g and a.rid < b.rid group by 1, 2),
  l as (select c.a, c.b from c join s p on p.rid = c.a join s q on q.rid = c.b where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
  e as (select a, b from l union all select b, a from l),
  r(rid, seen) as (select rid, rid from s union select r.rid, e.b from r join e on e.a = r.seen),
  m as (select r.rid, min(t.doc_id) component_id from r join s t on t.rid = r.seen group by r.rid)
select s.doc_id, len(s.s)::bigint n_shingles, m.component_id, coalesce(s.doc_id = m.component_id, false) kept from s join m using (rid)
"""
