"""Approximate nearest neighbours by balanced posting lists.

A sample (``sample_rows`` vectors at most) is clustered under a penalty on large clusters. Every vector then enters the
list of its closest centroid, and a boundary vector also those of further centroids almost as close (``replicas`` at most,
each nearer to the vector than to the centroids taken before). A query walks a neighbour graph over the centroids, held in
memory, and reads the lists within a ratio of its closest centroid's distance. Where ``probes`` such lists find less than
``recall`` of the neighbours of ``calibrated`` queries, told by a scan of the table, every query reads as many lists as do,
so the share of the index that is read doesn't shrink as lists become more. Distances are on unit vectors, so they order as
cosines do; scores returned are cosines of the original vectors in double precision.

Scale: centroids (``most_lists`` at most) are all that is broadcast. A list longer than ``list_rows`` is read as several
blocks, and many queries of one list as several blocks, so the work of a task is bounded whatever is hot. Of identical
vectors only the k + 1 smallest ids are listed, which loses nothing: no other of them can be among a query's k nearest.
The index is written once to shared storage, vectors in the table's own type.

Defined results: see ``vectors.usable`` for what takes part (no zero vectors); a query's own id is no candidate; of rows that
repeat an id each vector is searched, and rows that repeat id and vector count once; vectors of unequal length are compared
as if zeros followed the shorter ones (their longest is the width of the index); an empty table gives an empty result. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Stored, table
from quire.llm.vectors import matrix, usable


@dataclass(frozen=True)
class Params:
    sample_rows: int = 20_000
    most_lists: int = 4096
    list_target: int = 200  #: vectors a list is meant to hold, before replicas
    list_rows: int = 2000  #: rows of a list, or queries of it, that one task handles together
    replicas: int = 4
    boundary: float = 1.10  #: a further list's centroid is at most this much farther than the closest
    probes: int = 48  #: lists that a query reads at most, unless calibration asks for more
    ratio: float = 1.35  #: and only those at most this much farther than the closest
    least_rows: int = 64  #: but as many as hold so many rows
    beam: int = 96
    neighbours: int = 16
    recall: float = 0.99
    calibrated: int = 400  #: queries that the number of lists is calibrated with at most


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # squares of very large or small numbers leave the doubles' range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def balanced_clusters(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """n centroids of unit vectors: k-means whose distances are raised by a cluster's share of the rows before."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    load = np.zeros(n)
    for _ in range(rounds):
        best = np.empty(len(x), dtype=np.int64)
        for i in range(0, len(x), 4096):
            d = 2 - 2 * x[i : i + 4096] @ c.T
            best[i : i + 4096] = (d + 0.1 * d.min(axis=1).mean() * load[None, :]).argmin(axis=1)
        size = np.bincount(best, minlength=n)
        load = 0.5 * load + 0.5 * np.minimum(size * n / len(x), 8)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        full = size > 0
        c[full] = total[full] / np.maximum(np.linalg.norm(total[full], axis=1, keepdims=True), 1e-12)
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return _unit(c)


class Graph:
    """Centroids with each one's nearest neighbours, and a beam search over them for many queries at once."""

    def __init__(self, centroids: np.ndarray, p: Params):
        self.c, self.p = centroids, p
        n, near = len(centroids), min(p.neighbours, len(centroids) - 1)
        self.links = np.zeros((n, near + 2), dtype=np.int64)
        for i in range(0, n, 1024):
            s = centroids[i : i + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
            self.links[i : i + 1024, :near] = np.argsort(-s, axis=1)[:, :near]
        self.links[:, near] = (np.arange(n) + 1) % n  # a ring, so that all are reachable
        self.links[:, near + 1] = np.random.default_rng(3).integers(0, n, n)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, q: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of each query's closest found, nearest first; ``least`` of them at least."""
        nq, n = len(q), len(self.c)
        beam = min(n, max(self.p.beam, 2 * least))
        if least and 4 * beam >= n:  # a walk would see most centroids
            d = np.sqrt(np.maximum(2 - 2 * q @ self.c.T, 0))
            ids = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return ids, np.take_along_axis(d, ids, 1)
        ids = np.full((nq, beam), -1)
        dist = np.full((nq, beam), np.inf)
        done = np.ones((nq, beam), dtype=bool)
        seen = np.zeros((nq, n + 1), dtype=bool)

        def offer(new: np.ndarray) -> None:
            nonlocal ids, dist, done
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new[np.take_along_axis(seen, new, axis=1)] = n
            np.put_along_axis(seen, new, True, axis=1)
            seen[:, n] = False
            d = 2 - 2 * np.einsum("qd,qkd->qk", q, self.c[np.minimum(new, n - 1)])
            d[new == n] = np.inf
            i, e, b = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([done, new == n], 1)
            o = np.argsort(e, axis=1, kind="stable")[:, :beam]
            ids, dist, done = (np.take_along_axis(a, o, 1) for a in (i, e, b))

        offer(np.repeat(self.entry[None, :], nq, axis=0))
        while not done.all():
            at = done.argmin(axis=1)  # the nearest that is not expanded; of a finished query any, to no effect
            cur = ids[np.arange(nq), at]
            done[np.arange(nq), at] = True
            offer(self.links[np.maximum(cur, 0)].copy())
        return ids, np.sqrt(np.maximum(dist, 0))


def _takes(p: Params, ids: np.ndarray, dist: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Which of the lists found a query reads."""
    rank = np.arange(ids.shape[1])[None, :]
    held = np.cumsum(np.where(ids >= 0, size[ids], 0), axis=1)
    before = np.concatenate([np.zeros((len(ids), 1)), held[:, :-1]], axis=1)
    return (ids >= 0) & (((dist <= p.ratio * dist[:, :1] + 1e-9) & (rank < p.probes)) | (before < p.least_rows) | (rank < least))


class Index:
    """Fitted centroids and the posting lists of all vectors."""

    def __init__(self, vectors: DataFrame, k: int, params: Params | None = None):
        self.p, self.k, self.vectors = params or Params(), k, vectors
        p, spark = self.p, vectors.sparkSession
        self.kind = dict(vectors.dtypes)["v"]
        self.spark, (rows, width) = spark, vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        self.rows, self.width = rows, width
        if not rows:
            return
        share = min(1.0, 1.2 * p.sample_rows / rows)
        picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(p.sample_rows).collect()
        sample = _unit(matrix([r["v"] for r in sorted(picked, key=lambda r: (r["id"], r["v"]))] or [vectors.first()["v"]], width))
        n = int(min(p.most_lists, max(1, rows // p.list_target), max(1, len(sample) // 8)))
        self.centroids = balanced_clusters(sample, n)
        sent = spark.sparkContext.broadcast(self.centroids)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = sent.value
            between = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
            for b in batches:
                for i in range(0, len(b), 2048):
                    part = b.iloc[i : i + 2048]
                    d = np.sqrt(np.maximum(2 - 2 * _unit(matrix(part["v"], width)) @ c.T, 0))
                    near = np.argsort(d, axis=1, kind="stable")[:, : 2 * p.replicas]
                    r, lists = [], []
                    for j, row in enumerate(near):
                        taken = [row[0]]
                        for x in row[1:]:
                            if len(taken) < p.replicas and d[j, x] <= p.boundary * d[j, row[0]] and all(between[x, t] > d[j, x] for t in taken):
                                taken.append(x)
                        r += [j] * len(taken)
                        lists += taken
                    out = part.iloc[r]
                    yield pd.DataFrame({"list": np.array(lists, dtype=np.int32), "id": out["id"].to_numpy(), "v": out["v"].to_numpy()})

        self.lists = Stored(self._distinct(vectors).mapInPandas(place, f"list int, id bigint, v {self.kind}"), "postings")
        self.sizes = {r["list"]: r["count"] for r in self.lists.df.groupBy("list").count().collect()}  # most_lists rows at most

    def _distinct(self, vectors: DataFrame) -> DataFrame:
        """Of identical vectors the k + 1 smallest ids: first within salted groups, then over them."""
        keyed = vectors.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        keys = keyed.select("id", "h", "salt").distinct()
        for by in ("h, salt", "h"):
            keys = keys.selectExpr("id", "h", "salt", f"row_number() over (partition by {by} order by id) as rn").where(f"rn <= {self.k + 1}").drop("rn")
        # an equal hash of different vectors must not lose one: only vectors equal to a kept one go
        dropped = keyed.select("id", "h").join(keys.select("id", "h"), ["id", "h"], "left_anti").distinct()
        if not dropped.limit(1).count():
            return vectors
        kept = keyed.join(keys.select("id", "h"), ["id", "h"], "left_semi").select("id", "v")
        first = keyed.join(keys.groupBy("h").agg(F.min("id").alias("id")), ["id", "h"], "left_semi").select("h", F.col("v").alias("w")).dropDuplicates(["h"])
        odd = keyed.join(dropped, ["id", "h"], "left_semi").join(first, "h").where("v <> w").select("id", "v")
        return kept.unionByName(odd)

    def lists_needed(self, queries: DataFrame) -> int:
        """How many lists a query has to read for ``recall``; 0 if ``probes`` and ``ratio`` suffice."""
        p, k, n = self.p, self.k, len(self.centroids)
        picked = queries.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(p.calibrated).collect()
        if n == 1 or not picked:
            return 0
        width = self.width
        q_ids, q = np.array([r["id"] for r in picked]), _unit(matrix([r["v"] for r in picked], width))
        sent = self.spark.sparkContext.broadcast((q_ids, q))

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q = sent.value
            at, best, score = np.arange(len(q))[:, None], np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
            for b in batches:
                for i in range(0, len(b), 2048):
                    part = b.iloc[i : i + 2048]
                    ids, s = part["id"].to_numpy(np.int64), q @ _unit(matrix(part["v"], width)).T
                    s[q_ids[:, None] == ids[None, :]] = -9
                    best, score = np.concatenate([best, np.broadcast_to(ids, s.shape)], 1), np.concatenate([score, s], 1)
                    o = np.argpartition(-score, k - 1, axis=1)[:, :k] if score.shape[1] > k else np.arange(score.shape[1])[None, :]
                    best, score = best[at, o], score[at, o]
            r, c = np.nonzero(score > -9)
            yield pd.DataFrame({"q": r, "id": best[r, c], "s": score[r, c]})

        near = self.vectors.mapInPandas(nearest, "q bigint, id bigint, s double")
        near = near.selectExpr("q", "id", "row_number() over (partition by q order by s desc, id) as r").where(F.col("r") <= k).select("q", "id")
        truth = [(r["q"], r["id"]) for r in near.collect()]  # calibrated * k at most
        if not truth:
            return 0
        wanted = F.broadcast(self.spark.createDataFrame(sorted({(i,) for _, i in truth}), "id bigint"))
        where: dict[int, list[int]] = {}
        for r in self.lists.df.join(wanted, "id").select("id", "list").collect():
            where.setdefault(r["id"], []).append(r["list"])
        d = np.sqrt(np.maximum(2 - 2 * q @ self.centroids.T, 0))
        order = np.argsort(d, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[None, :].repeat(len(q), 0), 1)
        size = np.array([self.sizes.get(i, 0) for i in range(n)])
        read = _takes(p, order, np.take_along_axis(d, order, 1), size, 0)
        read[:, p.beam :] = False
        need = np.sort([0 if any(read[j, rank[j, x]] for x in at) else 1 + min(rank[j, x] for x in at) for j, i in truth if (at := where.get(i))])
        return int(need[min(len(need) - 1, int(np.ceil(p.recall * len(need))))]) if len(need) else 0

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score: each query's k nearest found."""
        out = "query_id bigint, rank int, vec_id bigint, score double"
        if not self.rows:
            return self.spark.createDataFrame([], out)
        p, k, width, kind = self.p, self.k, self.width, self.kind
        least = self.lists_needed(queries)
        step = max(8, min(256, 20_000 // max(1, least)))
        sent = self.spark.sparkContext.broadcast((self.centroids, self.sizes))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centroids, sizes = sent.value
            size = np.array([sizes.get(i, 0) for i in range(len(centroids))])
            graph = Graph(centroids, p)
            for b in batches:
                for i in range(0, len(b), step):
                    part = b.iloc[i : i + step]
                    ids, dist = graph.search(_unit(matrix(part["v"], width)), least)
                    r, c = np.nonzero(_takes(p, ids, dist, size, least))
                    out = part.iloc[r]
                    yield pd.DataFrame({"list": ids[r, c].astype(np.int32), "id": out["id"].to_numpy(), "v": out["v"].to_numpy()})

        probes = Stored(queries.mapInPandas(probe, f"list int, id bigint, v {kind}"), "probes")
        asked = {r["list"]: r["count"] for r in probes.df.groupBy("list").count().collect()}
        cut = [(i, max(1, -(-n // p.list_rows)), max(1, -(-asked.get(i, 0) // p.list_rows))) for i, n in self.sizes.items() if asked.get(i)]
        blocks = F.broadcast(self.spark.createDataFrame(cut or [(-1, 1, 1)], "list int, nb int, nq int"))  # most_lists rows at most
        some = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        left = self.lists.df.join(blocks, "list").withColumn("b", part("nb")).withColumn("q", F.explode(some("nq"))).select("list", "b", "q", "id", "v", F.xxhash64("v").alias("h"))
        right = probes.df.join(blocks, "list").withColumn("q", part("nq")).withColumn("b", F.explode(some("nb"))).select("list", "b", "q", "id", "v")

        def near(lists: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            if not len(lists) or not len(qs):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "h": []}).astype({"query_id": "int64", "vec_id": "int64", "h": "int64"})
            v, q = matrix(lists["v"], width), matrix(qs["v"], width)
            ids, q_ids = lists["id"].to_numpy(np.int64), qs["id"].to_numpy(np.int64)
            s = _unit(q) @ _unit(v).T
            s[q_ids[:, None] == ids[None, :]] = -9
            if s.shape[1] > k:
                least = np.partition(s, -k, axis=1)[:, -k]
                r, c = np.nonzero((s >= least[:, None] - 1e-12) & (s > -9))
            else:
                r, c = np.nonzero(s > -9)
            found = pd.DataFrame({"query_id": q_ids[r], "vec_id": ids[c], "score": cosine(q[r], v[c]), "h": lists["h"].to_numpy(np.int64)[c]})
            return found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

        hits = left.groupBy("list", "b", "q").cogroup(right.groupBy("list", "b", "q")).applyInPandas(near, "query_id bigint, vec_id bigint, score double, h bigint")
        once = hits.groupBy("query_id", "vec_id", "h").agg(F.max("score").alias("score"))
        return once.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines row by row; each row's figure depends on that row alone."""
    ma, mb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    big = (ma > 1e100) | (mb > 1e100) | (ma < 1e-100) | (mb < 1e-100)
    a, b = np.where(big, a / ma, a), np.where(big, b / mb, b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    return Index(vectors, k=5).search(vectors.where("id % 50 = 0"))
