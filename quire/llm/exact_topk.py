"""Exact top-k search by distributed histogram selection.

Every query's score against every vector is computed, in scans that keep no scores. In each round a histogram of
``BINS`` bins over the interval that holds the kth value is merged over all tasks, and the interval shrinks to one bin;
once it is one integer wide the kth value is known. A last scan keeps what lies above it, and of the ties at it the k
smallest ids of each task, and ties go to the smaller ids overall.

Queries come in blocks (``block`` at most, about ``block`` * length * 8 bytes sent to each task), each scored against all
vectors; vectors are never shuffled. A task sends at most k bins a query and round, and at most 2k rows a query at last.
Scores are exact integers: float64 products where every sum stays under 2 to the 53rd, Python integers elsewhere; a score
beyond a long counts as the nearest long. Vectors of unequal length are multiplied as far as the shorter one goes. The rows
of a block of queries are appended to one folder in shared storage.

Defined results: see ``vectors.usable`` for what takes part; a query's own id is no candidate; rows that repeat an id are
candidates each, and as queries share one list; fewer than k candidates are all returned; an empty table or no query gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import shared_dir, table
from quire.llm.vectors import matrix, query_blocks, usable

BINS = 1024
LONG = 2**63 - 1
#: Scores held at once in a task.
CELLS = 4_000_000


def _scores(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int64 scores, vectors by queries; mask of pairs that count)."""
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * v.shape[1] < 2**53:
        s = np.rint(v @ q.T).astype(np.int64)
    else:
        big = np.array([[int(x) for x in r] for r in v], dtype=object) @ np.array([[int(x) for x in r] for r in q], dtype=object).T
        s = np.clip(big, -LONG, LONG).astype(np.int64)
    return s, ids[:, None] != q_ids[None, :]


def _chunks(batches: Iterator[pd.DataFrame], scale: float, n_queries: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, n_queries, width))
    for b in batches:
        for i in range(0, len(b), step):
            part = b.iloc[i : i + step]
            yield part["id"].to_numpy(np.int64), np.floor(scale * matrix(part["v"], width))


def _narrow(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Widths of bins that cover [low, high) (Python integers: the span may exceed a long)."""
    return np.array([max(1, -((int(a) - int(b)) // BINS)) for a, b in zip(low, high, strict=True)], dtype=object)


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 1.0, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k largest integer inner products of floor(scale * x).

    ``vectors`` and ``queries`` are (id, v) as from ``usable``.
    """
    spark = vectors.sparkSession
    largest = vectors.select(F.max(F.aggregate(F.transform("v", lambda x: F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x))).first()[0] or 0.0
    path, blocks = f"{shared_dir(spark)}/quire-topk-{uuid.uuid4().hex}", 0
    for q_ids, raw in query_blocks(queries, block):
        q = np.floor(scale * raw)
        with np.errstate(over="ignore"):
            far = np.sqrt(largest) * np.sqrt((q**2).sum(axis=1))
        reach = [min(LONG, int(x) + 2) if np.isfinite(x) else LONG for x in far]
        low, high = np.array([-r for r in reach], dtype=object), np.array([r + 1 if r < LONG else LONG for r in reach], dtype=object)
        above = np.zeros(len(q), dtype=np.int64)  # scores at or over high
        few = np.zeros(len(q), dtype=bool)  # fewer than k candidates in all: everything is kept
        while True:
            width = _narrow(low, high)
            open_ = ~few & np.array([h - x > 1 for x, h in zip(low, high, strict=True)])
            if not open_.any():
                break
            at = np.flatnonzero(open_)
            sent = spark.sparkContext.broadcast((q_ids[at], q[at], low[at], high[at], width[at], k - above[at]))

            def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                ids_q, mat, lo, hi, wide, need = sent.value
                span = np.array([int(h) - int(x) for x, h in zip(lo, hi, strict=True)], dtype=np.uint64)
                lo64, wide64 = lo.astype(np.int64), np.array([min(int(w), LONG) for w in wide], dtype=np.int64)
                hist = np.zeros((len(ids_q), BINS), dtype=np.int64)
                floor = np.zeros(len(ids_q), dtype=np.int64)  # bins under it can't hold the kth value
                for ids, v in _chunks(batches, scale, len(ids_q), mat.shape[1]):
                    s, ok = _scores(ids, v, ids_q, mat)
                    least = np.array([min(LONG, int(a) + int(b) * int(w)) for a, b, w in zip(lo, floor, wide, strict=True)], dtype=np.int64)
                    r, c = np.nonzero((s >= least[None, :]) & ok)
                    if not len(r):
                        continue
                    off = s[r, c].astype(np.uint64) - lo64[c].astype(np.uint64)  # wraps to the true difference
                    bins = (off // wide64[c].astype(np.uint64)).astype(np.int64)
                    inside = off < span[c]  # what lies over the interval was counted before
                    np.add.at(hist, (c[inside], bins[inside]), 1)
                    tail = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
                    floor = np.maximum(0, (tail >= need[:, None]).sum(axis=1) - 1)
                tail = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
                floor = np.maximum(0, (tail >= need[:, None]).sum(axis=1) - 1)
                r, b = np.nonzero(hist * (np.arange(BINS)[None, :] >= floor[:, None]))
                yield pd.DataFrame({"q": r.astype(np.int64), "bin": b.astype(np.int32), "n": hist[r, b]})

            sums = vectors.mapInPandas(count, "q bigint, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            need = spark.createDataFrame([(i, int(k - above[a])) for i, a in enumerate(at)], "q bigint, need bigint")
            run = sums.selectExpr("q", "bin", "n", "sum(n) over (partition by q order by bin desc) as over")
            picked = run.join(F.broadcast(need), "q").groupBy("q").agg(F.max(F.when(F.col("over") >= F.col("need"), F.struct("bin", F.col("over") - F.col("n")))).alias("at")).collect()
            got = {r["q"]: r["at"] for r in picked}
            for i, a in enumerate(at):
                hit = got.get(i)
                if hit is None:  # only in the first round: fewer than k candidates
                    few[a] = True
                else:
                    low[a], above[a] = low[a] + hit[0] * width[a], above[a] + hit[1]
                    high[a] = min(high[a], low[a] + width[a])
        kth = np.where(few, -LONG, low).astype(np.int64)
        last = spark.sparkContext.broadcast((q_ids, q, kth))

        def keep(batches: Iterator[pd.DataFrame], last=last) -> Iterator[pd.DataFrame]:
            ids_q, mat, kth = last.value
            ties: list[tuple[np.ndarray, np.ndarray]] = []
            for ids, v in _chunks(batches, scale, len(ids_q), mat.shape[1]):
                s, ok = _scores(ids, v, ids_q, mat)
                r, c = np.nonzero((s > kth[None, :]) & ok)
                yield pd.DataFrame({"query_id": ids_q[c], "vec_id": ids[r], "score": s[r, c]})
                r, c = np.nonzero((s == kth[None, :]) & ok)
                ties.append((c, ids[r]))
                if sum(len(t[0]) for t in ties) > CELLS // 4:
                    ties = [_smallest(ties, k)]
            c, i = _smallest(ties, k)
            yield pd.DataFrame({"query_id": ids_q[c], "vec_id": i, "score": kth[c]})

        kept = vectors.mapInPandas(keep, "query_id bigint, vec_id bigint, score bigint")
        ranked = kept.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)
        ranked.write.mode("append").parquet(path)  # a block's queries are in no other
        blocks += 1
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    return spark.read.schema(out).parquet(path) if blocks else spark.createDataFrame([], out)


def _smallest(ties: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (query, id) ties, the k smallest ids of each query."""
    if not ties:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, i = np.concatenate([t[0] for t in ties]), np.concatenate([t[1] for t in ties])
    order = np.lexsort((i, c))
    c, i = c[order], i[order]
    start = np.searchsorted(c, c, side="left")
    few = np.arange(len(c)) - start < k
    return c[few], i[few]


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=False)
    return search(vectors, vectors.where("id % 50 = 0"), k=5, scale=256.0)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  q as (select * from v where vec_id % 50 = 0),
  s as (select q.vec_id query_id, v.vec_id vec_id, coalesce(list_sum(list_transform(range(1, least(len(v.e), len(q.e)) + 1), lambda i: v.e[i] * q.e[i])), 0)::bigint score
    from q join v on q.vec_id <> v.vec_id),
  r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s)
select * from r where rank <= 5
"""
