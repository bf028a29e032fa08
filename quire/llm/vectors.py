"""What both searches share: which vectors take part, and blocks of queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id bigint, v array<float> or array<double>, as the table has it), one row a row.

    Left out: null ids, null vectors, vectors with null or non-finite components, if ``nonzero`` zero vectors (an empty
    one is zero). Rows that repeat an id all take part. Vectors of unequal length are compared as if zeros followed the
    shorter one.
    """
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    df = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast(kind).alias("v"))
    df = df.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return df.where("exists(v, x -> x <> 0)") if nonzero else df


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows of doubles; what is missing of ``width`` (the longest, if not given) counts 0, what is over it is left out."""
    rows = vectors.tolist() if hasattr(vectors, "tolist") else list(vectors)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    width = int(size.max(initial=0)) if width is None else width
    if len(rows) and (size == width).all():
        return np.array(rows, dtype=np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        n = min(len(r), width)
        out[i, :n] = r[:n]
    return out


def query_blocks(queries: DataFrame, most: int):
    """Yields (ids, matrix) blocks of about ``most`` queries at most; what one block needs on the driver is bounded."""
    n = queries.count()
    parts = max(1, -(-n // most))
    for b in range(parts if n else 0):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).collect() if parts > 1 else queries.collect()
        if rows:
            rows.sort(key=lambda r: (r["id"], r["v"]))
            yield np.array([r["id"] for r in rows], dtype=np.int64), matrix([r["v"] for r in rows])
