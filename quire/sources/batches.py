"""Rows of files in and out of tasks a few at a time, whatever the size of the engine's batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def handed_on(batches: Iterator[pa.RecordBatch], read: Callable[..., Iterable[tuple]], fields: list[tuple[str, str]], most: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that ``read`` gives: one row of what comes is turned into Python's values at a time, ``most`` rows or ``size`` bytes are held."""
    names, types = [n for n, _ in fields], [_TYPES[t] for _, t in fields]
    held, weight = [], 0
    told = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
    for b in batches:
        for row in zip(*b.columns, strict=True):
            for out in read(*[x.as_py() for x in row]):
                held.append(out)
                weight += sum(len(x) for x in out if isinstance(x, str | bytes))
                if len(held) >= most or weight >= size:
                    yield told()
                    held, weight = [], 0
    if held:
        yield told()


def mapped(rows: DataFrame, read: Callable[..., Iterable[tuple]], shape: str, most: int = 4096, size: int = 4 << 20) -> DataFrame:
    """The rows (shape) that ``read`` gives of the values of each row, so that small files share a batch and large ones are not gathered."""
    fields = [tuple(c.split()) for c in shape.split(", ")]
    return rows.mapInArrow(lambda batches: handed_on(batches, read, fields, most, size), shape)


def few(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``size`` bytes, by what its rows have on average, and of one row at least."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    return (batch.slice(at, step) for at in range(0, batch.num_rows, step))
