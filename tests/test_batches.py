"""Files pass through tasks a few at a time and are made once."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa

from quire.sources import books
from quire.sources.batches import handed_on


def test_rows_are_handed_on_before_many_are_held():
    taken = []

    def read(n: int, text: str) -> Iterator[tuple]:
        taken.append(n)
        yield from ((text, n, None) for _ in range(n))

    batch = pa.RecordBatch.from_pydict({"n": [0, 1, 2, 9], "text": ["a", "b" * 50, "c" * 50, "d"]})
    fields = [("text", "string"), ("n", "bigint"), ("x", "double")]
    steps = handed_on(iter([batch]), read, fields, 4, 100)
    first = next(steps)
    assert first.num_rows == 2 and taken == [0, 1, 2]  # a hundred bytes are held
    rest = list(steps)
    assert [b.num_rows for b in rest] == [4, 4, 2] and rest[-1].to_pylist()[-1] == {"text": "d", "n": 9, "x": None}
    assert list(handed_on(iter([]), read, fields, 4, 100)) == []


def test_files_of_books_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    files = books.packed(spark.sql("""select id || '' as path, array(named_struct('name', 'META-INF/container.xml', 'text', '<c><rootfile full-path="a.opf"/></c>'),
     named_struct('name', 'a.opf', 'text', '<p><item id="i" href="x.xhtml" media-type="x"/><itemref idref="i"/></p>'), named_struct('name', 'x.xhtml', 'text', 'text ' || id)) as files from range(5)"""))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made.add(len(b))
            yield b

    made_of = books.Epub(files.mapInPandas(counted, "path string, content binary"))
    assert sorted((r["path"], r["section"], r["size"]) for r in made_of.sections().collect()) == [(str(i), 0, 6) for i in range(5)] and made.value == 5
    found = made_of.chapters().collect()
    assert sorted((r["path"], r["section"], r["html"]) for r in found) == [(str(i), 0, f"text {i}") for i in range(5)] and made.value == 5
