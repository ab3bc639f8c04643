"""Arrow-batched access to whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that a kernel holds at a time; bounds a Python worker's memory whatever the texts' lengths.
BLOCK_CHARS = 600_000


def blocks(batches: Iterable[pa.RecordBatch], text: int, limit: int = BLOCK_CHARS) -> Iterator[list[list]]:
    """Column lists of whole rows, at most about ``limit`` characters of column ``text`` together.

    A text longer than the limit is a block of its own; none is cut.
    """
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start, used = 0, 0
        for i, t in enumerate(columns[text]):
            n = len(t) if t is not None else 0
            if used and used + n > limit:
                yield [c[start:i] for c in columns]
                start, used = i, 0
            used += n
        if columns and start < len(columns[0]):
            yield [c[start:] for c in columns]


#: Keys that a task remembers to leave out repetitions; beyond it they may come again.
REMEMBERED = 200_000


def map_blocks(df: DataFrame, text: str, kernel: Callable[..., list], schema: str, arrow: pa.Schema, once: str | None = None) -> DataFrame:
    """``kernel(*column_lists)`` over blocks of rows; it returns arrays in the order of ``schema``.

    With ``once`` rows whose value of that column the task has had already are left out, which
    combines copies before a shuffle.
    """
    at = df.columns.index(text)
    key = df.columns.index(once) if once else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set = set()
        for columns in blocks(batches, at):
            if key is not None:
                if len(had) > REMEMBERED:
                    had.clear()
                new = [k for k, v in enumerate(columns[key]) if not (v in had or had.add(v))]
                if len(new) < len(columns[key]):
                    columns = [[c[k] for k in new] for c in columns]
                if not new:
                    continue
            out = kernel(*columns)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
