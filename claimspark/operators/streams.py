"""Pages of a table, one after another, to a Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a task passes on.
BATCH = 4096


def dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with a page, dealt out by page and sorted."""
    return rows.where(F.col("page").isNotNull()).repartition("page").sortWithinPartitions("page", *order)


def each_chunk(rows: DataFrame, steps: list[Callable[[dict], dict]], schema: str, together: bool = False) -> DataFrame:
    """What ``steps``, one after another, make of some whole pages: a dict of columns by name, texts as Arrow arrays and all else as
    numpy arrays, and ``pid``, the number of a row's page in the chunk; a null number is a NaN. Of the last step the columns of ``schema`` are kept.

    A task holds a batch and one page at a time. ``together``: the rows of a page come one after another in one task as it is,
    as where they follow from a window over the page without a shuffle; else they are dealt out and sorted.
    """
    to = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: c.chunk(0) if pa.types.is_string(c.type) else c.to_numpy()
        c = {k: column(t[k]) for k in names}
        c["pid"] = np.cumsum(np.append(False, c["page"][1:] != c["page"][:-1]))
        for step in steps:
            c = step(c)
        return pa.RecordBatch.from_arrays([pa.array(c[f.name], from_pandas=pa.types.is_integer(f.type)).cast(f.type) for f in to], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            page = b.column(0).to_numpy()
            cut = len(page) - int(np.argmax(page[::-1] != page[-1])) if page[0] != page[-1] else 0
            if cut:
                held.append(b.slice(0, cut))
            elif held and held[-1].column(0)[held[-1].num_rows - 1].as_py() == page[-1]:
                held.append(b)
                continue
            if held:
                yield made(held)
            held = [b.slice(cut)]
        if held:
            yield made(held)

    return (rows.where(F.col("page").isNotNull()) if together else dealt(rows, [])).mapInArrow(run, schema)


def each_page(rows: DataFrame, order: list[str], read: Callable[[int, list[tuple]], Iterable[tuple]], schema: str, together: bool = False) -> DataFrame:
    """What ``read`` makes of each page: it gets the page and its rows, without the page, in order. A null page is left out.

    ``rows`` has the column page first. Pages are dealt out by page and read in sorted runs, so a task holds one page at a
    time. ``together``: they come so already, the rows of a page in any order, and ``read`` sorts them itself.
    """
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to)], schema=to)
        for b in batches:
            for page, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page != key and held:
                    out += read(key, held)
                    held = []
                key = page
                held.append(tuple(row))
            if len(out) >= BATCH:
                yield batch(out)
                out = []
        if held:
            out += read(key, held)
        if out:
            yield batch(out)

    return (rows.where(F.col("page").isNotNull()) if together else dealt(rows, order)).mapInArrow(run, schema)
