"""Python work on groups of rows, such as the elements of a page, in Arrow batches of many groups.

Rows are parted by key into a fixed number of partitions, which adaptive execution doesn't merge however small they are,
and sorted there; a batch is cut where the key changes, and what a group adds is appended to the batch's own columns.
A group must fit into one task; pages do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.session import by_key

#: From a group's columns (arrays of numbers, lists of strings) to new columns.
Work = Callable[[dict[str, Any]], "tuple | list"]


def _column(c: pa.ChunkedArray) -> Any:
    return c.to_numpy() if pa.types.is_floating(c.type) or (pa.types.is_integer(c.type) and not c.null_count) else c.to_pylist()


def per_group(df: DataFrame, on: list[str], order: list[str], work: Work, adds: str, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns, if not given) and what work adds to each row of its group, in the order of order.
    With keep == on, work may give any number of rows."""
    keep = list(df.columns) if keep is None else keep
    fresh = keep == on
    added = T._parse_datatype_string(adds)
    out = T.StructType([*[df.schema[k] for k in keep], *added.fields])
    arrow = to_arrow_schema(added)

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {n: _column(table.column(n)) for n in table.column_names}
        ends = np.append(starts[1:], table.num_rows)
        made: list[list] = [[] for _ in arrow]
        rows = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            new = work({n: c[a:b] for n, c in columns.items()})
            for m, x in zip(made, new):
                m.extend(x.tolist() if isinstance(x, np.ndarray) else x)
            if fresh:
                rows += [a] * len(new[0])
        own = table.select(keep)
        if fresh:
            own = own.take(pa.array(rows, pa.int64()))
        for m, field in zip(made, arrow):
            own = own.append_column(field.name, pa.array(m, field.type))
        yield from own.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in on:
                codes = pc.dictionary_encode(table.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            if len(starts) > 1:
                yield from done(table.slice(0, starts[-1]), starts[:-1])
            left = table.slice(starts[-1])
        if left is not None:
            yield from done(left, np.zeros(1, int))

    return by_key(df, *on).sortWithinPartitions(*on, *order).mapInArrow(run, out)
