"""Ordered event sequences walked in one pass, without a task that holds a whole sequence.

Events are range-partitioned by (key, time, id): every partition is a stretch of the one order of all events, of about
equal size whatever the keys are, so a key that holds a third of all rows, or all of them, spreads over many partitions.
A walk reads its partition once, in order. What may go on across an edge of a partition is marked; it is a few rows a
partition, which are put together afterwards. Their number grows with the partitions, not with the events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Walk = Callable[[Iterator[tuple], int], Iterator[tuple]]
#: Rows of a walk that are handed over at once.
ROWS = 10_000


def in_order(df: DataFrame, order: list[str], walk: Walk, schema: str, partitions: int | None = None) -> DataFrame:
    """What walk(rows, partition) gives for each partition of df's rows in order; the order must tell rows apart, but for
    rows that are delivered again, which stand side by side. partitions: as many as shuffles have, if not given."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def batches(read: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in read for row in zip(*(c.to_pylist() for c in batch.columns)))
        made: list[tuple] = []
        for row in walk(rows, TaskContext.get().partitionId()):
            made.append(row)
            if len(made) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)

    return df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(batches, out)
