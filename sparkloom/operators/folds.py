"""Folds over a key's rows in order, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def ordered_fold(rows: DataFrame, key: str, order: list[str], values: list[Column], zero: tuple, step: Callable, out: StructType) -> DataFrame:
    """One row a key: the key and the state that `step(state, *values)` ends in.

    Keys are sorted within partitions, where Spark spills, and walked batch by
    batch with one state carried over: a key's rows never meet in memory. A
    key's walk is one task's, since each step needs the one before.
    """
    schema = StructType([StructField(key, rows.schema[key].dataType), *out.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda c: [list(v.items()) if isinstance(v, dict) else v for v in c]
        give = lambda done: pa.RecordBatch.from_arrays([pa.array(plain(c), f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        state, now = None, None
        for b in batches:
            done = []
            for k, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, *state))
                    now, state = k, zero
                state = step(state, *x)
            if done:
                yield give(done)
        if state is not None:
            yield give([(now, *state)])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key).sortWithinPartitions(key, *order).select(key, *values).mapInArrow(run, schema)
