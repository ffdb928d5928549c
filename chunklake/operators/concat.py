"""Ordered concatenation of binary parts: streamed from sorted rows, so that only the result is ever held."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed(rows: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """(keys, _order, _data), the rows of one key together and in order. Keys are never split over tasks."""
    picked = rows.select(*keys, F.col(order).alias("_order"), F.col(data).cast("binary").alias("_data"))
    return picked.repartition(*keys).sortWithinPartitions(*keys, "_order")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list, bool]]:
    """(key, data of consecutive rows, whether the key begins) from batches of keyed()."""
    now: tuple | None = None
    for rb in batches:
        keys = list(zip(*(rb.column(i).to_pylist() for i in range(n_keys))))
        data = rb.column(n_keys + 1)
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            yield keys[a], data.slice(a, b - a).to_pylist(), keys[a] != now
            now, a = keys[a], b


def concatenated(rows: DataFrame, keys: list[str], order: str, data: str, out: str) -> DataFrame:
    """(keys, out): each key's data, one after the other by `order`; null data adds nothing. A result is one row, of at most 2 GiB."""
    source = keyed(rows, keys, order, data)
    schema = T.StructType([*(source.schema[k] for k in keys), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, key, parts, held, size = None, None, [], [], 0

        def seen():
            nonlocal types
            for rb in batches:
                types = [rb.schema.field(i).type for i in range(len(keys))]
                yield rb

        def batch() -> pa.RecordBatch:
            cols = [pa.array(list(c), t) for c, t in zip(zip(*(h[0] for h in held)), types)] if keys else []
            return pa.RecordBatch.from_arrays([*cols, pa.array([h[1] for h in held], pa.binary())], names=[*keys, out])

        for k, values, begins in groups(seen(), len(keys)):
            if begins:
                if key is not None:
                    held.append((key, b"".join(parts)))
                    size += len(held[-1][1])
                if size > 16 << 20:
                    yield batch()
                    held, size = [], 0
                key, parts = k, []
            parts += [v for v in values if v is not None]
        if key is not None:
            held.append((key, b"".join(parts)))
        if held:
            yield batch()

    return source.mapInArrow(run, schema)
