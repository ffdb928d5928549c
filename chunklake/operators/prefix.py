"""Running sums over a whole table in two levels, without sorting it into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunklake.session import stage

_OWN = ("_prefix_p", "_prefix_w", "_prefix_k")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows (the value last), with the partition's number, the sum before each row, and its place."""
    own, total, rows = TaskContext.get().partitionId(), 0, 0
    for rb in batches:
        v = rb.column(rb.num_columns - 1).to_numpy(zero_copy_only=False)
        after = total + np.cumsum(v)
        cols = [np.full(len(v), own, np.int32), after - v, rows + np.arange(len(v))]
        yield pa.RecordBatch.from_arrays([*rb.columns[:-1], *map(pa.array, cols), pa.array(v)], names=[*rb.schema.names[:-1], *_OWN, "_prefix_v"])
        total, rows = total + int(v.sum()), rows + len(v)


def global_running_sum(df: DataFrame, order: list[Column], value: str, out: str, rank: str | None = None) -> DataFrame:
    """Adds the exclusive running sum of `value` in the given order, and with `rank` the 0-based position. Null values add nothing.

    Rows are range-partitioned, sorted, summed where they are and written: one shuffle. Only one sum and count for each partition is folded
    in a second step (as many rows as partitions) and joined back. `order` must be total; keep the rows narrow.
    """
    sorted_ = df.withColumn("_prefix_v", F.coalesce(F.col(value).cast("long"), F.lit(0))).repartitionByRange(*order).sortWithinPartitions(*order)
    names = [T.StructField("_prefix_p", T.IntegerType()), T.StructField("_prefix_w", T.LongType()), T.StructField("_prefix_k", T.LongType()), T.StructField("_prefix_v", T.LongType())]
    part = stage(sorted_.mapInArrow(_within, T.StructType([*df.schema.fields, *names])), "ranges")
    totals = part.groupBy("_prefix_p").agg(F.sum("_prefix_v").alias("_prefix_s"), F.count(F.lit(1)).alias("_prefix_n"))
    w = Window.orderBy("_prefix_p").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_prefix_p", F.coalesce(F.sum("_prefix_s").over(w), F.lit(0)).alias("_prefix_s"), F.coalesce(F.sum("_prefix_n").over(w), F.lit(0)).alias("_prefix_n"))
    got = part.join(F.broadcast(base), "_prefix_p").withColumn(out, (F.col("_prefix_s") + F.col("_prefix_w")).cast("long"))
    if rank:
        got = got.withColumn(rank, (F.col("_prefix_n") + F.col("_prefix_k")).cast("long"))
    return got.drop(*_OWN, "_prefix_v", "_prefix_s", "_prefix_n")
