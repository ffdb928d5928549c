"""Run lengths and change points over ordered rows, registries of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.operators.prefix import global_running_sum


def _order(keys: list[str], pos: str):
    return Window.partitionBy(*keys).orderBy(pos)


def runs(df: DataFrame, keys: list[str], pos: str, value: str, contiguous: bool = False) -> DataFrame:
    """(keys, run_no, run_start, run_length, value): islands of equal values in order; with contiguous a gap in pos ends one too.
    Nulls equal each other. run_no counts from 0."""
    w = _order(keys, pos)
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    if contiguous:
        same = same & F.coalesce(F.col(pos) == F.lag(pos).over(w) + 1, F.lit(False))
    marked = df.select(*keys, pos, value, F.when(same, 0).otherwise(1).alias("_new"))
    numbered = marked.withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "run_no").agg(F.min(pos).alias("run_start"), F.count(F.lit(1)).alias("run_length"), F.first(value).alias(value))


def expand_runs(rl: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, pos, value): inverse of runs over positions counted from 0."""
    w = Window.partitionBy(*keys).orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    based = rl.withColumn("_base", F.coalesce(F.sum("run_length").over(w), F.lit(0)))
    return based.filter("run_length > 0").select(*keys, F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("run_length") - 1)).alias("pos"), value)


def change_points(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of each key counts."""
    w = _order(keys, pos)
    return df.withColumn("_was", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_was"))).select(*keys, pos, value)


def registry(df: DataFrame, value: str, first: list[str], length: Column) -> DataFrame:
    """(value, id, value_offset, value_length): ids from 0 by first appearance (the least `first` columns), and offsets of the values
    laid one after the other. Deterministic; numbered in two levels, so that a large registry isn't sorted into one task."""
    at = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*first)).alias("_at")).withColumn("value_length", length.cast("long"))
    return global_running_sum(at, [F.col("_at")], "value_length", "value_offset", "id").select(value, "id", "value_offset", "value_length")


def stream_offsets(df: DataFrame, keys: list[str], pos: str, size: Column) -> DataFrame:
    """Adds stream_offset, the exclusive running sum of size within the keys."""
    w = _order(keys, pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_size", size).withColumn("stream_offset", F.coalesce(F.sum("_size").over(w), F.lit(0)).cast("long")).drop("_size")


def next_start(df: DataFrame, keys: list[str], start: str, total: Column, out: str = "next_start") -> DataFrame:
    """Adds the next row's start, or `total` for the last."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(_order(keys, start)), total))
