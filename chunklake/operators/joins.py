"""Joins that the plain join operator lacks: checked equi-joins, interval overlap, as-of, positional, default-valued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunklake.session import stage


def checked_join(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """left join right on key, where a row without a partner is an error when it is read; order columns are kept as they are."""
    there = right.withColumn("_there", F.lit(True))
    got = left.join(there, key, "left")
    miss = F.raise_error(F.concat(F.lit(f"{what}: no such {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return got.filter(F.when(F.col("_there").isNull(), miss.cast("boolean")).otherwise(F.lit(True))).drop("_there")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of left that right lacks; null keys are no keys."""
    return left.filter(F.col(key).isNotNull()).select(key).distinct().join(right.select(key), key, "left_anti")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], lstart: str, lend: str, rstart: str, rend: str, bucket: int, how: str = "inner") -> DataFrame:
    """Pairs whose half-open intervals overlap: each side is spread over buckets of `bucket` positions, an equi-join on keys and
    bucket finds candidates, and a pair counts in the bucket where its overlap begins only. Never a nested loop.

    Empty intervals overlap where they lie strictly inside the other one. how: inner or left. Choose bucket near the longer
    side's usual length: a row is copied for each bucket it touches. Positions are whole numbers from 0. Columns of the two sides need different names, keys apart.
    """
    spread = lambda df, a, b: df.withColumn("_b", F.explode(F.expr(f"sequence({a} div {bucket}, (greatest({b}, {a} + 1) - 1) div {bucket})")))
    lo = F.expr(f"greatest({lstart}, {rstart}) div {bucket}")
    if how == "left":
        # The rows' numbers must not change between the two uses: they are written once.
        left = stage(left.withColumn("_id", F.monotonically_increasing_id()), "interval")
    pairs = spread(left, lstart, lend).join(spread(right, rstart, rend), [*keys, "_b"]).filter((F.col(lstart) < F.col(rend)) & (F.col(lend) > F.col(rstart)) & (lo == F.col("_b"))).drop("_b")
    if how == "inner":
        return pairs
    own = [c for c in right.columns if c not in keys]
    return left.join(pairs.select("_id", *own), "_id", "left").drop("_id")


def asof(points: DataFrame, changes: DataFrame, keys: list[str], at: str, since: str, value: str, default: Column | None = None) -> DataFrame:
    """Each point with the value of the last change at or before it; `default` (or null) before the first change.

    Union, then a carry-forward window for each key: one shuffle, no pairs. Of changes at one place the largest value counts.
    """
    c = changes.groupBy(*keys, F.col(since).alias("_at")).agg(F.max(value).alias("_v")).select(*keys, "_at", "_v", F.lit(0).alias("_kind"))
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(c, allowMissingColumns=True).withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1")
    v = F.col("_hit") if default is None else F.coalesce("_hit", default)
    return got.select("_row.*", v.alias(value))


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """left join right on key, with `default` for `column` where there is no partner or the value is null."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), default))
