"""Filling fixed-capacity containers with items (problem 7): a plan over the histogram of lengths, then a join by rank."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.llm.tokens import VOCABULARY, token_counts
from chunklake.session import fitted, merged, stage

CAPACITY = 2048
#: Items are numbered by so many tasks a length that each takes about this many of all.
ITEMS_A_SALT = 250_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit by decreasing length, over counts: (rows, number of containers).

    A row (length, first, last, container, each) says: of the items of that length the ones with rank first..last go, `each`
    at a time, into the containers from `container` on. Containers with equal space left that were filled alike are one
    entry, whatever their number, so that time and size depend on the capacity and not on the number of items.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # (space left, first container, how many), sorted
    made = 0
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(open_, (length, -1, -1))
            if i < len(open_):
                space, first, many = open_.pop(i)
            else:
                each = capacity // length
                space, first, many = capacity, made, -(-left // each)
                made += many
            each = space // length
            whole = min(many, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each - 1, first, each))
                rank += whole * each
                left -= whole * each
                if space - each * length:
                    insort(open_, (space - each * length, first, whole))
            rest = many - whole
            if rest and left and left < each:
                rows.append((length, rank, rank + left - 1, first + whole, left))
                if space - left * length:
                    insort(open_, (space - left * length, first + whole, 1))
                rank += left
                left, rest, whole = 0, rest - 1, whole + 1
            if rest:
                insort(open_, (space, first + whole, rest))
    return rows, made


def packed_counts(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, tokens, container) for sizes (doc_id, tokens): the containers that hold the items.

    An item over the capacity, and no other, is split: into full pieces, which fill a container each, and a rest. Items of 0
    tokens take no space: one row with a null container. Equal rows are items of their own. Containers are numbered from 0.
    The histogram has at most `capacity` rows whatever the data; it alone reaches the driver, and the plan comes back.
    """
    full = F.expr(f"tokens div {capacity}").cast("int")
    rest = F.col("tokens") % capacity
    cut = F.when(
        F.coalesce("tokens", F.lit(0)) > capacity,
        F.concat(F.array_repeat(F.lit(capacity), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))),
    ).otherwise(F.array(F.coalesce("tokens", F.lit(0))))
    salts = max(1, -(-sizes.count() // ITEMS_A_SALT))
    items = sizes.select("doc_id", F.posexplode(cut).alias("piece", "tokens")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # Ranks within a length: by salt first, so that one length with a third of all items is numbered by many tasks.
    counts = stage(items.filter("tokens > 0").groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    rows, made = plan({r.tokens: r.n for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}, capacity)
    base = counts.select("tokens", "salt", (F.sum("n").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = items.filter("tokens > 0").withColumn("within", within).join(fitted(base), ["tokens", "salt"]).withColumn("rank", F.col("base") + F.col("within"))
    spark = sizes.sparkSession
    schema = "length int, first long, last long, container long, each long"
    slots = spark.createDataFrame(rows, schema)
    # The plan's size is bounded by the capacity (a few rows a length); beyond 100,000 rows it is merged.
    slots = F.broadcast(slots) if len(rows) <= 100_000 else merged(slots)
    placed = ranked.join(slots, (F.col("tokens") == F.col("length")) & F.col("rank").between(F.col("first"), F.col("last")))
    got = placed.select("doc_id", "piece", "tokens", (F.col("container") + F.expr("(rank - first) div each")).alias("container"))
    none = items.filter("tokens = 0").select("doc_id", "piece", "tokens", F.lit(None).cast("long").alias("container"))
    return got.unionByName(none)


def packed(documents: DataFrame, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """packed_counts of the texts' sizes in tokens; null and empty texts have 0. Counted once, into a written table."""
    return packed_counts(stage(token_counts(documents, ident, text, vocabulary), "tokens"), capacity)


def split_items(placed: DataFrame) -> DataFrame:
    """(doc_id) of the items that had to be split."""
    return placed.filter("piece > 0").select("doc_id").distinct()


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (containers, items, tokens, unused, fill, overfull): unused space over all containers, the share used, and the
    containers over capacity (none). fill is null without containers."""
    each = placed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.agg(
        F.count(F.lit(1)).alias("containers"),
        zero(F.sum("items")).alias("items"),
        zero(F.sum("used")).alias("tokens"),
        zero(F.sum(capacity - F.col("used"))).alias("unused"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
        zero(F.sum(F.when(F.col("used") > capacity, 1).otherwise(0))).alias("overfull"),
    )
