"""Has this key been seen before? (problem 1)

Keys are partitioned by hash; each bucket's keys are read in order of arrival and kept in one blocked Bloom filter, which is
asked first and told afterwards. Keys that are certainly absent run through the same filters to measure wrong answers.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunklake.functions.keys import canonical_key, key_as_long
from chunklake.session import merged, stage

BLOCK_BITS = 512
_EARLIER, _MESSAGE, _PROBE = 0, 1, 2
#: What a row is before the filters: open (they are asked), decided (its key is hot and came before), or without a key.
_OPEN, _DECIDED, _KEYLESS = 0, 1, 2
#: Stands for a null id on the way: arrays of numbers can't hold nulls.
_NO_ID = -(2**63)
_FLOW = "kind byte, at long, id long, key long, state byte"
#: A key is hot in a task once a batch has so many rows of it; a task remembers at most so many hot keys.
HOT_ROWS, HOT_KEYS = 16, 65_536
#: Standard error of the count of distinct keys, and open rows a task takes.
_COUNT_ERROR, TASK_ROWS = 0.02, 4_000_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wrong(bits_a_key: float, k: int) -> float:
    """The rate of false positives of a full filter: a block holds a Poisson number of keys, each of which sets k of its bits."""
    mean = BLOCK_BITS / bits_a_key
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 20))
    chance = np.exp(n * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in n]))
    return float((chance * (1 - (1 - 1 / BLOCK_BITS) ** (k * n)) ** k).sum())


@functools.lru_cache(maxsize=64)
def design(false_positives: float) -> tuple[float, int]:
    """(bits a key, bits a key sets): the smallest filter of 512-bit blocks whose rate, when full, is the wanted one."""
    best = (math.inf, 0)
    for k in range(1, 33):
        few, many = 1.0, 512.0
        if _wrong(many, k) > false_positives:
            continue
        for _ in range(40):
            half = (few + many) / 2
            few, many = (half, many) if _wrong(half, k) > false_positives else (few, half)
        best = min(best, (many, k))
    return best


class BlockedBloom:
    """A Bloom filter of 512-bit blocks: a key's bits all lie in one block, so that a query touches one cache line.

    Sized once for `capacity` distinct keys at the wanted rate of false positives; it never forgets a key.
    """

    def __init__(self, capacity: int, false_positives: float = 1e-7):
        bits, self.k = design(false_positives)
        self.blocks = max(1, math.ceil(max(capacity, 1) * bits / BLOCK_BITS))
        self.words = np.zeros(self.blocks * (BLOCK_BITS // 64), dtype=np.uint64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64, copy=False)
        block = _mix(keys, 0x5BD1E995) % np.uint64(self.blocks)
        # Nine bits of a hash for each place: a stride over the block would leave only 2^17 patterns, and so many errors.
        parts = [(_mix(keys, 0x27D4EB2F + 2 * i)[:, None] >> (np.arange(7, dtype=np.uint64) * np.uint64(9))) for i in range(-(-self.k // 7))]
        bit = np.concatenate(parts, axis=1)[:, : self.k] & np.uint64(BLOCK_BITS - 1)
        word = block[:, None] * np.uint64(BLOCK_BITS // 64) + (bit >> np.uint64(6))
        return word.astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    def has(self, keys: np.ndarray) -> np.ndarray:
        word, mask = self._places(keys)
        return ((self.words[word] & mask) != 0).all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        word, mask = self._places(keys)
        np.bitwise_or.at(self.words, word.ravel(), mask.ravel())

    def seen_then_add(self, keys: np.ndarray) -> np.ndarray:
        """For keys in order: was each one there before, in the filter or earlier in this batch? Then all are added."""
        if not len(keys):
            return np.zeros(0, dtype=bool)
        first, back = np.unique(keys, return_index=True, return_inverse=True)[1:]
        answer = np.ones(len(keys), dtype=bool)
        answer[first] = self.has(keys[first])
        self.add(keys[first])
        return answer


class HotKeys:
    """The earliest row of each hot key a task has met: at most `most` keys, those with most rows."""

    def __init__(self, most: int = HOT_KEYS):
        self.most = most
        self.key = self.at = self.id = self.rows = np.zeros(0, np.int64)

    def settle(self, kind: np.ndarray, at: np.ndarray, ident: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which messages of a batch are decided: they have a hot key, and an earlier row of it is in this batch or was met before.

        A hot key's row that is earlier than all of its key before stays open, and so does each row of other keys.
        """
        order = np.lexsort((ident, at, key))
        k = key[order]
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        rows = np.diff(np.r_[start, len(k)])
        place = np.searchsorted(self.key, k[start])
        known = np.zeros(len(start), dtype=bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == k[start[inside]]
        hot = known | (rows >= HOT_ROWS)
        decided = np.repeat(hot, rows)
        first = order[start]
        old = np.flatnonzero(known)
        p = place[old]
        later = (at[first[old]] > self.at[p]) | (at[first[old]] == self.at[p]) & (ident[first[old]] >= self.id[p])
        keep = hot.copy()
        keep[old[later]] = False
        decided[start[keep]] = False
        self.rows[p] += rows[old]
        lower = old[~later]
        self.at[place[lower]], self.id[place[lower]] = at[first[lower]], ident[first[lower]]
        new = np.flatnonzero(hot & ~known)
        if len(new):
            cols = [np.r_[a, b] for a, b in ((self.key, k[start[new]]), (self.at, at[first[new]]), (self.id, ident[first[new]]), (self.rows, rows[new]))]
            if len(cols[0]) > self.most:
                most = np.argsort(-cols[3], kind="stable")[: self.most]
                cols = [c[most] for c in cols]
            by = np.argsort(cols[0])
            self.key, self.at, self.id, self.rows = (c[by] for c in cols)
        out = np.zeros(len(k), dtype=bool)
        out[order] = decided
        return out & (kind == _MESSAGE)


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side: rows of hot keys that come after another row the task has met are decided here and reach no filter."""
    hot = HotKeys()
    for rb in batches:
        kind, at, ids, key, keyed = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        state = np.where(keyed, _OPEN, _KEYLESS).astype(np.int8)
        there = np.flatnonzero(keyed)
        state[there[hot.settle(kind[there], at[there], ids[there], key[there])]] = _DECIDED
        yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(4)), pa.array(state)], names=["kind", "at", "id", "key", "state"])


def _ask_in_order(capacity: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, here = None, None
        for rb in batches:
            kind, key, bucket = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            found = np.zeros(len(kind), dtype=bool)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if bucket[a] != here:
                    bloom, here = BlockedBloom(capacity, rate), bucket[a]
                at = np.arange(a, b)
                told = at[kind[at] != _PROBE]
                found[told] = bloom.seen_then_add(key[told].view(np.uint64))
                probes = at[kind[at] == _PROBE]
                if len(probes):
                    found[probes] = bloom.has(key[probes].view(np.uint64))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), rb.column(3), pa.array(found)], names=["kind", "id", "key", "found"])

    return run


def _mixed(key: Column) -> Column:
    return F.xxhash64(key)


def answers(
    messages: DataFrame,
    earlier: DataFrame | None = None,
    probes: DataFrame | None = None,
    false_positives: float = 1e-7,
    keys_per_filter: int = 1_000_000,
    key: str = "chunk_hash",
    order: str = "received_at",
    ident: str = "msg_id",
) -> DataFrame:
    """Whether each message's key came before: (kind, id, key, found, asked); kind 1 is a message, 2 a probe.

    `earlier` holds keys known before the first message (column `key`), `probes` keys to ask for only (column `key` as a
    long). Messages are ordered by `order`, then `ident`; a null `order` comes first. Rows without a key have a null `found`.
    `asked` is true where a filter gave the answer.

    Method: keys are partitioned by hash into blocked Bloom filters of about `keys_per_filter` distinct keys; the rows of each are sorted by
    time, and asked and told in turn. The filters' size follows the counted distinct keys, not the rows. A task holds one filter
    at a time, design(false_positives)[0] / 8 bytes a key, however many keys there were; no keys are kept. No answer "new" is
    wrong; "seen" is wrong at about the rate given.

    Hot keys: a task that reads messages remembers the earliest row of each of its hot keys (16 rows in a batch or more; at most
    65,536 keys), and decides the later ones at once. So of a key with a third of all rows a task sends its filter a few rows; decided rows
    aren't shuffled. The rows read are written once, so that both parts come from one reading, whatever is lost.
    """
    spark = messages.sparkSession
    k = key_as_long(canonical_key(F.col(key)))
    rows = messages.select(
        F.lit(_MESSAGE).cast("byte").alias("kind"),
        F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**62))).alias("at"),
        F.coalesce(F.col(ident).cast("long"), F.lit(_NO_ID)).alias("id"),
        k.alias("key"),
    )
    if earlier is not None:
        rows = rows.unionByName(earlier.select(F.lit(_EARLIER).cast("byte").alias("kind"), F.lit(-(2**63)).alias("at"), F.lit(-1).cast("long").alias("id"), k.alias("key")))
    settled = stage(rows.select("kind", "at", "id", F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNotNull().alias("keyed")).mapInArrow(_settle_batches, _FLOW), "settled")
    still = settled.filter(F.col("state") == _OPEN)
    n_open, distinct = still.agg(F.count(F.lit(1)), F.approx_count_distinct("key", _COUNT_ERROR)).first()
    # Three standard errors above the count, so that no filter is too small; the keys of a bucket vary by six deviations at most.
    most = distinct * (1 + 3 * _COUNT_ERROR)
    n = max(1, math.ceil(most / keys_per_filter), min(spark.sparkContext.defaultParallelism, n_open // 10_000))
    capacity = math.ceil(most / n + 6 * math.sqrt(most / n) + 16)
    tasks = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_open / TASK_ROWS)))
    bucket = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("bucket")
    flow = still.select("kind", "at", "id", "key", bucket)
    if probes is not None:
        flow = flow.unionByName(probes.select(F.lit(_PROBE).cast("byte").alias("kind"), F.lit(2**62).alias("at"), F.lit(-1).cast("long").alias("id"), "key", bucket))
    # A task takes several buckets in turn where there are more buckets than tasks.
    sorted_ = flow.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "at", "id")
    got = sorted_.mapInArrow(_ask_in_order(capacity, false_positives), "kind byte, id long, key long, found boolean").withColumn("asked", F.lit(True))
    done = settled.filter(F.col("state") != _OPEN)
    return got.unionByName(done.select("kind", "id", F.when(F.col("state") == _DECIDED, F.col("key")).alias("key"), F.when(F.col("state") == _DECIDED, True).alias("found"), F.lit(False).alias("asked")))


def seen_before(messages: DataFrame, earlier: DataFrame | None = None, **how) -> DataFrame:
    """(msg_id, seen) of each message: true if its key is in `earlier` or came in an earlier message, false if it is new.

    Messages without a key (null, or no 64-bit hexadecimal number) have a null `seen`: they are neither. Equal rows sent
    again count as seen unless they are the first; two rows with one id are ordered arbitrarily; a null id comes first and stays null. An empty table gives no rows.
    """
    return answers(messages, earlier, **how).filter(F.col("kind") == _MESSAGE).select(F.nullif("id", F.lit(_NO_ID)).alias("msg_id"), F.col("found").alias("seen"))


def absent_keys(messages: DataFrame, earlier: DataFrame | None, n: int, key: str = "chunk_hash") -> DataFrame:
    """About n keys (as longs) that occur nowhere: drawn by hash and anti-joined with all keys there are."""
    spark = messages.sparkSession
    drawn = spark.range(n).select(F.xxhash64(F.col("id"), F.lit(0x5EED)).alias("key"))
    there = messages.select(key_as_long(canonical_key(F.col(key))).alias("key"))
    if earlier is not None:
        there = there.unionByName(earlier.select(key_as_long(canonical_key(F.col(key))).alias("key")))
    return drawn.join(merged(there.filter(F.col("key").isNotNull()).distinct()), "key", "left_anti")


def error_rate(messages: DataFrame, earlier: DataFrame | None = None, probes: int = 1_000_000, false_positives: float = 1e-7, **how) -> DataFrame:
    """One row: (probes, false_answers, measured_rate, target_rate, messages, asked, seen, new); messages are those with a key, asked
    those a filter answered.

    The probes are keys that are certainly absent; each is asked of the full filter of its bucket, where a filter is at its
    worst. measured_rate is null without probes.
    """
    absent = absent_keys(messages, earlier, probes, how.get("key", "chunk_hash"))
    got = answers(messages, earlier, absent, false_positives=false_positives, **how)
    probe, msg, found = F.col("kind") == _PROBE, F.col("kind") == _MESSAGE, F.col("found")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return got.agg(
        count(probe).alias("probes"),
        count(probe & found).alias("false_answers"),
        count(msg & found.isNotNull()).alias("messages"),
        count(msg & F.col("asked")).alias("asked"),
        count(msg & found).alias("seen"),
        count(msg & ~found).alias("new"),
    ).select("probes", "false_answers", (F.col("false_answers") / F.nullif(F.col("probes"), F.lit(0))).alias("measured_rate"), F.lit(false_positives).alias("target_rate"), "messages", "asked", "seen", "new")
