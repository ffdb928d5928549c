"""Near-duplicate records with small edits (problem 5): SuperMinHash signatures, banding, exact verification, union-find.

SuperMinHash gives each element, for step j = 0, 1, 2 ..., a random rank in [j, j + 1) and the next slot of a random permutation
of the slots; a slot keeps the smallest rank it was given. One step fills most slots of a set with many elements, and no step
after the one that filled the last slot can change anything: that is the early stop. The ranks of an element are
correlated over the slots, which lowers the estimate's variance against independent minima.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.bytesets import binary_parts, mix, rolling_hashes
from chunklake.session import fitted, merged, stage

GRAM = 16
LEAST_BYTES = 64
SLOTS = 192
ROWS = 4
BANDS = SLOTS // ROWS
_CHASE = 6
_BATCH_BYTES = 1 << 20
#: Files with one band value that meet in one list; more of them make several lists, which meet by twos.
BLOCK = 128
#: Band values that are spread over several tasks: those that approx_top_k finds with more rows than this, in so many parts.
HOT_ROWS, SALTS = 10_000, 64
#: Bytes of contents that one meeting's task holds the sets of.
MEETING_BYTES = 16 << 20


def _draw(x: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The step's rank (as j in the upper and a fraction in the lower 32 bits) and the place in [j, SLOTS) to swap with."""
    r = mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64((0xBF58476D1CE4E5B9 * (j + 1)) & (2**64 - 1)))
    frac = r & np.uint64(0xFFFFFFFF)
    place = ((r >> np.uint64(32)) * np.uint64(SLOTS - j)) >> np.uint64(32)
    return frac | np.uint64(j << 32), place.astype(np.int64) + j


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x SLOTS) of n sets; element i belongs to set owner[i], sorted by owner. Repeated elements don't matter.

    A set without elements keeps the largest value in all slots.
    """
    sig = np.full(n * SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    rank, place = _draw(elements, 0)
    np.minimum.at(sig, owner * SLOTS + place, rank)
    x, own, swaps, perm = elements, owner, [place], None
    full = np.bincount(owner, minlength=n) > 0
    for j in range(1, SLOTS):
        # Of a set whose worst slot is below j, nothing can change any more.
        active = full & (sig.reshape(n, SLOTS).max(axis=1) >= np.uint64(j << 32))
        if not active.any():
            break
        keep = active[own]
        if j == 1:
            x, own = x[keep], own[keep]
            order = np.lexsort((x, own))
            x, own = x[order], own[order]
            distinct = np.r_[True, (x[1:] != x[:-1]) | (own[1:] != own[:-1])]
            x, own = x[distinct], own[distinct]
            swaps = [_draw(x, 0)[1]]
        elif not keep.all():
            x, own = x[keep], own[keep]
            swaps = [s[keep] for s in swaps]
            perm = perm[keep] if perm is not None else None
        rank, place = _draw(x, j)
        if j < _CHASE:
            slot = place.copy()
            for i in range(j - 1, -1, -1):
                slot[slot == swaps[i]] = i
            swaps.append(place)
        else:
            each = np.arange(len(x))
            if perm is None:
                perm = np.tile(np.arange(SLOTS, dtype=np.int16), (len(x), 1))
                for i, s in enumerate(swaps):
                    perm[each, i], perm[each, s] = perm[each, s], perm[each, i].copy()
                swaps = []
            slot = perm[each, place].astype(np.int64)
            perm[each, place] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(sig, own * SLOTS + slot, rank)
    return sig.reshape(n, SLOTS)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 16-byte strings of consecutive files and the file of each."""
    base = offsets[0]
    h = rolling_hashes(data[base : offsets[-1]], (GRAM,))[GRAM]
    at = np.arange(len(h)) + base
    own = np.searchsorted(offsets, at, side="right") - 1
    whole = at + GRAM <= offsets[own + 1]
    return h[whole], own[whole]


def signatures(data: np.ndarray, offsets: np.ndarray, limit: int = _BATCH_BYTES) -> np.ndarray:
    """Signatures of consecutive files. A file over the limit is signed in overlapping parts: a slot's smallest rank over the whole is
    the smallest over the parts, so that memory doesn't grow with a file's size."""
    n = len(offsets) - 1
    if n == 1 and offsets[1] - offsets[0] > limit:
        sig = np.full((1, SLOTS), np.iinfo(np.uint64).max, dtype=np.uint64)
        for a in range(int(offsets[0]), int(offsets[1]) - GRAM + 1, limit):
            x, own = grams(data, np.array([a, min(int(offsets[1]), a + limit + GRAM - 1)]))
            np.minimum(sig, superminhash(x, own, 1), out=sig)
        return sig
    x, own = grams(data, offsets)
    return superminhash(x, own, n)


def gram_set(data: np.ndarray, limit: int = 1 << 22) -> np.ndarray:
    """The distinct hashes of a file's 16-byte strings, made part by part."""
    parts = [np.unique(rolling_hashes(data[a : a + limit + GRAM - 1], (GRAM,))[GRAM]) for a in range(0, max(1, len(data) - GRAM + 1), limit)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = (np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for rb in batches:
        offsets, data = binary_parts(rb.column(2))
        i = 0
        while i < rb.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BATCH_BYTES, side="right")) - 1)
            j = min(j, rb.num_rows)
            sig = signatures(data, offsets[i : j + 1]).reshape(j - i, BANDS, ROWS)
            band = mix((mix(sig.copy()) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            lists = pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(i, j - i) for c in (0, 1, 3)), pa.ListArray.from_arrays(lists, pa.array(band.ravel().view(np.int64)))], names=["file_id", "content", "size", "bands"])
            i = j


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return 0
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    return int((many[at] == few).sum())


def _meeting_batches(least: float):
    """Rows sorted by meeting and kind: a meeting's pairs, then its contents. Each content's set is made once, and all pairs are answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, sets = None, [], {}

        def answered() -> pa.RecordBatch:
            out = []
            for a, b in pairs:
                best = 0.0
                for x in sets.get(a, ()):
                    for y in sets.get(b, ()):
                        few, many = sorted((len(x), len(y)))
                        # Sets of very different sizes can't be that similar.
                        if few and few >= least * many:
                            both = shared(x, y)
                            best = max(best, both / (few + many - both))
                if best >= least:
                    out.append((a, b, best))
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

        for rb in batches:
            meeting, a, b = (rb.column(i).to_pylist() for i in (0, 2, 3))
            offsets, data = binary_parts(rb.column(4))
            for i, m in enumerate(meeting):
                if m != now:
                    if pairs:
                        yield answered()
                    now, pairs, sets = m, [], {}
                if b[i] is not None:
                    pairs.append((a[i], b[i]))
                else:
                    sets.setdefault(a[i], []).append(gram_set(data[offsets[i] : offsets[i + 1]]))
        if pairs:
            yield answered()

    return run


def contents(files: DataFrame, ident: str = "file_id", data: str = "file_data") -> tuple[DataFrame, DataFrame]:
    """(files with 64 bytes or more, classes of equal contents): the first has file_id, content and data; the second, a written
    table, has content, rep (its smallest file_id), members and the bands of its signature."""
    rows = files.filter(F.col(ident).isNotNull() & (F.octet_length(F.col(data)) >= LEAST_BYTES)).select(
        F.col(ident).cast("long").alias("file_id"), F.unhex(F.md5(F.col(data))).alias("content"), F.col(data).alias("data")
    )
    signed = rows.select("file_id", "content", "data", F.octet_length("data").cast("long").alias("size")).mapInArrow(_band_batches, "file_id long, content binary, size long, bands array<long>")
    classes = signed.groupBy("content").agg(F.min(F.struct("file_id", "bands")).alias("one"), F.countDistinct("file_id").alias("members"), F.max("size").alias("size"))
    return rows, stage(classes.select("content", F.col("one.file_id").alias("rep"), "members", "size", "one.bands"), "classes")


def _list_batches(hot: np.ndarray):
    """Rows (band, salt, rep) sorted by band and salt: the members of each repeated band value in lists of at most BLOCK, one after
    the other, so that a task holds one list whatever a value's number of members. `many`: the value may have other lists."""
    schema = pa.schema([("band", pa.int64()), ("block", pa.int64()), ("many", pa.bool_()), ("reps", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, blocks, out = None, np.zeros(0, np.int64), 0, []

        def close(reps: np.ndarray, whole: bool) -> None:
            many = blocks > 0 or not whole or now[2]
            if len(reps) and (many or len(reps) > 1):
                out.append((now[0], (now[1] << 32) + blocks, many, reps))

        for rb in batches:
            band, salt, rep = (rb.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(band):
                continue
            start = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])])
            size = np.diff(np.r_[start, len(band)])
            hot_here = np.isin(band[start], hot)
            look = (size > 1) | hot_here
            look[[0, -1]] = True
            for i in np.flatnonzero(look):
                key = (int(band[start[i]]), int(salt[start[i]]), bool(hot_here[i]))
                reps = rep[start[i] : start[i] + size[i]]
                if key != now:
                    if now is not None:
                        close(held, True)
                    now, held, blocks = key, np.zeros(0, np.int64), 0
                held = np.r_[held, reps]
                while len(held) > BLOCK:
                    close(held[:BLOCK], False)
                    held, blocks = held[BLOCK:], blocks + 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if now is not None:
            close(held, True)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """(a, b, meeting): distinct pairs a < b of representatives that agree in a band, each with one of the meetings where they do.

    A band value's members are gathered in lists of at most BLOCK, which a task reads off its sorted rows; values with more than
    HOT_ROWS members (found by a sketch of bounded size) are spread over SALTS parts. The lists of one value meet by twos, and each
    meeting is a row of its own that any task can take. So no task gets an unbounded group, and no pair is lost. Texts that share a
    band have mostly a high similarity, so that the work follows the size of the result.
    """
    rows = classes.select("rep", F.explode("bands").alias("band"))
    top = rows.agg(F.expr("approx_top_k(band, 200, 10000)").alias("top")).first()["top"] or []
    hot = [r["item"] for r in top if r["count"] > HOT_ROWS]
    salt = F.when(F.col("band").isin(hot), F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    spread = rows.select("band", salt.cast("long").alias("salt"), "rep").repartition("band", "salt").sortWithinPartitions("band", "salt", "rep")
    lists = stage(spread.mapInArrow(_list_batches(np.array(hot, dtype=np.int64)), "band long, block long, many boolean, reps array<long>"), "lists")
    within = lists.filter(F.size("reps") > 1).select(F.xxhash64("band", "block").alias("meeting"), F.col("reps").alias("x"), F.col("reps").alias("y"))
    big = lists.filter("many")
    across = big.alias("p").join(merged(big).alias("q"), (F.col("p.band") == F.col("q.band")) & (F.col("p.block") < F.col("q.block"))).select(F.xxhash64("p.band", "p.block", "q.block").alias("meeting"), F.col("p.reps").alias("x"), F.col("q.reps").alias("y"))
    pairs = within.unionByName(across).select("meeting", F.explode("x").alias("i"), "y").select("meeting", "i", F.explode("y").alias("k")).filter("i <> k")
    # Copies of one text agree in many bands: the least meeting is mostly one for a whole group of them.
    return pairs.groupBy(F.least("i", "k").alias("a"), F.greatest("i", "k").alias("b")).agg(F.min("meeting").alias("meeting"))


def verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose sets of 16-byte strings are that similar, computed from the data.

    Pairs are verified by meeting: a content comes to each meeting once, not once for each of its pairs, and its set is made once
    there. A meeting whose contents are larger than MEETING_BYTES is cut into parts, so that a task's memory is bounded.
    """
    pairs = stage(pairs, "pairs")
    members = pairs.select("meeting", F.explode(F.array("a", "b")).alias("rep")).distinct()
    sizes = classes.groupBy("rep").agg(F.max("size").alias("size"))
    heavy = stage(members.join(merged(sizes), "rep").groupBy("meeting").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > MEETING_BYTES), "heavy")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce(F.ceil(2 * F.col("bytes") / MEETING_BYTES), F.lit(1)))
    placed = stage(pairs.join(fitted(heavy), "meeting", "left").select(F.xxhash64("meeting", part("a"), part("b")).alias("meeting"), "a", "b"), "meetings")
    wanted = stage(placed.select("meeting", F.explode(F.array("a", "b")).alias("file_id")).distinct(), "wanted")
    data = rows.select("file_id", "data").join(fitted(wanted, beyond="shuffle_hash"), "file_id")
    flow = placed.select("meeting", F.lit(0).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("data")).unionByName(data.select("meeting", F.lit(1).alias("kind"), F.col("file_id").alias("a"), F.lit(None).cast("long").alias("b"), "data"))
    return flow.repartition("meeting").sortWithinPartitions("meeting", "kind").mapInArrow(_meeting_batches(least), "a long, b long, similarity double")


def similar_classes(files: DataFrame, least: float = 0.6, ident: str = "file_id", data: str = "file_data") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): links are pairs (a, b, similarity) between representatives of different contents."""
    rows, classes = contents(files, ident, data)
    return rows, classes, stage(verified(rows, classes, candidates(classes), least), "links")


def similar_pairs(files: DataFrame, least: float = 0.6, expand: int | None = 64, ident: str = "file_id", data: str = "file_data") -> DataFrame:
    """(file_id_a, file_id_b, similarity), a < b: files of at least 64 bytes whose sets of 16-byte strings have a Jaccard
    similarity of at least `least`. Each pair counts by its own similarity, exactly computed.

    Copies have similarity 1. A class of up to `expand` equal contents stands with all its members; of a larger one only the
    smallest id pairs with other contents and with each copy, so that k copies give k - 1 pairs and no link between
    different contents is lost (similar_groups has the membership). With expand=None all classes stand with all members. Null, empty and shorter data and null ids are in no
    pair; rows with equal ids are one file. Pairs are found if they agree in one of 48 bands of 4 slots: at 0.6 99.87 %.
    """
    rows, classes, links = similar_classes(files, least, ident, data)
    many = stage(rows.select("file_id", "content").join(fitted(classes.filter("members > 1").select("content", "rep", "members")), "content").select("rep", "file_id", "members").distinct(), "members")
    few = F.lit(True) if expand is None else F.col("members") <= expand
    small = many.filter(few).select("rep", "file_id")
    x, y = small.alias("x"), small.alias("y")
    copies = x.join(merged(y), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.file_id") < F.col("y.file_id"))).select(F.col("x.file_id").alias("a"), F.col("y.file_id").alias("b"))
    star = many.filter(~few & (F.col("rep") != F.col("file_id"))).select(F.col("rep").alias("a"), F.col("file_id").alias("b"))
    side = lambda df, c: df.join(fitted(small.select(F.col("rep").alias(c), F.col("file_id").alias(f"{c}_member"))), c, "left").withColumn(f"{c}_member", F.coalesce(f"{c}_member", c))
    near = side(side(links, "a"), "b").select(F.least("a_member", "b_member").alias("a"), F.greatest("a_member", "b_member").alias("b"), "similarity")
    same = copies.unionByName(star).withColumn("similarity", F.lit(1.0))
    return same.unionByName(near).filter("a <> b").groupBy(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b")).agg(F.max("similarity").alias("similarity"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node with the smallest node of its tree, half-linked paths shortened."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for rb in batches:
        for a, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, root): each linked node with the smallest node of its component.

    Union-find within partitions leaves at most one link for a node and partition; then nodes point in turn at the smallest of
    their neighbours and at their neighbours' smallest, until nothing changes. Each round is written to the shared folder;
    only a count reaches the driver. The rounds grow with the logarithm of the longest path; should `rounds` not do, an error is raised.
    """
    edges = stage(links.select(F.col(a).alias("x"), F.col(b).alias("y")).mapInArrow(_forest, "node long, root long"), "forest")
    before = -1
    for _ in range(rounds):
        # Large star, then small star: both keep components whole and only ever lower the ids pointed at.
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        lowest = both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("low"))
        large = both.join(merged(lowest), "node").filter(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        down = large.filter("node <> root").distinct()
        least = down.groupBy("node").agg(F.min("root").alias("low"))
        small = down.join(merged(least), "node").select(F.explode(F.array(F.struct("node", F.col("low").alias("root")), F.struct(F.col("root").alias("node"), F.col("low").alias("root")))).alias("e")).select("e.*").filter("node <> root").distinct()
        edges = stage(small, "star")
        n, total = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.lit(0))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.groupBy("node").agg(F.min("root").alias("root"))


def similar_groups(files: DataFrame, least: float = 0.6, ident: str = "file_id", data: str = "file_data") -> DataFrame:
    """(file_id, content_id, group_id, links) of every file: the smallest file with equal content, the smallest file of its
    connected component, and the number of similar different contents. Files under 64 bytes stand alone."""
    rows, classes, links = similar_classes(files, least, ident, data)
    root = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    member = rows.select("file_id", "content").join(merged(classes.select("content", "rep")), "content").groupBy("file_id").agg(F.min("rep").alias("rep"))
    named = member.join(merged(root.select(F.col("node").alias("rep"), "root")), "rep", "left").join(merged(degree), "rep", "left")
    out = named.select("file_id", F.col("rep").alias("content_id"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    alone = files.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("file_id")).distinct().join(merged(out.select("file_id")), "file_id", "left_anti")
    return out.unionByName(alone.select("file_id", F.col("file_id").alias("content_id"), F.col("file_id").alias("group_id"), F.lit(0).cast("long").alias("links")))
