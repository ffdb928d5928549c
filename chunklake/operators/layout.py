"""Physical layout: file scores, file order, first owners, chunk order and offsets, sizes, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunklake.operators.dedup import frequencies
from chunklake.operators.prefix import global_running_sum


def file_scores(manifest: DataFrame, file: str = "file_id", key: str = "chunk_hash") -> DataFrame:
    """(file, score, chunks): the sum of the global frequencies of all its chunk rows, each occurrence counted; a row without a
    hash counts 0. The join key may be hot: frequencies are joined per (file, hash), after folding repeats within a file."""
    freq = frequencies(manifest, key)
    rows = manifest.groupBy(file, key).agg(F.count(F.lit(1)).alias("times"))
    return rows.join(freq, key, "left").groupBy(file).agg(F.sum(F.coalesce("frequency", F.lit(0)) * F.col("times")).alias("score"), F.sum("times").alias("chunks"))


def first_owners(manifest: DataFrame, ranks: DataFrame, file: str = "file_id", key: str = "chunk_hash", offset: str = "chunk_offset") -> DataFrame:
    """(hash, rank, offset): the best-ranked file, and the first place in it, that each hash occurs at. A min, not a window."""
    at = F.struct(F.col("rank"), F.col(offset).alias("offset"))
    return manifest.filter(F.col(key).isNotNull()).join(ranks, file).groupBy(key).agg(F.min(at).alias("at")).select(key, "at.rank", F.col("at.offset").alias("first_offset"))


def ranked_files(scores: DataFrame, file: str = "file_id") -> DataFrame:
    """Adds rank, from 0: by falling score, ties by the file's id or name in byte order."""
    one = scores.withColumn("_one", F.lit(1))
    return global_running_sum(one, [F.col("score").desc(), F.col(file).asc()], "_one", "rank").drop("_one")


def chunk_layout(manifest: DataFrame, lengths: DataFrame, file: str = "file_id", key: str = "chunk_hash", offset: str = "chunk_offset", length: str = "length") -> DataFrame:
    """(hash, position, layout_offset, length): chunks in the order of their first owner by score, each once, with exclusive running
    sums of the lengths as offsets. Hashes without a length (missing chunks) take no space."""
    ranks = ranked_files(file_scores(manifest, file, key), file).select(file, "rank")
    firsts = first_owners(manifest, ranks, file, key, offset)
    placed = firsts.join(lengths.select(key, length), key, "left").withColumn(length, F.coalesce(F.col(length), F.lit(0)).cast("long"))
    return global_running_sum(placed, [F.col("rank"), F.col("first_offset"), F.col(key)], length, "layout_offset", "position").select(key, "position", "layout_offset", length)


def hash_layout(lengths: DataFrame, key: str = "chunk_hash", length: str = "length") -> DataFrame:
    """The disc layout: chunks by ascending (unsigned) hash, with offsets."""
    return global_running_sum(lengths.select(key, F.col(length).cast("long").alias(length)), [F.col(key)], length, "layout_offset", "position")


def file_sizes(manifest: DataFrame, file: str = "file_id", offset: str = "chunk_offset", length: str = "chunk_length") -> DataFrame:
    """(file, size_last, size_sum, chunks): the end of the last chunk, and the sum of the lengths; 0 without chunks."""
    end = F.max_by(F.col(offset) + F.col(length), F.struct(offset, length))
    return manifest.groupBy(file).agg(F.coalesce(end, F.lit(0)).cast("long").alias("size_last"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("size_sum"), F.count(F.lit(1)).alias("chunks"))


def table_of_contents(files: DataFrame, name: str, size: str, ident: str) -> DataFrame:
    """(toc_no, name, size): numbered from 1 by name in byte order, then id; null names come first."""
    return global_running_sum(files.withColumn("_one", F.lit(1)), [F.col(name).asc_nulls_first(), F.col(ident)], "_one", "toc_no").withColumn("toc_no", F.col("toc_no") + 1).select("toc_no", ident, name, size)


def strided_sample(lengths: DataFrame, cap: int, key: str = "chunk_hash", length: str = "length") -> DataFrame:
    """A training sample: of the hashes in order every ceil(total / cap)-th, as long as the sum stays within the cap."""
    total = lengths.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    if total <= cap:
        return lengths
    step = max(1, -(-int(total) // cap))
    one = global_running_sum(lengths.withColumn("_one", F.lit(1)), [F.col(key)], "_one", "_i").filter(F.col("_i") % step == 0).drop("_one", "_i")
    return global_running_sum(one, [F.col(key)], length, "_before").filter(F.col("_before") + F.col(length) <= cap).drop("_before")


def part_bases(parts: DataFrame, group: str, part: str, length: str) -> DataFrame:
    """Adds the base offset of each part in the virtual concatenation of its group's parts."""
    w = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))
