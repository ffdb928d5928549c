"""The queries of the problems in this subpackage, and their SQL where SQL can say it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunklake.functions.keys import canonical_key_sql
from chunklake.llm import level, neardup, packing, seen, spans, split, tokens
from chunklake.operators import verify
from chunklake.session import merged, table

Query = Callable[[SparkSession, str], DataFrame]


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunkmessage").select("msg_id", "chunk_hash", "received_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(_messages(spark, d), table(spark, d, "chunkindex")).filter("seen").select("msg_id")


def p1_answers(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(_messages(spark, d), table(spark, d, "chunkindex"))


def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen.error_rate(_messages(spark, d), table(spark, d, "chunkindex"))


def p1_error_rate_tight(spark: SparkSession, d: str) -> DataFrame:
    """A coarse filter, whose errors can be seen and held against the target."""
    return seen.error_rate(_messages(spark, d), table(spark, d, "chunkindex"), false_positives=1e-3)


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many messages have a key, were seen, and are new."""
    got = seen.seen_before(_messages(spark, d), table(spark, d, "chunkindex"))
    return got.agg(F.count("seen").alias("messages"), F.count_if("seen").alias("seen"), F.count_if(~F.col("seen")).alias("new"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return split.items_of(table(spark, d, "filedata"), table(spark, d, "chunkmessage"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(_items(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    got = split.pieces(_items(spark, d))
    return got.select("item_kind", "item_id", "piece_no", "piece_start", "piece_bytes", "ended_at", F.md5("piece").alias("piece_md5"))


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each item put together from its pieces again, and whether all pieces fit, begin with the last 64 bytes of the one before, and follow each other."""
    got = split.pieces(_items(spark, d))
    w = Window.partitionBy("item_kind", "item_id", "digest").orderBy("piece_no")
    n, first = F.octet_length("piece"), F.col("piece_no") == 0
    limit = F.when(F.col("item_kind") == "file", split.FILE_LIMIT).otherwise(split.CHUNK_LIMIT)
    begins = F.substring("piece", 1, split.OVERLAP).eqNullSafe(F.lag(F.expr(f"substring(piece, -{split.OVERLAP}, {split.OVERLAP})")).over(w))
    follows = (F.col("piece_start") + split.OVERLAP).eqNullSafe(F.lag("piece_end").over(w))
    new = F.when(first, F.col("piece")).otherwise(F.expr(f"substring(piece, {split.OVERLAP + 1}, octet_length(piece))"))
    key = F.xxhash64("item_kind", "item_id", "digest").alias("k")
    checked = got.select(key, "item_kind", "item_id", "piece_no", new.alias("new"), ((n <= limit) & (n == F.col("piece_bytes")) & (first | begins & follows)).alias("ok"))
    whole = verify.digests(checked.select("k", F.col("piece_no").alias("o"), F.lit(None).cast("string").alias("h"), "new"), "k", "o", "h", "new")
    fits = checked.groupBy("k", "item_kind", "item_id").agg(F.min("ok").alias("pieces_ok"))
    return fits.join(merged(whole), F.col("k") == F.col("file_id")).select("item_kind", "item_id", F.col("size").alias("bytes"), "md5", "pieces_ok")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "filedata"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "filedata"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "filedata")).select("file_id_a", "file_id_b")


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same with all pairs of copies, however many there are."""
    return neardup.similar_pairs(table(spark, d, "filedata"), expand=None).select("file_id_a", "file_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(table(spark, d, "filedata"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_items(_packed(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Over all containers: the documents placed, containers over the capacity, and documents split though they would fit."""
    got = _packed(spark, d)
    size = got.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"))
    over = got.groupBy("container").agg(F.sum("tokens").alias("used")).filter("container is not null").agg(F.count_if(F.col("used") > packing.CAPACITY).alias("overfull"))
    return size.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("tokens") <= packing.CAPACITY) & (F.col("parts") > 1)).alias("split_needlessly")).withColumn("overfull", F.lit(over.scalar()))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return level.reading_levels(table(spark, d, "documents"), table(spark, d, "readlabel"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return level.advanced(_levels(spark, d))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return level.level_profile(_levels(spark, d), table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    named = (p1_found, p1_answers, p1_counts, p1_error_rate, p1_error_rate_tight, p2_found, p2_pieces, p2_rebuilt, p4_found, p4_shares, p5_found, p5_pairs, p5_groups, p6_ids, p7_found, p7_containers, p7_fill, p7_sound, p8_found, p8_levels, p8_profile)
    return {f.__name__: f for f in named}


_KEYED = f"""WITH m AS (SELECT msg_id, received_at, {canonical_key_sql("chunk_hash")} AS k FROM chunkmessage),
r AS (SELECT msg_id, k, row_number() OVER (PARTITION BY k ORDER BY received_at, msg_id) AS n FROM m WHERE k IS NOT NULL)"""


#: All windows of 256 bytes, those another file has too, and their unbroken runs. Takes seconds a megabyte.
_SPANS = """WITH h AS (SELECT file_id, hex(file_data) AS x, octet_length(file_data) AS n FROM filedata WHERE octet_length(file_data) >= 256),
w AS (SELECT file_id, i, md5(substr(x, 2 * i + 1, 512)) AS k FROM (SELECT file_id, x, unnest(range(n - 255)) AS i FROM h)),
s AS (SELECT k FROM w GROUP BY k HAVING min(file_id) <> max(file_id)),
c AS (SELECT file_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY file_id ORDER BY i) + 256 THEN 0 ELSE 1 END AS nw FROM w SEMI JOIN s USING (k)),
g AS (SELECT file_id, i, sum(nw) OVER (PARTITION BY file_id ORDER BY i) AS r FROM c)
SELECT file_id, CAST(min(i) AS BIGINT) AS span_start, CAST(max(i) - min(i) + 256 AS BIGINT) AS span_bytes FROM g GROUP BY file_id, r"""
#: All sets of 16-byte strings, and all pairs of files that share one.
_PAIRS = """WITH h AS (SELECT file_id, hex(file_data) AS x, octet_length(file_data) AS n FROM filedata WHERE octet_length(file_data) >= 64),
w AS (SELECT DISTINCT file_id, substr(x, 2 * i + 1, 32) AS k FROM (SELECT file_id, x, unnest(range(n - 15)) AS i FROM h)),
z AS (SELECT file_id, count(*) AS n FROM w GROUP BY file_id),
p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS i FROM w a JOIN w b ON a.k = b.k AND a.file_id < b.file_id GROUP BY ALL)
SELECT p.a AS file_id_a, p.b AS file_id_b FROM p JOIN z x ON x.file_id = p.a JOIN z y ON y.file_id = p.b WHERE p.i >= 0.6 * (x.n + y.n - p.i)"""


_GROUPS = f"""WITH RECURSIVE cl AS (SELECT file_data, min(file_id) AS rep FROM filedata WHERE octet_length(file_data) >= 64 GROUP BY file_data),
l AS (SELECT file_id_a AS a, file_id_b AS b FROM ({_PAIRS}) WHERE file_id_a IN (SELECT rep FROM cl) AND file_id_b IN (SELECT rep FROM cl)),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(x, y) AS (SELECT rep, rep FROM cl UNION SELECT r.x, s.b FROM r JOIN s ON r.y = s.a),
g AS (SELECT x AS rep, min(y) AS root FROM r GROUP BY x), k AS (SELECT a AS rep, count(*) AS links FROM s GROUP BY a)
SELECT file_id, coalesce(rep, file_id) AS content_id, coalesce(root, file_id) AS group_id, coalesce(links, 0) AS links FROM filedata LEFT JOIN cl USING (file_data) LEFT JOIN g USING (rep) LEFT JOIN k USING (rep)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _SPANS,
        "p4_shares": f"SELECT file_id, CAST(n AS BIGINT) AS data_bytes, coalesce(spans, 0) AS spans, CAST(coalesce(b, 0) AS BIGINT) AS shared_bytes, coalesce(b, 0) / CAST(nullif(n, 0) AS DOUBLE) AS share "
        f"FROM (SELECT file_id, coalesce(octet_length(file_data), 0) AS n FROM filedata) LEFT JOIN (SELECT file_id, count(*) AS spans, sum(span_bytes) AS b FROM ({_SPANS}) GROUP BY file_id) USING (file_id)",
        "p5_found": _PAIRS,
        "p5_groups": _GROUPS,
        "p5_pairs": _PAIRS,
        "p1_found": f"{_KEYED} SELECT msg_id FROM r WHERE n > 1 OR k IN (SELECT chunk_hash FROM chunkindex)",
        "p1_answers": f"{_KEYED} SELECT msg_id, n > 1 OR k IN (SELECT chunk_hash FROM chunkindex) AS seen FROM r UNION ALL SELECT msg_id, NULL FROM m WHERE k IS NULL",
        "p1_counts": f"{_KEYED}, s AS (SELECT n > 1 OR k IN (SELECT chunk_hash FROM chunkindex) AS seen FROM r) SELECT count(*) AS messages, count(*) FILTER (seen) AS seen, count(*) FILTER (NOT seen) AS new FROM s",
        "p7_sound": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_needlessly FROM documents",
        "p2_found": "SELECT 'file' AS item_kind, file_id AS item_id FROM filedata WHERE octet_length(file_data) > 8192 "
        "UNION SELECT 'chunk', msg_id FROM chunkmessage WHERE octet_length(chunk_data) > 1024",
        "p2_rebuilt": "SELECT 'file' AS item_kind, file_id AS item_id, CAST(octet_length(file_data) AS BIGINT) AS bytes, md5(file_data) AS md5, true AS pieces_ok FROM filedata WHERE octet_length(file_data) > 8192 "
        "UNION SELECT 'chunk', msg_id, octet_length(chunk_data), md5(chunk_data), true FROM chunkmessage WHERE octet_length(chunk_data) > 1024",
    }
