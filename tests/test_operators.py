import datetime
import os
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import InheritableThread
from pyspark.sql import functions as F

from chunklake import session
from chunklake.functions import codec, disc, scalars
from chunklake.functions.hashing import CHUNK_SEED, hash_hex
from chunklake.functions.keys import canonical_key, key_as_long, long_as_key
from chunklake.operators import chunking, cue, dedup, joins, layout, optical, runs, seek, skew, tuning, verify
from chunklake.operators.concat import concatenated
from chunklake.operators.prefix import global_running_sum
from chunklake.plans import compress, extract
from chunklake.sources import archive, config, files
from chunklake.sources.ranges import file_ranges


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_canonical_keys(spark):
    cases = {"00000000000000ff": ["ff", "0xFF", " 0X0ff\n", "0" * 30 + "FF", "\tff"], None: ["", " ", "0x", "n/a", "-", "1" + "0" * 16, "f f", None], "0" * 16: ["0", "0x0", "00"]}
    data = [(k, v) for k, vs in cases.items() for v in vs]
    got = spark.createDataFrame(data, "want string, text string").select("want", canonical_key(F.col("text")).alias("k")).collect()
    assert all(r.want == r.k for r in got)
    back = spark.createDataFrame([("fedcba9876543210",), ("7" * 16,)], "k string").select("k", long_as_key(key_as_long(F.col("k"))).alias("b")).collect()
    assert all(r.k == r.b for r in back)


MSG = "msg_id long, chunk_hash string, file_id long, chunk_data binary, k string, o int, bytes string, n int"


def test_key_totals_cases(spark):
    data = [(1, "ff", 1, b"abc"), (2, "0xFF", 1, b"abc"), (3, "ff", None, None), (4, "ff", 2, b""), (5, None, 1, b"x"), (6, "n/a", 1, b"x"), (6, "a", 9, b"12"), (6, "a", 9, b"12")]
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 7) for r in data], MSG)
    assert rows(skew.key_totals(df)) == [("0" * 15 + "a", 2, 1, 4), ("0" * 14 + "ff", 4, 2, 6)]
    assert rows(skew.heavy_keys(df, 0.25), "chunk_hash") == [("0" * 15 + "a",), ("0" * 14 + "ff",)]
    assert rows(skew.heavy_keys(df, 0.5), "chunk_hash") == [("0" * 14 + "ff",)]
    none = df.filter("false")
    assert rows(skew.key_totals(none)) == [] and rows(skew.heavy_keys(none)) == []


def test_hot_key_is_folded_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.col("id").alias("msg_id"), F.when(F.col("id") % 3 == 0, F.hex("id")).otherwise("7").alias("chunk_hash"), (F.col("id") % 10).alias("file_id"), F.lit(b"xy").alias("chunk_data"))
    got = {r.chunk_hash: (r.messages, r.files, r.bytes) for r in skew.key_totals(df).collect()}
    assert got["0" * 15 + "7"] == (13333, 10, 26666)
    plan = skew.key_totals(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=20_000), st.sampled_from([256, 1024]), st.sampled_from([0, 1]))
def test_chunks_cover_the_data(data, window, level):
    ends = chunking.cut_points(np.frombuffer(data, np.uint8), window, level)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == len(data)
    assert all(s <= 4 * window for s in sizes) and all(s >= max(64, window // 4) for s in sizes[:-1])


def test_one_byte_changes_few_chunks():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, 200_000).astype(np.uint8)
    b = np.insert(a, 90_000, 7)
    cuts = [chunking.cut_points(d, 1024) for d in (a, b)]
    x, y = ({d[i:j].tobytes() for i, j in zip([0, *e], e)} for d, e in zip((a, b), cuts))
    assert len(x - y) <= 4 and len(x) > 100


def test_large_files_are_hashed_in_parts():
    d = np.random.default_rng(9).integers(0, 256, 10_000).astype(np.uint8)
    rule = chunking.Rule(256, 1)
    for part in (64, 1000, 4096):
        assert all((a == b).all() for a, b in zip(rule.candidates(d, 0, part), rule.candidates(d)))


def byte_by_byte(d, window, level):
    """The cuts by their definition: the hash starts anew at the least size of each chunk."""
    rule, base, out = chunking.Rule(window, level), 0, []
    strict, loose = (int(m) for m in rule.masks)
    table = [int(x) for x in rule.table]
    while len(d) - base > rule.least:
        h, cut = 0, min(base + rule.most, len(d))
        for p in range(base + rule.least, cut):
            h = (h << 1) + table[d[p]] & (1 << 64) - 1
            if h & (strict if p < base + window else loose) == 0:
                cut = p
                break
        out.append(cut)
        base = cut
    return [*out, len(d)] if base < len(d) else out


@pytest.mark.parametrize("window, level", [(256, 0), (256, 1), (1024, 1)])
def test_cuts_as_defined(window, level):
    rng = np.random.default_rng(window + level)
    for d in (rng.integers(0, 256, 60_000), rng.integers(0, 3, 20_000), np.zeros(9000), np.arange(300), np.zeros(64)):
        d = d.astype(np.uint8)
        assert chunking.cut_points(d, window, level) == byte_by_byte(d, window, level)
        early = chunking.cut_points(d, window, level, final=False)
        assert early == chunking.cut_points(d, window, level)[: len(early)]


def test_chunks_of_streams_and_of_files(spark, tmp_path):
    rng = np.random.default_rng(11)
    data = {"a": rng.integers(0, 256, 90_000).astype(np.uint8).tobytes(), "b": b"x" * 30_000, "c": b"", "d": b"tiny"}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "k string, d binary")
    want = rows(chunking.content_chunks(whole, "d", ["k"], 512), "k", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash")
    parts = spark.createDataFrame([(k, i, bytearray(v[i : i + 700]) if v else None) for k, v in data.items() for i in range(0, len(v) or 1, 700)], "k string, o int, d binary").repartition(5)
    for held in (1000, 1 << 22):
        assert rows(chunking.stream_chunks(parts, ["k"], "o", "d", 512, held=held), "k", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash") == want
    for size in (4096, 10_000, 1 << 20):
        got = chunking.chunks_of_files(spark, [str(tmp_path)], 512, range_bytes=size)
        assert rows(got.withColumn("k", F.element_at(F.split("path", "/"), -1)), "k", "chunk_no", "chunk_offset", "chunk_length", "chunk_hash") == want
        assert {r.k: r.d for r in concatenated(got.withColumn("k", F.element_at(F.split("path", "/"), -1)), ["k"], "chunk_offset", "chunk_data", "d").collect()} == {k: v for k, v in data.items() if v}


def test_ranges_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(100)))
    (tmp_path / "empty").write_bytes(b"")
    got = file_ranges(spark, [str(tmp_path)], 30, 5, 7).orderBy("range_no").collect()
    assert [(r.range_no, getattr(r, "from"), bytes(r.bytes)) for r in got] == [(i, max(0, 30 * i - 5), bytes(range(max(0, 30 * i - 5), min(100, 30 * i + 37)))) for i in range(4)]
    assert file_ranges(spark, [f"file://{tmp_path}/f"], 1000).first().size == 100
    assert file_ranges(spark, [str(tmp_path / "empty")], 30).count() == 0 and chunking.chunks_of_files(spark, []).count() == 0
    with pytest.raises(Exception):
        file_ranges(spark, [str(tmp_path / "gone")], 30).count()


def test_concatenation(spark):
    df = spark.createDataFrame([(1, None, 2, b"c"), (1, None, 1, b"ab"), (1, "x", 1, None), (None, "x", 5, b"q")], "a int, b string, o int, d binary")
    assert {(r.a, r.b): bytes(r.w) for r in concatenated(df, ["a", "b"], "o", "d", "w").collect()} == {(1, None): b"abc", (1, "x"): b"", (None, "x"): b"q"}
    assert concatenated(df.filter("false"), ["a"], "o", "d", "w").count() == 0


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    return type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)


def test_fitted_counts_before_it_broadcasts(spark):
    a, b = spark.range(100), spark.range(50)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(a.join(session.fitted(b), "id"))
    assert "SortMergeJoin" in plan(a.join(session.fitted(b, 49), "id")) and "SortMergeJoin" in plan(a.join(session.merged(b), "id"))


def test_jobs_are_cancelled_by_name(spark):
    failed = []

    def run():
        with session.job(spark, "slow"):
            try:
                spark.range(1 << 40).selectExpr("sum(id * id)").collect()
            except Exception as e:  # noqa: BLE001
                failed.append(str(e))

    t = InheritableThread(target=run, session=spark)
    t.start()
    for _ in range(100):
        if session.progress(spark, "slow")[1]:
            break
        time.sleep(0.1)
    assert session.progress(spark, "slow")[1] > 0
    session.cancel(spark, "slow")
    t.join(30)
    assert failed and not t.is_alive()


def test_chunking_tables(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, b"a" * 5000)], "file_id long, d binary")
    got = chunking.content_chunks(df, "d", ["file_id"], 256, bits=128).collect()
    assert {r.file_id for r in got} == {3} and all(len(r.chunk_hash) == 32 for r in got)
    assert got[0].chunk_hash == hash_hex(bytes(got[0].chunk_data), 128, CHUNK_SEED)
    with pytest.raises(ValueError):
        chunking.content_chunks(df, "d", ["file_id"], 1000)
    blocks = chunking.fixed_blocks(df, F.col("d"), ["file_id"], 2048)
    assert [(r.block_no, r.block_offset, len(r.block)) for r in sorted(blocks.collect())] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]


def test_run_blocks_restart_and_tail(spark):
    r = spark.createDataFrame([(1, 100, 17), (2, 200, 16), (3, 300, 0)], "run_no int, s long, n long")
    assert rows(chunking.run_blocks(r, "s", "n"), "run_no", "block_start", "block_count") == [(1, 100, 16), (1, 116, 1), (2, 200, 16)]
    assert rows(chunking.run_blocks(r, "s", "n", whole=F.col("run_no") == 1), "run_no", "block_start", "block_count") == [(1, 100, 17), (2, 200, 16)]


def test_seek_cases(spark):
    m = spark.createDataFrame([(1, 0, 4), (1, 4, 4), (1, 8, 2)], "file_id long, chunk_offset long, chunk_length long")
    cases = {(0, 10): [(0, 0, 4), (4, 0, 4), (8, 0, 2)], (3, 2): [(0, 3, 4), (4, 0, 1)], (4, 4): [(4, 0, 4)], (4, 0): [], (5, 0): [(4, 1, 1)]}
    for (o, n), want in cases.items():
        for bucket in (1, 3, 4096):
            q = spark.createDataFrame([(1, o, n)], "file_id long, seek_offset long, seek_length long")
            assert rows(seek.seek(m, q, bucket=bucket), "chunk_offset", "slice_start", "slice_end") == want
    q = spark.createDataFrame([(1, 9, 2), (1, 0, 10), (2, 0, 0), (1, 2**63 - 1, 2**63 - 1)], "file_id long, seek_offset long, seek_length long")
    assert len(seek.out_of_bounds(q, spark.createDataFrame([(1, 10)], "file_id long, size long")).collect()) == 3


def test_joins(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("x", 1)], "k string, v int")
    assert rows(joins.checked_join(a.filter("k = 'x'"), b, "k", "t")) == [("x", 1)]
    with pytest.raises(Exception, match="no such k"):
        joins.checked_join(a, b, "k", "t").collect()
    assert rows(joins.missing(a, b, "k")) == [("y",)]
    p = spark.createDataFrame([(1, i) for i in range(6)], "g int, pos int")
    c = spark.createDataFrame([(1, 2, "a"), (1, 4, "b"), (2, 0, "z")], "g int, since int, v string")
    assert [r.v for r in sorted(joins.asof(p, c, ["g"], "pos", "since", "v", F.lit("-")).collect())] == ["-", "-", "a", "a", "b", "b"]
    left = spark.createDataFrame([(1, 0, 5), (1, 50, 51)], "g int, a int, b int")
    right = spark.createDataFrame([(1, 4, 9)], "g int, c int, d int")
    assert rows(joins.interval_join(left, right, ["g"], "a", "b", "c", "d", 2, "left"), "a", "c") == [(0, 4), (50, None)]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("AABBA")] + [(2, 3, "v"), (2, 4, "v"), (2, 6, "v"), (3, 0, None), (3, 1, None)], "g int, pos int, v string")
    assert rows(runs.runs(df, ["g"], "pos", "v"), "g", "run_start", "run_length") == [(1, 0, 2), (1, 2, 2), (1, 4, 1), (2, 3, 3), (3, 0, 2)]
    assert rows(runs.runs(df.filter("g = 2"), ["g"], "pos", "v", contiguous=True), "run_start", "run_length") == [(3, 2), (6, 1)]
    one = df.filter("g = 1")
    assert rows(runs.expand_runs(runs.runs(one, ["g"], "pos", "v"), ["g"], "v"), "pos", "v") == rows(one, "pos", "v")
    assert rows(runs.change_points(one, ["g"], "pos", "v"), "pos") == [(0,), (2,), (4,)]
    assert rows(runs.registry(df, "v", ["g", "pos"], F.length("v")), "v", "id", "value_offset") == [("A", 0, 0), ("B", 1, 1), ("v", 2, 2)]
    assert rows(runs.runs(df.filter("false"), ["g"], "pos", "v")) == []


def test_running_sum_over_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n")).repartition(5)
    got = global_running_sum(df, [F.col("id")], "n", "before", "rank").collect()
    assert all(r.rank == r.id and r.before == sum(i % 7 for i in range(r.id)) for r in got)
    assert global_running_sum(df.filter("false"), [F.col("id")], "n", "before").count() == 0


def test_layout_ties_and_repeats(spark):
    m = spark.createDataFrame([("b", "h1", 0), ("b", "h1", 4), ("a", "h1", 0), ("a", "h2", 4), ("c", "h3", 0), ("c", None, 9)], "file_id string, chunk_hash string, chunk_offset long")
    assert rows(layout.file_scores(m)) == [("a", 4, 2), ("b", 6, 2), ("c", 1, 2)]
    lengths = spark.createDataFrame([("h1", 4), ("h2", 5)], "chunk_hash string, length int")
    got = layout.chunk_layout(m, lengths).orderBy("position").collect()
    assert [(r.chunk_hash, r.layout_offset) for r in got] == [("h1", 0), ("h2", 4), ("h3", 9)]
    tie = spark.createDataFrame([("z", 3), ("y", 3)], "file_id string, score long")
    assert [r.file_id for r in layout.ranked_files(tie).orderBy("rank").collect()] == ["y", "z"]


def test_verification_finds_damage(spark):
    df = spark.createDataFrame([(1, bytes(range(256)) * 30), (2, b""), (3, None), (4, b"q" * 999)], "file_id long, content binary")
    chunks = chunking.content_chunks(df, "content", ["file_id"], 256)
    store = dedup.store(chunks)
    plain = verify.with_chunks(chunks.drop("chunk_data"), store)
    assert rows(verify.verified(plain, df), "file_id", "ok") == [(1, True), (2, True), (3, True), (4, True)]
    bad = chunks.filter("file_id = 4").first().chunk_hash
    harmed = store.withColumn("chunk_data", F.when(F.col("chunk_hash") == bad, F.lit(b"?")).otherwise(F.col("chunk_data")))
    assert rows(verify.verified(verify.with_chunks(chunks.drop("chunk_data"), harmed), df), "file_id", "ok") == [(1, True), (2, True), (3, True), (4, False)]
    gone = store.filter(F.col("chunk_hash") != bad)
    assert rows(verify.verified(verify.with_chunks(chunks.drop("chunk_data"), gone), df), "file_id", "ok")[3] == (4, False)


def test_climb_stops_at_growth():
    sizes = {1: 10, 2: 9, 4: 9, 8: 11, 16: 1}
    t = tuning.climb(sizes.__getitem__, 1, 16)
    assert [x.parameter for x in t] == [1, 2, 4, 8] and tuning.best(t).parameter == 4
    assert len(tuning.climb(lambda p: -p, 1, 1 << 30, timeout=-1)) == 1


def test_scalars(spark):
    assert scalars.parse_index_list("1,3,5-7") == [1, 3, 5, 6, 7]
    for bad in ("0", "3-1", "x", "300", ""):
        with pytest.raises(ValueError):
            scalars.parse_index_list(bad)
    assert [scalars.parse_size(x) for x in ("2kb", "256K", "64KiB", "10", "1.5 MiB")] == [2000, 262144, 65536, 10, 1572864]
    assert scalars.line_and_column("ab\ncd", 4) == (2, 2)
    df = spark.createDataFrame([("a/b\\c.TAR.gz",), (".x",), ("noext",), (None,)], "p string")
    assert [(r.e, r.s) for r in df.select(scalars.extension(F.col("p")).alias("e"), scalars.stem(F.col("p")).alias("s")).collect()] == [("gz", "c.TAR"), ("", ".x"), ("", "noext"), (None, None)]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 30,), (None,)], "n long").select(scalars.human_size(F.col("n")).alias("h")).collect()
    assert [r.h for r in sizes] == ["0 B", "1023 B", "1.5 KB", "5 GB", None]
    t = spark.createDataFrame([("00:02:00",), ("79:59:74",)], "t string")
    assert [r.f for r in t.select(scalars.parse_msf(F.col("t")).alias("f")).collect()] == [150, 359999]
    for bad in ("00:60:00", "00:00:75", "abc"):
        with pytest.raises(Exception, match="time"):
            spark.createDataFrame([(bad,)], "t string").select(scalars.parse_msf(F.col("t"))).collect()
    raw = spark.createDataFrame([(b"ok",), (b"a\xff",)], "b binary").select(scalars.lossy_name(F.col("b")).alias("s")).collect()
    assert [r.s for r in raw] == ["ok", "a�"]


SHEET = 'REM x\nFILE "a.bin" BINARY\n  TRACK 01 mode1/2352\n    INDEX 01 00:00:00\nFILE "b.bin" BINARY\r\n  TRACK 02 AUDIO\n    INDEX 00 00:00:00\n    INDEX 01 00:02:00\n'


def test_cue(spark):
    df = spark.createDataFrame([("s", SHEET), ("n", None)], "sheet string, text string")
    i = cue.parse_cue(df)
    assert rows(i, "file_name", "track_no", "track_mode", "index_no", "frames") == [("a.bin", 1, "MODE1/2352", 1, 0), ("b.bin", 2, "AUDIO", 0, 0), ("b.bin", 2, "AUDIO", 1, 150)]
    sizes = spark.createDataFrame([("s", "a.bin", 2352 * 10), ("s", "b.bin", 2352 * 200)], "sheet string, file_name string, size long")
    assert rows(cue.track_starts(cue.normalised(i, sizes), at="position"), "track_no", "content_start", "track_start", "next_start") == [(1, 0, 0, 10), (2, 160, 10, None)]
    for bad in ("INDEX 01 00:00:00", 'FILE "a" WAVE', "TRACK 01 AUDIO", 'FILE "a" BINARY\nTRACK 01 XY\nINDEX 01 00:00:00'):
        with pytest.raises(Exception):
            cue.parse_cue(spark.createDataFrame([("s", bad)], "sheet string, text string")).collect()
    with pytest.raises(Exception, match="INDEX 01"):
        cue.track_starts(cue.parse_cue(spark.createDataFrame([("s", 'FILE "a" BINARY\nTRACK 01 AUDIO\nINDEX 00 00:00:00')], "sheet string, text string"))).collect()
    lines = spark.createDataFrame([(1, 1, "#EXT"), (1, 2, " "), (1, 3, "dir/Game (Disc 1).chd\r"), (2, 1, None), (3, 1, "Game (Disc 1).cue")], "playlist_id long, line_no int, line_text string")
    assert rows(cue.collections(cue.playlist_entries(lines))) == [("Game (Disc 1)", 1)]
    rle = spark.createDataFrame([("d", 0, 0, 10, "Mode1"), ("d", 1, 10, 5, "PregapAudio"), ("d", 2, 15, 20, "Audio")], "disc string, run_no int, run_start long, run_length long, kind string")
    text = cue.cue_text(cue.cue_tracks(rle, "disc", F.col("kind")), "disc", F.lit("d.bin")).first().cue
    assert text == 'FILE "d.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 00:00:10\n    INDEX 01 00:00:15\n'


def make_disc(rng):
    """Sectors of every data kind, sound and broken, fill and audio."""
    u = lambda n, size: rng.integers(0, 256, (n, size)).astype(np.uint8)
    lba = np.arange(20) + 150
    m1 = disc.rebuild("Mode1", u(4, 2048), u(4, 8), lba[:4])
    sub = u(4, 8)
    f1 = disc.rebuild("Mode2Form1", u(4, 2048), sub & 0xDF, lba[4:8])
    f2 = disc.rebuild("Mode2Form2", u(4, 2324), sub | 0x20, lba[8:12])
    broken = [x.copy() for x in (m1[:1], f1[:1], f2[:1])]
    for x, at in zip(broken, (2065, 2073, 2349)):
        x[0, at] ^= 1
    return np.concatenate([m1, *broken[:1], f1, broken[1], f2, broken[2], np.zeros((2, 2352), np.uint8), u(20, 2352) | 1])


def test_disc_codes():
    assert disc.edc(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0x6EC2EDC4
    assert disc.edc(np.zeros((1, 0), np.uint8))[0] == 0
    assert [int(disc.gf_double(np.uint8(x))) for x in (0x80, 0xFF, 0)] == [0x1D, 0xE3, 0]
    s = make_disc(np.random.default_rng(1))[:4]
    assert all((disc.ecc(s[i : i + 1], False) == s[i, 2076:]).all() for i in range(4)), "batch and single agree"
    bad = s.copy()
    bad[0, 3000 % 2352] ^= 4
    assert disc.classify(bad)[0] == "Mode1Exception"
    with pytest.raises(ValueError):
        disc.classify(np.concatenate([s[:1, :15], [[3]], s[:1, 16:]], axis=1).astype(np.uint8))


def test_disc_roundtrip(spark):
    raw = make_disc(np.random.default_rng(2)).tobytes()
    images = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"")), (3, None), (4, bytearray(raw[:2352] + b"tail"))], "disc long, image binary")
    m = optical.sector_map(images)
    kinds = [r.kind for r in m.filter("disc = 1").orderBy("sector_idx").collect()]
    assert kinds[:5] == ["Mode1"] * 4 + ["Mode1Exception"] and kinds[9] == "Mode2Form1Exception" and kinds[14] == "Mode2Form2Exception" and kinds[15:17] == ["ZeroedMode1Data"] * 2 and set(kinds[17:]) == {"Audio"}
    back = optical.rebuilt(optical.shredded(m), optical.addresses(m)).filter("disc = 1").orderBy("sector_idx").collect()
    assert b"".join(bytes(r.sector) for r in back) == raw
    one = optical.rebuilt(optical.shredded(m).filter("disc = 1 and sector_idx = 6"), optical.addresses(m)).collect()
    assert bytes(one[0].sector) == raw[6 * 2352 : 7 * 2352]
    assert rows(optical.audio_blocks(m).filter("disc = 1"), "block_start", "block_count") == [(17, 16), (33, 4)]
    src = {r.sector_idx: r.source for r in optical.sector_sources(m, optical.audio_blocks(m)).filter("disc = 1").collect()}
    assert src[0] == "stream" and src[15] == "none" and src[20] == "block"
    stream = optical.user_stream(m).filter("disc = 1 and kind = 'Mode2Form2'").first()
    assert bytes(stream.stream) == b"".join(raw[i * 2352 + 24 : i * 2352 + 2348] for i in range(10, 14))
    assert {len(r.saved) for r in optical.exceptions(m).collect()} == {296, 20}
    tracks = spark.createDataFrame([(1, 2, 3, "MODE1/2352"), (1, 17, 20, "AUDIO")], "disc long, track_start long, content_start long, track_mode string")
    mapped = [r.kind for r in optical.sector_map(images, tracks=tracks).filter("disc = 1").orderBy("sector_idx").collect()]
    assert mapped[:4] == ["PregapAudio", "PregapAudio", "PregapMode1", "Mode1"] and mapped[17:21] == ["PregapAudio"] * 3 + ["Audio"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_are_lossless(data):
    assert codec.decode_audio(codec.encode_audio(data)) == data
    assert codec.decompress(codec.compress(data, b"", 3)) == data


def test_audio_of_sound_is_smaller():
    t = np.arange(16 * 588)
    pcm = np.stack([9000 * np.sin(t / 40), 8000 * np.sin(t / 41)], 1).astype("<i2").tobytes()
    assert len(codec.encode_audio(pcm)) < len(pcm) * 0.6


def test_archive(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 9000).astype(np.uint8).tobytes()
    data = [(1, "b.bin", base), (2, "a.bin", base[:5000] + b"!" + base[5000:]), (3, "empty", b""), (4, None, None), (5, "a.bin", base)]
    df = spark.createDataFrame(data, "file_id long, file_name string, content binary")
    path = str(tmp_path / "x.cla")
    done = compress.compress(df, path, config.Settings(window=512, level=3))
    assert done["files"] == 5 and done["compressed_bytes"] < done["bytes"]
    assert [(r["index"], r.filename, r.size_bytes) for r in extract.listing(spark, path).orderBy("index").collect()] == [(1, "", 0), (2, "a.bin", 9001), (3, "a.bin", 9000), (4, "b.bin", 9000), (5, "empty", 0)]
    assert all(r.ok for r in extract.verify(spark, path).collect())
    assert [r.filename for r in extract.selected(spark, path, "4-5").orderBy("toc_no").collect()] == ["b.bin", "empty"]
    with pytest.raises(ValueError):
        extract.selected(spark, path, "6")
    q = spark.createDataFrame([(7, 4, 4990, 600), (8, 4, 0, 0)], "request_id int, toc_no long, seek_offset long, seek_length long")
    got = {r.request_id: bytes(r.bytes) for r in extract.read_ranges(spark, path, q).collect()}
    assert got == {7: base[4990:5590], 8: b""}
    with pytest.raises(ValueError, match="out of bounds"):
        extract.read_ranges(spark, path, q.withColumn("seek_length", F.lit(99_999).cast("long")))
    out = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        extract.extract(spark, path, out)
    names = {r.filename: r.size for r in extract.extract(spark, path, out, force=True).collect()}
    assert names == {"1_unnamed": 0, "2_a.bin": 9001, "3_a.bin": 9000, "b.bin": 9000, "empty": 0}
    assert open(f"{out}/b.bin", "rb").read() == base
    with pytest.raises(Exception):
        compress.compress(df, path, config.Settings(window=512, level=3))
    one = archive.assemble(path, str(tmp_path / "one.cla"))
    assert all(r.ok for r in extract.verify(spark, one).collect()) and extract.listing(spark, one).count() == 5
    assert {r.request_id: bytes(r.bytes) for r in extract.read_ranges(spark, one, q).collect()} == got
    with archive.Bytes(path) as a, archive.Bytes(one) as b:
        assert len(a.segments) > len(b.segments) == 1 and a.size == b.size and a.read(0, a.size) == b.read(0, b.size)
        with pytest.raises(archive.ArchiveError, match="cut off"):
            b.read(b.size - 3, 4)
    compress.compress(df.filter("file_id < 3"), path, config.Settings(window=512, level=3, force=True))
    assert extract.listing(spark, path).count() == 2 and len([n for n in os.listdir(tmp_path) if n.endswith(".volumes")]) == 1
    archive.assemble(path)
    assert all(r.ok for r in extract.verify(spark, path).collect()) and not [n for n in os.listdir(tmp_path) if n.endswith(".volumes")]
    raw = bytearray(open(one, "rb").read())
    raw[-100] ^= 255
    broken = str(tmp_path / "broken.cla")
    open(broken, "wb").write(raw)
    try:
        harmed = [r.ok for r in extract.verify(spark, broken).collect()]
        assert not all(harmed)
    except Exception as e:  # noqa: BLE001
        assert "zstd" in str(e).lower() or "decompress" in str(e).lower()
    open(broken, "wb").write(b"NOTMAGIC" + bytes(raw[8:]))
    with pytest.raises(archive.ArchiveError):
        archive.read_header(broken)
    newer = bytearray(raw)
    newer[8:12] = (0x00030000).to_bytes(4, "little")
    open(broken, "wb").write(newer)
    with pytest.raises(archive.ArchiveError, match="newer"):
        archive.read_header(broken)


def test_large_files_are_archived_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(8)
    src = tmp_path / "in"
    src.mkdir()
    data = {"a.bin": rng.integers(0, 256, 70_000).astype(np.uint8).tobytes(), "b.bin": b"", "c.bin": b"ab" * 9000}
    data["d.bin"] = data["a.bin"][100:60_000]
    for k, v in data.items():
        (src / k).write_bytes(v)
    path, out = str(tmp_path / "x.cla"), str(tmp_path / "out")
    done = compress.compress_files(spark, [str(src), str(tmp_path / "none")], path, config.Settings(window=512, level=3), range_bytes=8192)
    assert done["files"] == 4 and done["bytes"] == sum(map(len, data.values())) and done["compressed_bytes"] < 90_000
    assert all(r.ok for r in extract.verify(spark, path).collect())
    assert {r.filename: r.size for r in extract.extract(spark, path, out, force=True).collect()} == {k: len(v) for k, v in data.items()}
    assert all((tmp_path / "out" / k).read_bytes() == v for k, v in data.items())
    rowed = files.read_files(spark, [str(src)]).select(F.col("path").alias("file_id"), F.col("name").alias("file_name"), "content")
    assert compress.compress(rowed, str(tmp_path / "y.cla"), config.Settings(window=512, level=3))["unique_chunks"] == done["unique_chunks"]


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "sub").mkdir()
    (tmp_path / "d" / "a.cue").write_text("x")
    (tmp_path / "d" / "b.bin").write_bytes(b"123")
    (tmp_path / "d" / "l").symlink_to(tmp_path / "d" / "b.bin")
    df = files.read_files(spark, [str(tmp_path / "d"), str(tmp_path / "none")])
    assert rows(df, "name", "length") == [("a.cue", 1), ("b.bin", 3)]
    assert rows(files.read_texts(spark, [str(tmp_path / "d")], "cue"), "name", "text") == [("a.cue", "x")]
    assert files.read_files(spark, []).count() == 0
    (tmp_path / "d" / "empty.bin").write_bytes(b"")
    both = files.read_files(spark, [str(tmp_path / "d")])
    assert rows(both, "name", "length", "content") == [("a.cue", 1, b"x"), ("b.bin", 3, b"123"), ("empty.bin", 0, b"")]
    assert rows(files.read_files(spark, [str(tmp_path / "d")], "*.bin"), "name") == [("b.bin",), ("empty.bin",)]
    assert rows(files.read_files(spark, [str(tmp_path / "d" / "empty.bin")]), "name") == [("empty.bin",)]
    (tmp_path / "d" / "empty.bin").unlink()
    assert "content" not in df.agg(F.sum("length"))._jdf.queryExecution().executedPlan().toString()
    lib = spark.createDataFrame([("/r/M/S/G/1",), ("/r/M/S/G/2",), ("x",)], "path string")
    assert rows(files.library(lib), "manufacturer", "system", "game", "files") == [("M", "S", "G", 2)]


def test_settings(tmp_path):
    p = str(tmp_path / "c.toml")
    assert config.load(p) == config.Settings() and config.load(p) == config.Settings()
    open(p, "w").write('window = "4KiB"\nlevel = 3\n')
    s = config.merge(config.load(p), {"level": 5, "window": None})
    assert (s.window, s.level) == (4096, 5) and config.Settings(optical=True).sizes() == (8192, 131072)
    for bad in ({"window": 1000}, {"level": 0}, {"hash_bits": 32}, {"auto_tune": True, "window": 512}):
        with pytest.raises(ValueError):
            config.merge(config.Settings(), bad).checked()


def test_streamed_windows(spark):
    from chunklake.streaming.ingest import windowed_arrivals

    t = datetime.datetime(2024, 1, 1, 5, 30)
    df = spark.createDataFrame([(t, "a"), (t, None)], "received_at timestamp, chunk_hash string")
    assert rows(windowed_arrivals(df), "messages", "keyed") == [(2, 1)]


def test_disc_archive(spark, tmp_path, capsys):
    from chunklake import cli
    from chunklake.plans import discs

    raw = make_disc(np.random.default_rng(2)).tobytes()
    src = tmp_path / "in"
    src.mkdir()
    (src / "Game (Disc 1).bin").write_bytes(raw[: 17 * 2352])
    (src / "tail.bin").write_bytes(raw[17 * 2352 :])
    (src / "Other.bin").write_bytes(raw[17 * 2352 :] * 2)
    (src / "Game (Disc 1).cue").write_text('FILE "Game (Disc 1).bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\nFILE "tail.bin" BINARY\n  TRACK 02 AUDIO\n    INDEX 00 00:00:00\n    INDEX 01 00:00:03\n')
    (src / "Other.cue").write_text('FILE "Other.bin" BINARY\n  TRACK 01 AUDIO\n    INDEX 01 00:00:00\n')
    (src / "set.m3u").write_text("#EXTM3U\nGame (Disc 1).cue\n")
    path = str(tmp_path / "d.cla")
    assert cli.main(["compress", str(src), "-o", path, "--optical", "--level", "3", "--window", "1024"], spark) == 0
    assert cli.main(["verify", path], spark) == 0
    assert rows(extract.listing(spark, path), "filename", "size_bytes", "collection_id") == [("Game (Disc 1)", len(raw), 0), ("Other", 40 * 2352, None)]
    assert cli.main(["extract", path, "-o", str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / "Game (Disc 1).bin").read_bytes() == raw and (tmp_path / "out" / "Other.bin").read_bytes() == raw[17 * 2352 :] * 2
    assert "INDEX 00 00:00:17\n    INDEX 01 00:00:20" in (tmp_path / "out" / "Game (Disc 1).cue").read_text()
    want = spark.createDataFrame([(1, 9), (1, 18)], "toc_no long, sector_idx long")
    assert {r.sector_idx: bytes(r.sector) for r in discs.disc_sectors(spark, path, want).collect()} == {i: raw[i * 2352 : (i + 1) * 2352] for i in (9, 18)}
    with pytest.raises(archive.ArchiveError):
        archive.ArchiveReader(path, "manifest").partitions()


def test_command_line(spark, tmp_path, capsys):
    from chunklake import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_bytes(b"hello " * 300)
    path = str(tmp_path / "c.cla")
    assert cli.main(["compress", str(tmp_path / "in"), "-o", path, "--window", "512", "--level", "3"], spark) == 0
    assert cli.main(["info", path, "--json"], spark) == 0 and cli.main(["info", path], spark) == 0
    assert '"filename":"f.txt"' in capsys.readouterr().out
    assert cli.main(["verify", path], spark) == 0
    assert cli.main(["extract", path, "-o", str(tmp_path / "out"), "--force"], spark) == 0
    assert (tmp_path / "out" / "f.txt").read_bytes() == b"hello " * 300
