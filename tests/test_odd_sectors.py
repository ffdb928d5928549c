"""Data sectors of a mode that discs don't have, or with an address that can't be made again: queries keep them and go on."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chunklake.functions import disc
from chunklake.plans import registry

#: Queries with SQL.
NAMES = ["disc_archive_verify", "disc_extract", "disc_sources", "disc_addresses", "disc_audio_blocks", "disc_roundtrip", "disc_subheaders", "disc_user_data", "sector_classify", "disc_archive_sector", "disc_sizes", "disc_user_bytes", "disc_verify"]


def made(kind: str, lba: int, change: dict[int, int] | None = None) -> bytes:
    rng = np.random.default_rng(lba)
    extra = rng.integers(0, 256, (1, 8), np.uint8) & 0xDF | (32 if kind == "Mode2Form2" else 0)
    s = disc.rebuild(kind, rng.integers(0, 256, (1, disc.KINDS[kind][0]), np.uint8), extra.astype(np.uint8), np.array([lba]))
    for at, value in (change or {}).items():
        s[0, at] = value
    return s.tobytes()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Three discs: modes 0, 3, 7 and 130 among sound sectors; addresses that are no decimal digits, or beyond 60 seconds or 75 frames; addresses before their index."""
    kinds = ("Mode1", "Mode2Form1", "Mode2Form2")
    modes = [made(k, 150 + 2 * i + j, {15: m} if j else None) for i, (k, m) in enumerate((k, m) for k in kinds for m in (0, 3, 7, 130)) for j in (0, 1)]
    places = [made(k, 150 + i, {at: v}) for i, (k, at, v) in enumerate((k, at, v) for k in kinds for at, v in ((12, 0x1F), (13, 0x75), (14, 0x99), (12, 0xFF)))]
    early = [made(kinds[i % 3], 150 + i if i < 6 else i - 6) for i in range(12)]
    folder = tmp_path_factory.mktemp("odd")
    images = [b"".join(x) for x in (modes, places, early)]
    pq.write_table(pa.table({"file_id": [1, 2, 3], "file_name": ["a", "b", "c"], "file_data": pa.array(images, pa.binary())}), folder / "filedata.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, same_as_sql, odd, name):
    same_as_sql(spark, odd, registry.queries()[name], registry.oracle_sql()[name])


def test_user_chunks(spark, odd):
    """Every byte of user data is in a chunk."""
    got = registry.queries()["disc_user_chunks"](spark, odd).groupBy("disc").agg({"chunk_length": "sum"}).collect()
    sizes = [2048] * 8 + [2048] * 8 + [2324] * 8, [2048] * 8 + [2324] * 4, [2048, 2048, 2324] * 4
    # A mode that is neither 1 nor 2 has the form its bit tells.
    forms = sum(2324 if made("Mode1", 151 + 2 * i)[18] & 32 else 2048 for i in range(4))
    assert {r[0]: r[1] for r in got} == {1: sum(sizes[0]) - 4 * 2048 + forms, 2: sum(sizes[1]), 3: sum(sizes[2])}


def test_exceptions(spark, odd):
    """Each odd sector is an exception, and no other is."""
    got = {(r.disc, r.sector_idx) for r in registry.queries()["disc_exceptions"](spark, odd).collect()}
    assert got == {(1, i) for i in range(1, 24, 2)} | {(2, i) for i in range(12)} | {(3, i) for i in range(6, 12)}


def test_kinds(spark, odd):
    got = {r.kind: r.sectors for r in registry.queries()["sector_kinds"](spark, odd).collect()}
    assert sum(got.values()) == 48 and sum(n for k, n in got.items() if k.endswith("Exception")) == 30


@pytest.mark.parametrize("name", ["disc_archive_sector", "disc_archive_verify"])
def test_ids_of_more_digits(spark, same_as_sql, tmp_path, name):
    """Discs are numbered by id, also where titles don't sort as ids do."""
    images = [made("Mode1", 150 + 2 * i) + made("Mode1", 151 + 2 * i) for i in range(3)]
    pq.write_table(pa.table({"file_id": [20_000_001, 100_000_001, 7], "file_data": pa.array(images, pa.binary())}), tmp_path / "filedata.parquet")
    same_as_sql(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name])
