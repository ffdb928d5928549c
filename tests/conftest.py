import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from chunklake.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}"})
    yield s
    s.stop()


def _value(v):
    import decimal
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query with its SQL over a folder of tables."""
    import duckdb

    def run(spark, folder, query, sql):
        con = duckdb.connect()
        for name in os.listdir(folder):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{name}')")
        df = query(spark, folder)
        cols = sorted(df.columns)
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(repr([_value(r[i]) for i in at]) for r in got.fetchall())
        assert sorted(repr([_value(v) for v in r]) for r in df.select(*cols).collect()) == want

    return run
