import os

import pytest
from conftest import SMALL

from chunklake.plans import registry


#: Whole pipelines, whose steps test_operators.py tests; ALL_SQL=1 runs them here too.
PIPELINES = {"archive_extract", "archive_seek", "archive_toc", "command_line", "disc_archive_sector", "disc_extract", "ingest_store", "made_disc_archive"}
NAMES = sorted(set(registry.oracle_sql()) - (set() if os.environ.get("ALL_SQL") else PIPELINES))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, same_as_sql, name):
    same_as_sql(spark, SMALL, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SMALL).count() >= 0


def test_entry_needs_no_subpackage():
    import __spark_entry__ as e

    assert "p3_found" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
