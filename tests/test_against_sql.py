"""Every core query on the smallest tables against its SQL."""

import os

import duckdb
import pytest

from notelake import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if isinstance(v, float) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, SF)
    want = sql.execute(plans.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(plans.QUERIES) - set(plans.ORACLE) == {"file_scan", "quad_decode_dirty", "bpe_iterative", "bpe_apply_ranked"}
