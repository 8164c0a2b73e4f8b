"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import json
import math
import os

import pytest

from posegrid.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) + 0.0 if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF_DIR)
    want = tables.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_complete_skeletons_have_all_joints(spark, tables):
    want = tables.sql("SELECT vec_id FROM embeddings WHERE list_bool_and(list_transform(range(14), lambda k: embedding[3 * k + 1] > -0.3))").fetchall()
    got = QUERIES["complete_skeletons"](spark, SF_DIR).collect()
    assert sorted(r["frame_id"] for r in got) == sorted(x for (x,) in want)
    assert all(len(json.loads(r["json"])["joints"]) == 14 for r in got)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("stream, batch", [("stream_codebook", "codebook_fold"), ("stream_people", "people_fold")])
def test_stream_equals_batch(spark, stream, batch):
    a, b = (QUERIES[n](spark, SF_DIR) for n in (stream, batch))
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


def test_entry_module_runs():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
