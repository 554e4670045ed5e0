"""Queries against their SQL on the small tables."""

import os

import duckdb
import pytest

from gleanery.plans import more
from gleanery.plans import queries as plans

QUERIES, SQL = {**plans.QUERIES, **more.QUERIES}, {**plans.SQL, **more.SQL}

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == plain(want)


def test_inspect_files_reads_every_row(spark, db):
    got = plans.QUERIES["inspect_files"](spark, DIR).where("row = 'file'").groupBy("file_id").count().collect()
    wanted = {f"{kind}-{i}" for kind, t, c in (("page", "pages", "page_id"), ("doc", "documents", "doc_id"), ("item", "benchmark", "item_id")) for (i,) in db.sql(f"select {c} from {t}").fetchall()}
    assert wanted <= {r["file_id"] for r in got} and all(r["count"] == 1 for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
