"""The registered queries against their SQL, and the pipeline stage by stage, on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from gleanery.llm import queries as Q

DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*sorted(Q.SQL), "op8_sharding"])
def test_query(spark, db, name):
    sql = Q.SQL.get(name) or Q.SHARDING_SQL
    got = Q.QUERIES[name](spark, DIR)
    if name == "op8_sharding":
        texts = dict(db.sql("select doc_id, coalesce(text, '') from documents").fetchall())
        assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got.collect())
        got = got.drop("text_crc32")
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({sql})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 11))
