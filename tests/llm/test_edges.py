"""Every dealt operator on nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontaminate as D
from gleanery.llm import embed_dedup as E
from gleanery.llm.embed_dedup import similar_vectors
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.minhash_dedup import near_duplicates
from gleanery.llm.packing import pack
from gleanery.llm.quality import co_train
from gleanery.llm.sharding import histogram_shard
from gleanery.llm.substring_dedup import substring_dedup
from gleanery.llm.toxicity import toxicity, train

CLASHING = """id of k1 k2 _k1 _k2 _size size block _block _shard begin _start _drop _drop_id _drop_of _n_drop _marks marks n_drop drop_id c0 c1 row rows
_searched _scored y _y fold meta h n a b v w q cells reference at length spans digest print anchors bands bucket hub component queue node part run ids""".split()
LONG = " ".join("w%d" % (i % 977 + i // 977) for i in range(120_000))
TEXTS = [None, "", " ", "x", LONG, LONG, "x", "a b c d e f g\nx\n" * 3]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (None, None), (3, "x")]
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None, None, None, *(f"keep {c}" for c in CLASHING)) for r in rows], schema)


def kept(rows):
    return len(rows) == 11 and all(r[c] == f"keep {c}" for r in rows for c in CLASHING)


def test_line_dedup(odd):
    rows = line_dedup(odd, min_docs=3).collect()
    assert kept(rows) and {r["n_dropped"] for r in rows if r["doc_id"] == 7} == {3}
    assert all(r["text"] == "" and r["n_lines"] == 1 for r in rows if r["doc_id"] in (0, 1))


def test_sharding(odd):
    rows = histogram_shard(odd, size=F.octet_length(F.coalesce("text", F.lit(""))) + 16, text=F.col("text"), ident=F.col("doc_id"), shards=3).collect()
    assert kept(rows) and sorted({(r["shard"], r["slot"]) for r in rows}) == sorted((r["shard"], r["slot"]) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1


def test_decontamination(odd, spark, monkeypatch):
    bench = spark.createDataFrame([(k, t, "keep") for k, t in ((1, "X"), (2, "c d e"), (3, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (4, "nowhere"), (None, "x"))], "item_id long, text string, id string")
    one = D.find_benchmark(odd, bench).collect()
    monkeypatch.setattr(D, "BLOCK_BYTES", 2)
    many = D.find_benchmark(odd, bench).collect()
    assert kept(one) and kept(many) and sorted(map(repr, one)) == sorted(map(repr, many))
    found = {r["doc_id"]: r for r in one if r["doc_id"] is not None}
    assert found[3]["items"] == ["1"] and found[7]["items"] == ["1", "2"] and found[4]["items"] == ["3"] == found[5]["items"]
    assert not found[0]["hits"] and found[4]["n_words"] == 120_000


def test_toxicity(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = train(odd.unionByName(odd), labels)
    rows = toxicity(odd, model).collect()
    assert kept(rows) and all(0 <= r["toxicity"] <= 1 for r in rows) and model == train(odd, labels)


def test_quality(odd, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(3, None), (None, 1)], "doc_id long, quality int")
    rows = co_train(odd, labels, rounds=1).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, co_train(odd.repartition(3), labels, rounds=1).collect()))
    assert len(co_train(odd, labels.where("quality = 1")).collect()) == 11


def test_near_duplicates(odd):
    rows = near_duplicates(odd).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == 11 and by_id[5]["component_id"] == 4 and by_id[6]["component_id"] == 3 and by_id[0]["kept"] and by_id[2]["n_shingles"] == 0
    assert all(r["kept"] for r in rows if r["doc_id"] is None)


def test_substring_dedup(odd):
    rows = substring_dedup(odd).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert kept(rows) and by_id[5]["n_removed"] == 120_000 and by_id[4]["n_removed"] == 0 and by_id[5]["text"] == "" == by_id[0]["text"]
    assert all(f["reference"] < r["doc_id"] for r in rows for f in r["factors"])


def test_substring_factors_follow_one_place(spark):
    ws = ["w%d" % i for i in range(400)]
    # the second holds two passages of the first side by side: two factors, each of one place
    rows = [(1, " ".join(ws)), (2, " ".join(ws[200:300] + ws[20:120])), (3, " ".join(ws[200:260])), (2, " ".join(["z"] * 40))]
    got = [r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 2]
    long = next(r for r in got if r["n_words"] == 200)
    assert [(f["start"], f["length"], f["reference"], f["at"]) for f in long["factors"]] == [(0, 100, 1, 200), (100, 100, 1, 20)] and long["n_removed"] == 200
    assert next(r for r in got if r["n_words"] == 40)["n_removed"] == 0


def test_packing(odd):
    rows = pack(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 1 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + i, [1.0 + (n + i * k) % 3 * 1e-3 for k in range(n)], "x") for n in range(1, 1_051) for i in (0, 1)] + [(None, [1.0], "x"), (5_000, None, "x")]
    got = {r["vec_id"]: r for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cells string")).collect()}
    assert all(got[2 * n + i]["n_links"] == 1 and got[2 * n + i]["component_id"] == 2 * n for n in range(1, 1_051) for i in (0, 1))
    assert got[None]["n_links"] == 0 == got[5_000]["n_links"]


def test_recall_of_sorted_passes(spark, monkeypatch):
    monkeypatch.setattr(E, "WINDOW", 64)
    monkeypatch.setattr(E, "TILE", 40)
    E.passes.cache_clear()
    rng = np.random.default_rng(5)
    # pairs near the threshold, and a group far larger than a cell
    base = rng.standard_normal((700, 32))
    centre = rng.standard_normal(32)
    x = np.concatenate([base, base + 0.45 * rng.standard_normal(base.shape), centre + 0.2 * rng.standard_normal((300, 32))])
    got = {r["vec_id"]: r["n_links"] for r in similar_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    E.passes.cache_clear()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and found[:1_400].sum() >= 0.9 * want[:1_400].sum()
