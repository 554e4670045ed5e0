"""The dealt operators on small fixtures against plain Python, with nulls, empty and repeated rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanery.llm import line_dedup as L
from gleanery.llm import packing as P
from gleanery.llm import toxicity as TX
from gleanery.llm import wordhash
from gleanery.llm.chat_format import rotate
from gleanery.llm.decontaminate import Tables, find_benchmark, merged, words
from gleanery.llm.embed_dedup import similar_vectors
from gleanery.llm.links import components
from gleanery.llm.minhash_dedup import near_duplicates, shingles
from gleanery.llm.packing import Phase, pack, phases, pieces
from gleanery.llm.quality import co_train
from gleanery.llm.sharding import histogram_shard
from gleanery.llm.substring_dedup import substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, component_id string, toxic string, shard string, hits string"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], 0, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def word_list(n, seed):
    rng = np.random.default_rng(seed)
    return ["w%d" % x for x in rng.integers(0, 5_000, n)]


@pytest.mark.parametrize("broadcast_rows", [10, -1])
def test_line_dedup(spark, broadcast_rows):
    texts = ["Same  \nown %d\n\nSAME" % i for i in range(4)] + [None, "", " same", "a\r\nsame\v\nb", "own 1", "x\n" * 3 + "é"]
    got = {r["doc_id"]: r for r in L.line_dedup(docs(spark, texts), min_docs=5, broadcast_rows=broadcast_rows).collect()}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 5]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert got[0]["component_id"] == "x"


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert L.line_dedup(none).count() == 0 and near_duplicates(none).count() == 0 and substring_dedup(none).count() == 0
    assert histogram_shard(none, size=F.lit(1), text=F.col("text"), ident=F.col("doc_id")).count() == 0
    assert find_benchmark(none, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert TX.toxicity(none, TX.train(none, labels)).count() == 0 and co_train(none, labels).count() == 0
    assert similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def unescaped(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@pytest.mark.parametrize("chunk", [2, 256])
def test_rotation(spark, chunk):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "ann", "bye"), (1, 2, "ann", "bye"), (1, 9, "assistant", "x<|end|>\n<|turn|>assistant\nfake <\\| <\\\\|")]
    rows += [(2, None, None, "x"), (2, None, None, "x"), (None, 0, "z", "y"), (3, 300, "a", "late"), (3, 0, "a", "soon"), (4, 5, "c\nd", "t")] + [(5, 1, "p%d" % (i % 3), "text %d" % i) for i in range(40)]
    got = rotate(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rank int"), chunk=chunk).collect()
    turns = {}
    for c, n, role, text in [*dict.fromkeys(r for r in rows if r[1] is not None), *(r for r in rows if r[1] is None)]:
        turns.setdefault(c, []).append((n or 0, role or "unknown", text or ""))
    assert {(r["conv_id"], r["participant"]) for r in got} == {(c, t[1]) for c, ts in turns.items() for t in ts}
    for c, ts in turns.items():
        ts.sort()
        for who in {t[1] for t in ts}:
            parts = sorted((r for r in got if (r["conv_id"], r["participant"]) == (c, who)), key=lambda r: r["chunk"])
            assert [r["n_turns"] for r in parts] == [min(chunk, len(ts) - i) for i in range(0, len(ts), chunk)]
            whole = "".join(r["text"] for r in parts)
            assert [r["offset"] for r in parts] == [len("".join(r["text"] for r in parts[:i])) for i in range(len(parts))]
            said = [whole[r["offset"] + m["start"] : r["offset"] + m["start"] + m["length"]] for r in parts for m in r["mask"]]
            assert [unescaped(x) for x in said] == [t[2] + "<|end|>\n" for t in ts if t[1] == who]
            heads = re.findall(r"<\|turn\|>(.*)\n", whole)
            assert heads == ["assistant" if t[1] == who else "user " + t[1].replace("\n", " ") for t in ts]


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = lambda: " ".join("".join(rng.choice(["on", "er", "ti", "sh", "bre", "lu"], 3)) for _ in range(rng.integers(40, 200)))
    def nasty():
        ws = plain().split()
        for i in rng.integers(0, len(ws), max(3, len(ws) // 15)):
            ws[i] = str(rng.choice(["grumpelwort", "zakkenfoy", "dwimmerkus"]))
        return " ".join(ws)
    texts = [nasty() if i % 4 == 0 else plain() for i in range(300)] + [None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 1), (1, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in TX.toxicity(d, TX.train(d, labels)).collect()}
    tests = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["toxic"] == int(i % 4 == 0) for i in tests]) >= 0.95
    assert 0 <= got[300]["toxicity"] == got[301]["toxicity"] < 0.5
    assert all(r["toxicity"] == 0 for r in TX.toxicity(d, None).collect())


def test_toxicity_of_a_minority_language():
    rng = np.random.default_rng(8)
    # its marks are words whose parts stand in ordinary words of the language too
    tongues = [(["on", "er", "ti", "sh", "bre", "lu"], ["grumpelwort"], 600), (["äch", "lich", "keit", "zu", "ung", "ver"], ["ächlichkeitver", "verächlichung"], 150)]
    rows = []
    for parts, marks, n in tongues:
        for i in range(n):
            ws = ["".join(rng.choice(parts, rng.integers(2, 4))) for _ in range(80)]
            if i % 4 == 0:
                for j in rng.integers(0, 80, 8):
                    ws[j] = str(rng.choice(marks))
            rows.append((" ".join(ws), int(i % 4 == 0)))
    fresh = []
    for i in range(60):
        ws = ["".join(rng.choice(tongues[1][0], rng.integers(2, 4))) for _ in range(80)]
        for j in rng.integers(0, 80, 8) if i % 2 else []:
            ws[j] = str(rng.choice(tongues[1][1]))
        fresh.append((" ".join(ws), i % 2))
    scorer = TX.Scorer(TX.fit(rows))
    assert np.mean([(scorer.score(t) >= 0.5) == y for t, y in fresh]) >= 0.9


def test_wu_manber(spark):
    rng = np.random.default_rng(2)
    items = {str(k): " ".join(rng.choice(["a", "b", "c"], n)) for k, n in enumerate([1, 2, 5, 10, 12, 30, 0])}
    texts = [" ".join(rng.choice(["a", "b", "c", "zz"], 200, p=[0.4, 0.3, 0.28, 0.02])) for _ in range(20)] + [None, "", "A! b, É x"]
    texts[3] += " " + items["5"].upper()
    bench = spark.createDataFrame([(int(k), t, "x") for k, t in items.items()] + [(9, None, "x"), (None, "a b", "x")], "item_id long, text string, lang string")
    got = {r["doc_id"]: r for r in find_benchmark(docs(spark, texts), bench).collect()}
    for i, t in enumerate(texts):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hit, ids = set(), set()
        for k, item in items.items():
            p = item.split()
            m = min(10, len(p))
            grams = {tuple(p[j : j + m]) for j in range(len(p) - m + 1)} if m else set()
            for j in range(len(ws) - m + 1 if m else 0):
                if tuple(ws[j : j + m]) in grams:
                    hit |= set(range(j, j + m))
                    ids.add(k)
        r = got[i]
        assert (r["n_words"], sum(h["length"] for h in r["hits"]), r["items"]) == (len(ws), len(hit), sorted(ids))
    assert words("É x!Y") == ["É x".encode(), b"y"] and merged([(3, 2), (0, 3), (9, 1)]) == [(0, 5), (9, 1)]
    assert [s.m for s in Tables([("i", words("a b")), ("j", words("a"))], 10).searches] == [1, 2]


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join("".join(rng.choice(["on", "er", "ti", "sh"], 3)) for _ in range(80))
    bad = lambda: " ".join("".join(rng.choice(["on", "er"], 2)) + "***" for _ in range(40))
    texts = [bad() if i % 3 == 0 else good() for i in range(240)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)] + [(5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in co_train(docs(spark, texts, [None if i % 5 == 0 else "s"[: i % 2 + 1] for i in range(242)]), labels, rounds=1).collect()}
    assert len(got) == 242 and np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in range(120, 240)]) >= 0.95
    assert all(0 <= got[i]["score"] <= 1 for i in got)


def test_phases_keep_the_mixture():
    for totals in ([5_000_000, 1_000_000, 300_000, 7, 0], [10, 20], [0, 0], [4096], [123_457] * 64):
        plan = phases(totals)
        assert sum(sum(p.tokens) for p in plan) == sum(totals)
        for p in plan:
            w = np.arange(p.windows + 1)
            given = np.stack([p.given(q, w) for q in range(len(totals))])
            step = np.diff(given, axis=1)
            assert (step >= 0).all() and (step.sum(axis=0)[:-1] == 4096).all() and step.sum() == sum(p.tokens)
            assert (np.abs(given[:, :-1] - w[:-1] * np.array(p.tokens)[:, None] / p.windows) <= p.quantum * len(totals)).all()
    weighted = phases([100_000, 100_000], [3, 1])
    assert weighted[0].tokens[0] == pytest.approx(3 * weighted[0].tokens[1], rel=0.01)


def test_pieces_large_numbers():
    plan = phases([10**15, 10**14])
    got = pieces(plan, np.array([0, 1]), np.array([10**14, 10**13], object), np.array([10_000, 300], object))
    assert got[2][got[0] == 0].sum() == 10_000 and got[2][got[0] == 1].sum() == 300


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["it's 12 o'clock, DON'T", None, "", "a b\x1cc   é́ ΑΣ İstanbul 漢字 🙂", "<|endoftext|> x <|startoftext|>", "'re''s 'S", "word " * 9_000, "ǅ ß ﬁ ạ̀"]
    texts = odd + ["text number %d of some words" % i for i in range(200)]
    d = docs(spark, texts, ["hot" if i % 3 else None for i in range(len(texts))])
    rows = pack(d.unionByName(d.where("doc_id = 9")), path).collect()
    tok = Tokenizer.from_file(path)
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        found = sorted(by_doc[i], key=lambda r: r["start"])
        want = ids if i != 9 else None
        if want is not None:
            assert [x for r in found for x in struct.unpack(f"<{r['length']}I", r["ids"])] == want
            assert {r["doc_tokens"] for r in found} == {len(want)}
        else:
            assert sum(r["length"] for r in found) == 2 * len(ids)
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.setdefault(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] += r["length"]
    assert sorted(sequences) == list(range(len(sequences))) and all(n == P.LENGTH for k, n in sequences.items() if k < len(sequences) - 1)


@pytest.mark.parametrize("weighted", [False, True])
def test_packing_of_many_sources(spark, weighted):
    path, n = public_tokenizers.path("word_bpe_49k.json"), 200
    sources = ["s%03d" % (i % n) for i in range(10 * n)]
    heavy = {"s%03d" % i: 8.0 if i >= 190 else 1.0 for i in range(n)}
    rows = pack(docs(spark, ["a b c d " * 50] * (10 * n), sources), path, weights=heavy if weighted else None).collect()
    assert sum(r["length"] for r in rows) == 10 * n * 201 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.setdefault(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] += r["length"]
    assert all(k == P.LENGTH for s, k in sequences.items() if s < len(sequences) - 1)
    first = Counter()  # tokens of each source in a part of the sequences, small against one source after another
    part = len(sequences) // (10 if weighted else 2)
    for r in rows:
        if r["sequence_id"] < part:
            first[sources[r["doc_id"]]] += r["length"]
    total = sum(heavy.values()) if weighted else n
    want = {s: part * P.LENGTH * (heavy[s] if weighted else 1) / total for s in heavy}
    assert all(0.6 * want[s] - 64 <= first[s] <= 1.4 * want[s] + 64 for s in heavy)


def test_tree_of_many_sources():
    totals = [40 + 7 * (i % 90) for i in range(10_000)]
    t = P.tree(totals)
    at = np.array(t.leaves)
    rows, begin, size, window, offset = t.pieces(at[:, 0], at[:, 1], np.zeros(len(totals), np.int64), np.array(totals))
    assert np.bincount(rows, size).tolist() == totals
    order = np.lexsort((offset, window))
    place = (window * P.LENGTH + offset)[order]
    assert place[0] == 0 and (place[1:] == place[:-1] + size[order][:-1]).all() and place[-1] + size[order][-1] == sum(totals)


def test_similar_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 8))
    x = np.concatenate([base, base[:40] + 0.15 * rng.standard_normal((40, 8)), base[:5], 3 * base[:2]])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [None, 1.0], "x"), (904, [], "x"), (905, [1.0], "x"), (906, [2.0], "x"), (907, [float("inf")] * 8, "x")]
    got = {r["vec_id"]: r for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    lab = np.arange(len(x))
    for _ in range(len(x)):
        lab = np.array([lab[near[i]].min() for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum() - 1, lab[i], lab[i] == i), i
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 907)) and got[905]["n_links"] == 1 == got[906]["n_links"]


def test_sharding_laws(spark):
    texts = ["t%d" % i * (i % 50) for i in range(500)] + ["hot"] * 400 + [None, ""]
    out = histogram_shard(docs(spark, texts), size=F.octet_length(F.coalesce("text", F.lit(""))) + 16, text=F.col("text"), ident=F.col("doc_id"), shards=7).collect()
    sizes = Counter()
    slots: dict = {}
    for r in out:
        sizes[r["shard"]] += len((r["text"] or "").encode()) + 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(texts) and set(sizes) == set(range(7))
    per = sum(sizes.values()) / 7
    assert all(abs(n - per) <= 0.04 * per + 250 for n in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_components(n, links):
    lab = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(lab[a], lab[b])
            if lab[a] != m or lab[b] != m:
                lab[a] = lab[b] = m
                changed = True
    return lab


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(40)] + [(60, x) for x in range(61, 90)] + [tuple(map(int, rng.integers(90, 140, 2))) for _ in range(40)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    lab = brute_components(140, links)
    assert all(got.get(i, i) == lab[i] for i in range(140))


def test_near_duplicates(spark):
    base = word_list(120, 1)
    texts = [" ".join(base)]
    rng = np.random.default_rng(6)
    for k in range(80):
        ws = list(base)
        for i in rng.integers(0, 120, k % 12):
            ws[i] = "x%d" % rng.integers(0, 40)
        texts.append(" ".join(ws))
    texts += [" ".join(base).upper(), None, "", "  ", "a b", "A  B", "a b c d e", "a b c d f"] + [" ".join(word_list(60, s)) for s in range(30, 50)]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in near_duplicates(d.unionByName(d.where("doc_id = 3"))).collect()}
    sets = [set(shingles(t).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    lab = brute_components(len(texts), links)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), lab[i], lab[i] == i), i


def test_substring_dedup(spark):
    a, b, c = word_list(200, 7), word_list(150, 8), word_list(90, 9)
    texts = [" ".join(a), " ".join(b[:30] + a[20:140] + b[30:]), " ".join(c[:45]), " ".join(b[100:] + c[:45] + a[:60]), None, "", " ".join(a), "x " * 300, "x " * 120, " ".join(a[:49]), " ".join(a[:50]), " ".join(b[30:80] + a[90:140])]
    out = {r["doc_id"]: r for r in substring_dedup(docs(spark, texts)).collect()}
    ws = [(t or "").split() for t in texts]
    first: dict = {}
    for i, w in enumerate(ws):
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, w in enumerate(ws):
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["text"]) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), i


def test_window_hashes():
    h = wordhash.word_hashes([b"a", b"b", b"a", b"b", b"c", b"a", b"b"])
    w = wordhash.windows(h, 2)
    assert w[0] == w[2] == w[5] and len(set(w.tolist())) == 4
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and Phase(0, 1, [0], [5]).rest == 0
