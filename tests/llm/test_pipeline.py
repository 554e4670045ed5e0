"""The pipeline stage by stage against plain Python that shares no code with the operators."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["grumpelwort", "zakkenfoy", "dwimmerkus"]


def plain_words(rng, n):
    return ["".join(rng.choice(["on", "er", "ti", "sh", "bre", "lu", "ka", "mo"], 3)) for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sets_of(text):
    ws = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, and the rows of documents."""
    rng = np.random.default_rng(11)
    texts, toxic = [], {}
    for i in range(240):
        ws = plain_words(rng, 90)
        if i % 4 == 0:
            for j in rng.integers(0, 90, 6):
                ws[j] = str(rng.choice(INSULTS))
        toxic[i] = int(i % 4 == 0)
        texts.append(" ".join(ws))
    passage = " ".join(plain_words(rng, 30))
    texts[1] += " " + passage.upper()
    texts[2] += " " + " ".join(passage.split()[:9])
    for i in range(20, 36):
        texts[i] += "\n  Shared LINE of all\t"
    # copies at 0.9, about 0.82 and less of the shingles of 241
    base = plain_words(rng, 100)
    near = list(base)
    near[50] = "zz"
    edge = list(base)
    edge[20] = edge[70] = "yy"
    far = list(base)
    far[20] = far[45] = far[70] = "xx"
    texts += [" ".join(x) for x in (base, near, edge, far)]
    texts += [None, "", "  \n ", "one", " ".join(plain_words(rng, 20_000)), texts[3]]
    rows = [(i, t, "en", None if i % 7 == 0 else "s%d" % (i % 3), len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[5])
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(at + "/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()] + [(900, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    spark.createDataFrame([(7, passage), (8, None), (9, "")], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    return at, rows, toxic, passage


@pytest.fixture(scope="module")
def steps(spark, corpus):
    import corpus_pipeline as C
    from gleanery.shared import written

    docs, out = spark.read.parquet(corpus[0] + "/documents.parquet"), []
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, corpus[0]), "step")
        out.append(docs)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in out[:4])
    return [sorted(map(tuple, d.collect()), key=repr) for d in out]


def test_toxicity_stage(corpus, steps):
    _, rows, toxic, _ = corpus
    assert set(steps[0]) <= set(rows)
    kept = {r[0] for r in steps[0]}
    tests = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in tests if toxic[i]) <= 0.1 * sum(toxic[i] for i in tests)
    assert sum(i not in kept for i in toxic if not toxic[i]) <= 0.02 * len(toxic)
    assert {244, 245, 246, 247, 248} <= kept


def test_line_stage(steps):
    n = Counter()
    for r in steps[0]:
        n.update({k for x in lower(r[1]).split("\n") if (k := x.strip(" \t\n\v\f\r"))})
    want = []
    for i, t, lang, source, _ in steps[0]:
        left = "\n".join(x for x in (t or "").split("\n") if n[lower(x).strip(" \t\n\v\f\r")] < 10)
        want.append((i, left, lang, source, len(left)))
    assert steps[1] == sorted(want, key=repr) and any("Shared" in (r[1] or "") for r in steps[0]) and not any("Shared" in r[1] for r in steps[1])


def test_near_stage(steps):
    sets = {r[0]: sets_of(r[1]) for r in steps[1]}
    ids = sorted(sets)
    least = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert any(sets[a] != sets[b] for a, b in links)
    for _ in ids:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert steps[2] == [r for r in steps[1] if least[r[0]] == r[0]] and len(steps[2]) < len(steps[1])


def test_benchmark_stage(corpus, steps):
    item = corpus[3].split()
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    words = {r[0]: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r[1])) for r in steps[2]}
    hit = {i for i, ws in words.items() if any(tuple(ws[j : j + 10]) in windows for j in range(len(ws) - 9))}
    assert hit == {1} and steps[3] == [r for r in steps[2] if r[0] not in hit]


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in steps[3]:
        want[r[0]] += len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
    found, ends = Counter(), Counter()
    for doc, _, length, _, _, sequence, offset in sorted(steps[4], key=lambda r: r[5:7]):
        assert ends[sequence] == offset
        ends[sequence] += length
        found[doc] += length
    assert found == want and all(ends[k] == 4096 for k in range(len(ends) - 1))


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    at = str(tmp_path)
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    assert C.run(spark, at).count() == 0
