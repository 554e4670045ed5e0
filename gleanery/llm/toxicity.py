"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Grams of words mark toxic text, if among the training documents, or among those of a group alike (as
of one language), they stand in toxic ones far likelier than in ordinary ones. The toxic dictionary
has the spans of toxic text made of them. The ordinary one has as many bytes of words of ordinary
text, those with a mark first, then the others, the most frequent ones first in both, so what stands in ordinary text too
saves nothing; both share a lead of ordinary text. A text's words without a mark are equally far from both and left out, the others cut into
windows at blanks; what the toxic dictionary saves in those, summed up per document, is calibrated
to a score on training rows that the dictionaries have not seen.
"""

from __future__ import annotations

import heapq
import math
import pickle
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import apart, placed

#: Bytes of a window, of the shared lead, of the spans, and of the shortest grams.
WINDOW, LEAD, SPANS, GRAM = 96, 80, 4_096, 5
#: A gram marks toxic text if it stands in this share of the toxic training documents, in so many of
#: them at least, and so many times likelier there than in ordinary ones.
LEAST_SHARE, LEAST_DOCS, LEAST_ODDS = 0.02, 3, 15
#: A word that is so many times likelier in toxic documents, and no more, belongs to ordinary text.
ORDINARY_ODDS = 4
#: Bound on the expected number of grams that pass by chance, for those longer than ``GRAM`` or of a group.
MOST_CHANCE = 1e-4
#: Places of a document's profile, and documents of each class that a group has at least.
PROFILE, LEAST_GROUP = 1_024, 20
#: Bounds of the training sample: labelled rows of each class, and characters of them all. Rows count
#: whole; only the fit is bounded, every whole text is scored.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 1_500, 4_500, 32_000_000
#: Weight of a toxic row in the calibration.
TOXIC_WEIGHT = 2.0
#: Words that a Python worker remembers as marked or not.
REMEMBERED = 200_000

_WINDOWS = re.compile(rb"\S.{0,%d}\S(?!\S)|\S+" % (WINDOW - 2), re.S)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    marks: frozenset[bytes]
    lead: bytes


def windows(text: str) -> list[bytes]:
    return _WINDOWS.findall(text.lower().encode("utf-8", "replace"))


def _compressor(content: bytes):
    import zstandard as zs

    params = zs.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_dict_id=0, window_log=15, min_match=4, strategy=zs.STRATEGY_LAZY2,
        hash_log=13, chain_log=13, search_log=3,
    )
    data = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=data, compression_params=params).compress


class Scorer:
    def __init__(self, model: Model) -> None:
        self.ordinary, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)
        self.weights, self.lead, self.marks = np.array(model.weights), model.lead + b" ", model.marks
        self.heads = frozenset(g[:GRAM] for g in model.marks)
        self.sizes = sorted({len(g) for g in model.marks})
        self.known: dict[bytes, bool] = {}

    def marked(self, word: bytes) -> bool:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            w = b" " + word + b" "
            at = (i for i in range(len(w) - GRAM + 1) if w[i : i + GRAM] in self.heads)
            known = self.known[word] = any(w[i : i + n] in self.marks for i in at for n in self.sizes)
        return known

    def features(self, text: str | None) -> np.ndarray:
        """1, then of the bytes saved: two measures of their mean over all windows of the text and of their sum; the number of windows."""
        ws = windows(text or "")
        held = b" ".join(x for w in ws for x in w.split() if self.marked(x))
        saved = sum(max(0, len(self.ordinary(x)) - len(self.toxic(x))) for x in (self.lead + w + b" " for w in _WINDOWS.findall(held)))
        n = max(1, len(ws))
        return np.array([1.0, math.log1p(10 * saved / n), math.log1p(saved), math.sqrt(saved / n), math.log1p(n)])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _profiles(flat: list[bytes]) -> np.ndarray:
    """A unit vector for each document: roots of the counts of its pairs of bytes, folded to ``PROFILE`` places."""
    out = np.zeros((len(flat), PROFILE), np.float32)
    for row, d in zip(out, flat):
        b = np.frombuffer(d, np.uint8).astype(np.int64)
        row += np.sqrt(np.bincount((b[:-1] * 256 + b[1:]) * 40_503 % 65_521 % PROFILE, minlength=PROFILE))
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def _groups(flat: list[bytes], toxic: np.ndarray) -> list[np.ndarray]:
    """All documents, then ever finer halves of them by likeness of their profiles, which tells languages apart.
    Halves with fewer than ``LEAST_GROUP`` documents of a class are not split off."""
    profiles, out, todo = _profiles(flat), [], [np.arange(len(flat))]
    while todo:
        rows = todo.pop(0)
        out.append(rows)
        p = profiles[rows]
        far = p[np.argmin(p @ p.mean(axis=0))]
        ends = np.stack([far, p[np.argmin(p @ far)]])
        side = None
        for _ in range(30):
            now = np.argmax(p @ ends.T, axis=1)
            if side is not None and (now == side).all() or not 0 < now.sum() < len(now):
                break
            side = now
            ends = np.stack([p[side == k].mean(axis=0) for k in (0, 1)])
            ends /= np.sqrt((ends * ends).sum(axis=1, keepdims=True))
        if side is None:
            continue
        halves = [rows[side == k] for k in (0, 1)]
        if all(min(toxic[h].sum(), (~toxic[h]).sum()) >= LEAST_GROUP for h in halves):
            todo += halves
    return out


def _marks_of(toxic: list[set[bytes]], ordinary: list[set[bytes]], others: list[set[bytes]]) -> dict[bytes, float]:
    """Marking grams of documents given as sets of words: of 5 bytes and more, up to whole words. A gram
    that marks is not made longer; one that does not is, as long as enough toxic documents have it. What
    is common in ``others``, the ordinary documents outside the group, marks nothing."""
    least = max(LEAST_DOCS, LEAST_SHARE * len(toxic))
    at, elsewhere, outside = defaultdict(list), defaultdict(list), defaultdict(list)
    for held, docs in ((at, toxic), (elsewhere, ordinary), (outside, others)):
        for k, ws in enumerate(docs):
            for w in ws:
                held[w].append(k)
    found: dict[bytes, float] = {}
    size, alive = GRAM, None
    while alive is None or alive:
        seen = defaultdict(set)
        for w, ks in at.items():
            for g in {w[i : i + size] for i in range(len(w) - size + 1)}:
                if alive is None or g[1:] in alive and g[:-1] in alive:
                    seen[g].update(ks)
        seen = {g: len(ks) for g, ks in seen.items() if len(ks) >= least}
        other, far = defaultdict(set), defaultdict(set)
        for held, docs in ((elsewhere, other), (outside, far)):
            for w, ks in held.items():
                for i in range(len(w) - size + 1):
                    if (g := w[i : i + size]) in seen:
                        docs[g].update(ks)
        alive = set()
        for g, n in seen.items():
            m = len(other.get(g, ()))
            odds = (n / len(toxic)) / max((m + 0.5) / len(ordinary), len(far.get(g, ())) / max(1, len(others)))
            if odds >= LEAST_ODDS and (not others and size == GRAM or _chance(n, m, len(toxic), len(ordinary)) * len(seen) < MOST_CHANCE):
                found[g] = math.log(odds)
            else:
                alive.add(g)
        size += 1
    return found


def _chance(n: int, m: int, toxic: int, ordinary: int) -> float:
    """Bound on the chance that n toxic documents and m ordinary ones have a gram which marks neither."""
    p, share = n / (n + m), toxic / (toxic + ordinary)
    if p <= share:
        return 1.0
    apart = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if m else 0.0)
    return math.exp(-(n + m) * apart)


def _copy_key(flat: bytes) -> int:
    """Equal for most near copies: the least checksum of three words in a row."""
    ws = flat.split()
    return min((zlib.crc32(b" ".join(ws[i : i + 3])) for i in range(max(1, len(ws) - 2))))


def _marking(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """Grams that mark toxic documents among all or among those of a group, with the logarithm of their
    odds. Near copies of one class count as one document."""
    flat, is_toxic = [*toxic, *ordinary], np.arange(len(toxic) + len(ordinary)) < len(toxic)
    once: dict[bytes, bytes] = {}  # a word of many documents is held once
    words = [{once.setdefault(w, w) for w in (b" " + x + b" " for x in d.split())} for d in flat]
    keys = [_copy_key(d) for d in flat]
    once.clear()
    out: dict[bytes, float] = {}
    for rows in _groups(flat, is_toxic):
        inside, parts = set(rows.tolist()), [defaultdict(set) for _ in range(3)]
        for i in range(len(flat)):
            if i in inside or not is_toxic[i]:
                parts[0 if is_toxic[i] else 1 if i in inside else 2][keys[i]] |= words[i]
        for g, worth in _marks_of(*[list(p.values()) for p in parts]).items():
            out[g] = max(out.get(g, 0.0), worth)
    return out


def _spans(toxic: list[bytes], marking: dict[bytes, float]) -> bytes:
    """Runs of marking grams inside words, those first that cover most words not yet covered."""
    sizes = sorted({len(g) for g in marking})
    at = defaultdict(list)
    for k, t in enumerate(toxic):
        for w in set(t.split()):
            at[b" " + w + b" "].append(k)
    runs: dict[bytes, float] = {}
    for word in at:
        joined: list[tuple[int, int, float]] = []
        for i, e in sorted((i, i + n) for n in sizes for i in range(len(word) - n + 1) if word[i : i + n] in marking):
            start, end, worth = joined.pop() if joined and i < joined[-1][1] else (i, e, 0.0)
            joined.append((start, max(end, e), max(worth, marking[word[i:e]])))
        for start, end, worth in joined:
            runs[word[start:end]] = max(worth, runs.get(word[start:end], 0.0))
    lengths, hits = sorted({len(r) for r in runs}), defaultdict(set)
    for j, (word, ks) in enumerate(at.items()):
        for n in lengths:
            for i in range(len(word) - n + 1):
                if word[i : i + n] in runs:
                    hits[word[i : i + n]].update((k, j) for k in ks)
    covered: set[tuple[int, int]] = set()
    out, size = [], 0
    worth = lambda r: len(hits[r] - covered) * runs[r] * len(r) / (len(r) + 4)
    heap = sorted((-worth(r), r) for r in runs)
    while heap and size < SPANS:
        _, run = heapq.heappop(heap)
        now = worth(run)
        if heap and now < -heap[0][0]:
            if now > 0:
                heapq.heappush(heap, (-now, run))
        elif now > 0:
            out.append(run)
            size += len(run)
            covered |= hits[run]
    return b"".join(reversed(out))


def _shares(docs: list[bytes]) -> dict[bytes, float]:
    n: dict[bytes, int] = defaultdict(int)
    for d in docs:
        for w in set(d.split()):
            n[w] += 1
    return {w: k / len(docs) for w, k in n.items() if k >= LEAST_DOCS}


def _words(ordinary: list[bytes], toxic: list[bytes], marks: frozenset[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Words of ``LEAST_DOCS`` ordinary documents or more, those with a mark and the others, from those of most
    documents on. Words that are far likelier in toxic documents are left to the toxic dictionary."""
    here, there = _shares(ordinary), _shares(toxic)
    out: tuple[list[bytes], list[bytes]] = ([], [])
    sizes = sorted({len(g) for g in marks})
    for w in sorted((w for w in here if ORDINARY_ODDS * here[w] >= there.get(w, 0.0)), key=lambda w: (-here[w], w)):
        at = b" " + w + b" "
        has = any(at[i : i + k] in marks for k in sizes for i in range(len(at) - k + 1))
        out[0 if has else 1].append(w)
    return out


def _ordinary(words: tuple[list[bytes], list[bytes]], size: int) -> bytes:
    """So many bytes of those words; the most frequent ones stand last, where they are cheapest."""
    held, left = [], size
    for w in (*words[0], *words[1]):
        if left <= len(w):
            break
        held.append(w)
        left -= len(w) + 1
    return b" ".join(reversed(held)).rjust(size, b"\x00")[:size] if size else b""


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """A model of (text, label) rows, or None where one class is missing. Two of three rows train the
    dictionaries, the third calibrates. The order of the rows does not matter."""
    rows = sorted((t or "", y) for t, y in rows)
    third = [zlib.crc32(t.encode("utf-8", "replace")) % 3 == 0 for t, _ in rows]
    flat = [(b" ".join(windows(t)), y) for t, y in rows]
    toxic = [d for (d, y), c in zip(flat, third) if y and not c]
    ordinary = [d for (d, y), c in zip(flat, third) if not y and not c]
    tests = [(t, y) for (t, y), c in zip(rows, third) if c]
    if not toxic or not ordinary or len({y for _, y in tests}) < 2:
        return None
    marking = _marking(toxic, ordinary)
    spans, marks = _spans(toxic, marking), frozenset(marking)
    words = _words(ordinary, toxic, marks)
    lead = (b" ".join(words[1])[:LEAD]).rjust(LEAD, b" ")
    fill = _ordinary(words, len(spans))
    draft = Scorer(Model(spans + lead, fill + lead, (), marks, lead))
    x = np.array([draft.features(t) for t, _ in tests])
    y = np.array([y for _, y in tests], dtype=float)
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (weight * (y - p)) - 0.1 * w)
    return Model(spans + lead, fill + lead, tuple(float(v) for v in w), marks, lead)


def held_out(ident: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.encode(ident.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic") -> Model | None:
    """Fit on the labelled rows of ``docs`` that are not held out: of each class those whose ids have
    the least hashes, as long as rows and characters are within the bounds above; a row whose text alone exceeds
    them is passed over. Labels of one id are one, the larger; null ones count for nothing. Of rows that repeat an id
    the one whose text has the least hash is taken, so neither repeated rows nor ties change the
    model. Null and empty texts train as empty ones. None where a class is missing, as in empty tables."""
    marks = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(F.col(f"`{label_col}`")).alias("_y"))
    marks = marks.where(~held_out(F.col("_id")))
    bound = [(1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)]
    picked = [marks.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in bound]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # as many rows as the bounds allow at most
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t")).join(chosen, "_id")
    sizes = texts.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.char_length("_t").alias("n"))).alias("r"))
    left, ids = {1: TRAIN_CHARS // 4, 0: TRAIN_CHARS - TRAIN_CHARS // 4}, []
    for r in sizes.select("_id", "_y", "r.h", "r.n").orderBy(F.xxhash64("_id"), "_id").collect():
        if r["n"] <= left[int(r["_y"] > 0)]:
            left[int(r["_y"] > 0)] -= r["n"]
            ids.append((r["_id"], r["h"]))
    kept = docs.sparkSession.createDataFrame(ids, T.StructType([docs.schema[id_col], T.StructField("h", T.LongType())])).toDF("_id", "h")
    one = texts.join(F.broadcast(kept), "_id").where(F.xxhash64("_t") == F.col("h")).dropDuplicates(["_id"])


    def fitted(batches):
        rows = [(t, int(y)) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(apart(fit, rows))], pa.binary())], names=["model"])

    # the sample is as large as its bounds at most, so one task can fit; the driver sees the model alone
    made = one.select("_t", F.col("_y").cast("int").alias("_y")).repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def toxicity(docs: DataFrame, model: Model | None, *, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) plus ``toxicity`` double (0 to 1) and ``toxic`` int (1 from
    0.5 on), a row for each row, repeated ones too. Texts are scored whole, whatever their length; null and empty ones save no
    bytes and score as the calibration has it for none. Without a model every score is 0. Columns named so
    are replaced, all others pass through whatever their names; an empty table gives none."""
    names = [c for c in columns or docs.columns if c not in ("toxicity", "toxic")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0.0).alias("toxicity"), F.lit(0).alias("toxic"))
    there, back = placed(docs, names)
    rows = docs.select(*there, F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.IntegerType())])

    def scored(batches):
        scorer = Scorer(model)
        for b in batches:
            text = b.column(b.num_columns - 1)
            s = [scorer.score(text[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=schema.names)

    return rows.mapInArrow(scored, schema).select(*back, "toxicity", "toxic")
