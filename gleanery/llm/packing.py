"""Mixture-controlled packing: deficit round-robin over source queues fills fixed windows.

Every source is a queue of tokens (a document's ids, then an end id). In each window a queue is due
its share of the window; what is due but less than a quantum is carried on as its deficit, and the
largest queue takes the rest of the window. As the deficits after window w follow from w alone, any
partition can place its tokens without knowing the windows before: only token counts by partition
and source are gathered, and neither texts nor ids are shuffled. More sources than ``QUEUES`` form a
tree: the last queue is filled by a round-robin of its own, in windows of its own, and so on.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import BROADCAST_ROWS, written

LENGTH, END = 4096, 2
#: Queues of a round-robin. 64 is the most for which the largest queue of any mixture has a token for
#: every other one's deficit.
QUEUES = 64
#: Queues and tokens of a window in the round-robins that fill the last queue; few, so that the sources take turns soon.
FEW, SHORT = 8, 64
#: Words that a Python worker remembers with their ids, in two generations, and characters of the longest such word.
REMEMBERED, LONGEST = 400_000, 64

#: The pre-tokenizer's pattern in the tokenizer file (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Controls that ``str.split`` takes for blanks and the pattern does not.
_NO_BLANKS = re.compile("[\x1c-\x1f]")

_loaded: dict[str, Encoder] = {}


class Encoder(dict):
    """A text's ids as little-endian unsigned 32-bit bytes. Words between blanks are looked up here by their own text.

    The tokenizer normalises, splits at the pattern, no piece of which holds a blank, and merges inside
    pieces, so a word's ids do not depend on its neighbours; only texts with the string of a special
    token go through it whole. When a generation of words is full it becomes the old one, from which
    words that are met again come back, so frequent words stay.
    """

    def __init__(self, spec: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        self.pieces = regex.compile(PIECES).findall
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if word[-1] in ",." and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        if (out := self.old.pop(word, None)) is None:
            out = self.of_pieces(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def of_pieces(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(text):
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            if not shown.isprintable() or " " in shown:
                shown = piece.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # lower() makes a last sigma another letter; the tokenizer lower-cases each character by itself
            text = text.replace("Σ", "σ")
        text = text.lower()
        if _NO_BLANKS.search(text):
            return self.of_pieces(text)
        return b"".join(map(self.__getitem__, text.split()))

    def forget(self) -> None:
        """Give the memory back at the end of a task; Python workers outlive their stages."""
        self.old = {}
        self.clear()


def encoder(spec: str) -> Encoder:
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Encoder(spec)
    return _loaded[key]


@dataclass
class Phase:
    """Windows ``first`` to ``first + windows - 1``, in which queue q gives its tokens ``starts[q]`` to
    ``starts[q] + tokens[q] - 1`` evenly. ``rest`` is the queue that takes what the others leave."""

    first: int
    windows: int
    starts: list[int]
    tokens: list[int]
    length: int = LENGTH

    def __post_init__(self) -> None:
        self.rest = max(range(len(self.tokens)), key=lambda q: (self.tokens[q], -q))
        others = sum(1 for t in self.tokens if t) - 1
        self.quantum = max(1, self.tokens[self.rest] // (self.windows * others)) if others > 0 else 1
        self.order = [q for q, t in enumerate(self.tokens) if t and q != self.rest] + [self.rest]

    def given(self, q: int, w: np.ndarray) -> np.ndarray:
        """Tokens that queue q has given before window w of the phase."""
        if q == self.rest:
            return self.total(w) - sum((self.given(o, w) for o in self.order[:-1]), w * 0)
        n, g = self.tokens[q], self.quantum
        return np.where(w >= self.windows, n, w * n // (self.windows * g) * g)

    def total(self, w: np.ndarray) -> np.ndarray:
        return np.where(w >= self.windows, sum(self.tokens), w * self.length)

    def window(self, q: int, at: np.ndarray) -> np.ndarray:
        """The window that token ``at`` of queue q is in."""
        if q != self.rest:
            g = self.quantum
            need = (at + g) // g
            return np.minimum(-(-need * self.windows * g // self.tokens[q]), self.windows) - 1
        low, high = at * 0, at * 0 + self.windows - 1
        for _ in range(self.windows.bit_length()):
            mid = (low + high) // 2
            later = self.given(q, mid + 1) <= at
            low, high = np.where(later, np.minimum(mid + 1, high), low), np.where(later, high, mid)
        return low

    def before(self, q: int, w: np.ndarray) -> np.ndarray:
        """Where the tokens of queue q begin in window w."""
        out = w * 0
        for o in self.order[: self.order.index(q)]:
            out = out + self.given(o, w + 1) - self.given(o, w)
        return out


def phases(totals: list[int], weights: list[float] | None = None, length: int = LENGTH) -> list[Phase]:
    """All tokens of the queues in windows, in the proportions ``weights`` (default: those of the totals)
    as long as every queue lasts; then in those of the queues that are left."""
    left, starts, out, first = list(totals), [0] * len(totals), [], 0
    share = [int(w * 1_000_000) for w in weights] if weights else list(totals)
    share = [max(1, s) if t else 0 for s, t in zip(share, totals)]
    while total := sum(left):
        live = sum(s for s, n in zip(share, left) if n)
        windows = min(n * live // (length * s) for s, n in zip(share, left) if n)
        if windows:
            give = [length * windows * s // live if n else 0 for s, n in zip(share, left)]
            short = length * windows - sum(give)
        else:  # the next window empties a queue: what it lacks is taken from the others
            windows, want = 1, min(length, total)
            give = [min(n, length * s // live) if n else 0 for s, n in zip(share, left)]
            short = want - sum(give)
        for q in sorted(range(len(left)), key=lambda q: (give[q] - left[q], q)):
            more = min(short, left[q] - give[q])
            give[q], short = give[q] + more, short - more
        out.append(Phase(first, windows, list(starts), give, length))
        first += windows
        starts = [a + g for a, g in zip(starts, give)]
        left = [n - g for n, g in zip(left, give)]
    return out


def pieces(plan: list[Phase], queue: np.ndarray, start: np.ndarray, size: np.ndarray):
    """For documents at ``start`` of their queues: row, start in the document, length, window, offset."""
    out = []
    big = start.dtype
    for p in plan:
        for q in set(queue.tolist()):
            if not p.tokens[q]:
                continue
            rows = np.flatnonzero(queue == q)
            low = np.maximum(start[rows], p.starts[q]) - p.starts[q]
            high = np.minimum(start[rows] + size[rows], p.starts[q] + p.tokens[q]) - p.starts[q]
            rows, low, high = (x[high > low] for x in (rows, low, high))
            if not len(rows):
                continue
            a, b = p.window(q, low), p.window(q, high - 1)
            n = (b - a + 1).astype(np.int64)
            each = np.repeat(np.arange(len(rows)), n)
            w = a[each] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(big)
            given = p.given(q, w)
            from_, to = np.maximum(low[each], given), np.minimum(high[each], p.given(q, w + 1))
            ok = to > from_
            each, w, given, from_, to = (x[ok] for x in (each, w, given, from_, to))
            r = rows[each]
            out.append((r, from_ + p.starts[q] - start[r], to - from_, w + p.first, p.before(q, w) + from_ - given))
    return [np.concatenate([np.asarray(o[i]).astype(np.int64) for o in out]) if out else np.zeros(0, np.int64) for i in range(5)]


@dataclass
class Tree:
    """Round-robins by number, the first of windows and the others each of a queue of an earlier one
    (``above``); ``leaves`` has the round-robin and queue of each source."""

    plans: list[list[Phase]]
    above: list[tuple[int, int] | None]
    leaves: list[tuple[int, int]]

    def pieces(self, node: np.ndarray, queue: np.ndarray, start: np.ndarray, size: np.ndarray):
        """As the function of this name, for documents at ``start`` of the queues of ``node``."""
        kind, ends = start.dtype, []
        rows = np.arange(len(node))
        todo = {k: [(rows[node == k], np.zeros((node == k).sum(), np.int64), queue[node == k], start[node == k], size[node == k])] for k in set(node.tolist())}
        while todo:
            k = max(todo)  # those below have larger numbers
            row, begin, q, at, n = (np.concatenate(x) for x in zip(*todo.pop(k)))
            i, a, n, w, offset = pieces(self.plans[k], q, at, n)
            row, begin = row[i], begin[i] + a
            if self.above[k] is None:
                ends.append((row, begin, n, w, offset))
            else:
                up, q = self.above[k]
                at = w.astype(kind) * SHORT + offset.astype(kind)
                todo.setdefault(up, []).append((row, begin, np.full(len(row), q), at, n.astype(kind)))
        return [np.concatenate(x) for x in zip(*ends)] if ends else [np.zeros(0, np.int64)] * 5


def tree(totals: list[int], weights: list[float] | None = None) -> Tree:
    """Of sources with these tokens: the first ``QUEUES`` - 1 have queues of their own, the others share
    the last one if there are more than one, at the sum of their weights."""
    out = Tree([], [], [(0, 0)] * len(totals))

    def add(low: int, high: int, above: tuple[int, int] | None) -> None:
        k = len(out.plans)
        if above is None:
            cuts = [*range(low, min(high, low + QUEUES - 1) + 1), *([high] if high - low >= QUEUES else [])]
        else:
            n = min(high - low, FEW)
            cuts = [low + (high - low) * q // n for q in range(n + 1)]
        parts = list(zip(cuts, cuts[1:]))
        out.plans.append(phases([sum(totals[a:e]) for a, e in parts], weights and [sum(weights[a:e]) for a, e in parts], LENGTH if above is None else SHORT))
        out.above.append(above)
        for q, (a, e) in enumerate(parts):
            if e - a == 1:
                out.leaves[a] = (k, q)
            else:
                add(a, e, (k, q))

    add(0, len(totals), None)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Pieces of documents: ``id_col``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file, read by the driver. Every id lies in exactly one
    piece; all sequences are full but the last. A null or empty text is its end id alone; a null
    source is a queue like any other; rows that repeat, even with one id, are packed each. An empty
    table gives no pieces. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    ident = docs.schema[id_col].dataType
    wide = T.StructType([
        T.StructField("id", ident), T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()),
        T.StructField("run", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def encoded(batches):
        from pyspark import TaskContext

        part, enc, runs = TaskContext.get().partitionId(), encoder(spec.value), {}
        end = struct.pack("<I", END)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                c = b.slice(at, 1_000)
                sources, texts = c.column(1).to_pylist(), c.column(2)
                ids, run, n = [], [], []
                for i, s in enumerate(sources):
                    x = enc.encode(texts[i].as_py()) + end
                    ids.append(x)
                    n.append(len(x) // 4)
                    run.append(runs.get(s, 0))
                    runs[s] = run[-1] + n[-1]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), pa.array([part] * len(n), pa.int32()), pa.array(run, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=wide.names,
                )
        enc.forget()

    source = F.col(f"`{source_col}`").cast("string")
    tokens = written(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(source, F.lit("\x00")).alias("source"), F.col(f"`{text_col}`").alias("text")).mapInArrow(encoded, wide),
        "tokens",
    )
    counts = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "counts")
    by_source = counts.groupBy("source").agg(F.sum("n").alias("n"))
    sources = [(r["source"], int(r["n"]), 0.0 if weights is None else float(weights.get(r["source"], 0.0))) for r in by_source.collect()]
    sources.sort(key=lambda x: (-x[2], -x[1], x[0]))
    totals = [n for _, n, _ in sources]
    plan = tree(totals, None if weights is None else [w for _, _, w in sources])
    leaves = spark.createDataFrame([(s, k, q) for (s, _, _), (k, q) in zip(sources, plan.leaves)], "source string, node int, queue int")
    queued = counts.join(F.broadcast(leaves) if len(sources) <= BROADCAST_ROWS else leaves, "source")
    order = "partition by source order by part rows between unbounded preceding and 1 preceding"
    starts = written(queued.select("source", "part", "node", "queue", F.expr(f"coalesce(sum(n) over ({order}), 0L)").alias("base")), "starts")
    small = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(starts) if small else starts, ["source", "part"])
    shared = spark.sparkContext.broadcast(plan)
    kind = np.int64 if sum(totals) < 1 << 31 else object  # products of two token counts must not overflow
    out = T.StructType([
        T.StructField(id_col, ident), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                node, queue, start, n = (c.column(i).to_numpy() for i in (1, 2, 3, 4))
                rows, begin, size, window, offset = shared.value.pieces(node, queue, start.astype(kind), n.astype(kind))
                ids = [memoryview(x.as_buffer()) for x in c.column(5)]
                cuts = [bytes(ids[r][4 * a : 4 * (a + k)]) for r, a, k in zip(rows.tolist(), begin.tolist(), size.tolist())]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).take(take), pa.array(begin), pa.array(size), pa.array(cuts, pa.binary()), c.column(4).take(take), pa.array(window), pa.array(offset)],
                    names=out.names,
                )

    return placed.select("id", "node", "queue", (F.col("base") + F.col("run")).alias("at"), "n", "ids").mapInArrow(cut, out)
