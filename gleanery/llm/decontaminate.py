"""Benchmark decontamination: Wu-Manber search of all windows of the benchmark in every document.

Words stand for characters. For each pattern length there is a shift table over blocks of two
words, which skips positions where no window can end, and buckets by the last block, whose
patterns are compared word by word. The pattern tables go to the executors in blocks of bounded
size. With one block documents are read once and nothing is shuffled; with more they are read once for each,
so that no worker ever holds two, and only what was found is put together.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import placed, written

#: Words of a window.
NGRAM = 10
#: Bytes of benchmark text in one block of pattern tables. More text means more blocks, each with a pass of its own,
#: not larger tables.
BLOCK_BYTES = 16 << 20

#: ASCII that is no word character is a blank, A-Z are lower-cased, bytes of other characters stay.
_FOLD = bytes(
    i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """All patterns of one length, as tuples of word numbers; ``size`` is the number of known words."""

    def __init__(self, patterns: dict[tuple[int, ...], set[str]], size: int) -> None:
        self.m = m = len(next(iter(patterns)))
        self.items, self.size = patterns, size
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for p in patterns:
            if m == 1:
                self.buckets[p[0]].append(p)
                continue
            for j in range(1, m):
                block = p[j - 1] * size + p[j]
                self.shift[block] = min(self.shift.get(block, m), m - 1 - j)
            self.buckets[p[-2] * size + p[-1]].append(p)

    def find(self, ids: list[int]):
        """(start, pattern) of every occurrence in ``ids``, where -1 is a word of no pattern."""
        m, size, buckets = self.m, self.size, self.buckets
        if m == 1:
            yield from ((i, (w,)) for i, w in enumerate(ids) if w in buckets)
            return
        shift, n, i = self.shift.get, len(ids), m - 1
        while i < n:
            last = ids[i]
            if last < 0:
                i += m
                continue
            block = ids[i - 1] * size + last if ids[i - 1] >= 0 else -1
            step = shift(block, m - 1)
            if step:
                i += step
                continue
            start = i - m + 1
            here = tuple(ids[start : i + 1])
            for p in buckets[block]:
                if p == here:
                    yield start, p
                    break
            i += 1


class Tables:
    def __init__(self, items: list[tuple[str, list[bytes]]], ngram: int) -> None:
        self.vocab: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, ws in items:
            ids = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in ws)
            m = min(ngram, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length[m][ids[i : i + m]].add(item)
        self.searches = [WuManber(dict(p), len(self.vocab)) for _, p in sorted(by_length.items())]

    def find(self, ws: list[bytes]):
        """(start, length, items) of every occurrence."""
        ids = list(map(self.vocab.get, ws, repeat(-1)))
        for s in self.searches:
            for start, p in s.find(ids):
                yield start, s.m, s.items[p]


def _blocks(benchmark: DataFrame, item: Column, text: Column, ngram: int):
    """Pattern tables of all items, block by block; items come to the driver one partition at a time."""
    part, size = [], 0
    for r in benchmark.select(item.cast("string").alias("i"), text.alias("t")).toLocalIterator():
        ws = words(r["t"])
        if not ws or r["i"] is None:
            continue
        part.append((r["i"], ws))
        size += len(r["t"])
        if size >= BLOCK_BYTES:
            yield Tables(part, ngram)
            part, size = [], 0
    if part:
        yield Tables(part, ngram)


_ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) spans as disjoint ones, in order; spans that meet become one."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b - a) for a, b in out]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    ngram: int = NGRAM,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` of ``docs`` (all by default) plus ``n_words``, ``hits`` and ``items``.

    ``hits`` are the disjoint spans of words inside an occurrence of any window of ``ngram`` item
    words (all words of a shorter item); ``items`` the ids, as strings in order, of the items with
    an occurring window. Null texts have no words; items without words or with a null id match
    nothing; items that repeat count once; documents that repeat are each a row; texts may be of any length; empty tables give no hits or no rows. Columns with these three names are
    replaced, all others pass through whatever their names.
    """
    names = [c for c in columns or docs.columns if c not in _ADDED.names]
    blocks = _blocks(benchmark, F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`"), ngram)
    first, second = next(blocks, None), next(blocks, None)
    there, back = placed(docs, names)
    text = F.col(f"`{text_col}`").alias("text")
    if second is None:
        return _pass(docs.select(*there, text), first).select(*back, *_ADDED.names)
    # a number for each row that stays the same in every pass, as it is written
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), *there, text), "rows")
    found = None
    for block in chain((first, second), blocks):
        part = written(_pass(rows.select("row", "text"), block).where(F.size("hits") > 0), "hits")
        found = part if found is None else found.unionByName(part)
    spans = F.udf(lambda many: merged([(h["start"], h["length"]) for hits in many for h in hits]), _ADDED["hits"].dataType)
    of = found.groupBy(F.col("row").alias("of")).agg(
        spans(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counted = _pass(rows, None).drop("hits", "items")
    none = [F.array().cast(_ADDED[c].dataType) for c in ("hits", "items")]
    return counted.join(of, F.col("row") == F.col("of"), "left").select(
        *back, "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items")
    )


def _pass(rows: DataFrame, block: Tables | None) -> DataFrame:
    """``rows`` with the three columns in place of the last one, which is searched for the patterns of one block."""
    names = rows.columns[:-1]
    tables = rows.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([rows.schema[c] for c in names] + list(_ADDED))

    def searched(batches):
        for b in batches:
            counts, spans, items = [], [], []
            text = b.column(b.num_columns - 1)
            for i in range(b.num_rows):
                ws = words(text[i].as_py())
                found, ids = [], set()
                for start, n, which in tables.value.find(ws) if tables.value else ():
                    found.append((start, n))
                    ids |= which
                counts.append(len(ws))
                spans.append([{"start": a, "length": n} for a, n in merged(found)])
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(v, t) for v, t in zip((counts, spans, items), _ARROW))], names=[*names, *_ADDED.names]
            )

    return rows.mapInArrow(searched, schema)
