"""Substring dedup by relative Lempel-Ziv parsing against everything that stands in earlier documents.

The reference of a document is all documents with smaller ids. Its index maps the fingerprint of each run of
``window`` words to the place (document and position) where it stands first, in blocks by hash, which together cover every
document. Only runs that can repeat are indexed: each run is known by its anchor, the run of
``ANCHOR`` words in it with the least hash, and equal runs have equal anchors, so runs whose anchor
stands in one document only need no look-up. A document is parsed greedily from left to right: a
factor begins where a run is found in any block and grows word by word as long as the next run is found
at the next place of the same reference document; runs across the boundary of two factors are looked up like all others.
Every factor is then confirmed: the words of the reference between the factor's boundaries are read
again and must be the document's own. Words under factors, which are ``window`` words at least, are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import wordhash
from gleanery.llm.common import BROADCAST_ROWS, dropped, placed, written

WINDOW, ANCHOR = 50, 30
#: Factors in all, of about 80 bytes each, up to which they are broadcast.
BROADCAST_FACTORS = 100_000
#: Positions of a document that one task parses at a time; a factor that goes on is another one from there.
STRETCH = 1 << 14


def anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each run of ``window`` words the hash of its anchor."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    grams = wordhash.windows(hashes, anchor, wordhash.BASES[1])
    return np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).min(axis=1).view(np.int64)


def parsed(position: np.ndarray, reference: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The factors (start, length, reference, position in it) of found runs, given in order of position."""
    if not len(position):
        return []
    new = np.flatnonzero((np.diff(position) != 1) | (np.diff(reference) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(position)]]) - 1
    return list(zip(position[first].tolist(), (position[last] - position[first] + window).tolist(), reference[first].tolist(), at[first].tolist()))


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _fields(*named: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in named])


_LONG, _LONGS = T.LongType(), T.ArrayType(T.LongType())
_PARSED = _fields(("id", _LONG), ("start", _LONG), ("length", _LONG), ("reference", _LONG), ("at", _LONG))
_FACTOR = T.ArrayType(_fields(("start", _LONG), ("length", _LONG), ("reference", _LONG), ("at", _LONG)))
_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "reference", "at")]))


def repeated_factors(
    docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``factors``: for each document that has any, its factors (start, length, reference, at, digest), in words.

    ``at`` is the factor's place in the reference, ``digest`` that of the reference's words there. Ids are integers and name documents: rows of one id never refer to each other. A null id neither
    refers nor is referred to; texts without ``window`` words have no factors. Texts that are equal
    word by word to one with a smaller id are one factor and take no further part. Among equal runs
    the one with the least (id, position) is referred to, so ties do not depend on the order of rows.
    """
    anchor = max(1, min(ANCHOR, window - 1)) if window > 1 else 1
    bare = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null")
    head = _fields(("id", _LONG), ("n", _LONG), ("of", T.BinaryType()), ("anchors", _LONGS))

    def read(batches):
        for b in batches:
            n, of, found = [], [], []
            for t in b.column(1):
                ws = wordhash.split(t.as_py(), lower=False)
                n.append(len(ws))
                of.append(digest(ws) if len(ws) >= window else None)
                found.append(np.unique(anchors(wordhash.word_hashes(ws), window, anchor)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=head.names
            )
        wordhash.forget()

    index = written(bare.mapInArrow(read, head), "anchors")
    same = index.where("of is not null").groupBy("of").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = written(index.join(same, "of").where("id > first").select("id", "n", "first", "of"), "copies")
    gone = copies.select("id").distinct()
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = index.where("of is not null").join(F.broadcast(gone) if few else gone, "id", "left_anti")
    placed = kept.select("id", F.explode("anchors").alias("a"))
    # What is joined by a hash is written first: then no aggregate stands between exchange and join, and
    # adaptive execution can split a hot hash.
    shared = written(placed.groupBy("a").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a"), "shared")
    marks = written(placed.join(shared, "a").groupBy("id").agg(F.collect_set("a").alias("shared")), "marks")
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ids = marks.select("id")
    read_again = bare.join(F.broadcast(ids) if few else ids, "id", "left_semi").join(marks, "id")
    runs = _fields(("id", _LONG), ("position", _LONG), ("print", _LONG))

    def indexed(batches):
        for b in batches:
            for i, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                h = wordhash.word_hashes(wordhash.split(t.as_py(), lower=False))
                at = np.flatnonzero(np.isin(anchors(h, window, anchor), np.asarray(s.values)))
                prints = wordhash.windows(h, window)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int64()), pa.array(at), pa.array(prints)], names=runs.names)
        wordhash.forget()

    looked = written(read_again.select("id", "text", "shared").mapInArrow(indexed, runs), "runs")
    firsts = looked.groupBy("print").agg(F.min(F.struct("id", "position")).alias("first"), F.max("id").alias("high")).where("first.id < high")
    block = written(firsts.select("print", F.col("first.id").alias("low"), F.col("first.position").alias("at")), "block")
    found = looked.join(block, "print").where("id > low").select("id", "position", "low", "at")
    # The number of partitions is left to the session, so that it follows the input.
    stretch = F.floor(F.col("position") / STRETCH)
    dealt = found.repartition("id", stretch).sortWithinPartitions("id", "position", "low", "at")

    def factored(batches):
        rest = None
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns]) if b.num_rows else np.zeros((4, 0), np.int64)
            x = x if rest is None else np.concatenate([rest, x], axis=1)
            cut = int(np.searchsorted(x[0], x[0][-1])) if x.shape[1] else 0
            rest = x[:, cut:]
            yield from _factors(x[:, :cut])
        if rest is not None:
            yield from _factors(rest)

    def _factors(x):
        x = x[:, np.concatenate([[True], np.any(np.diff(x[:2], axis=1) != 0, axis=0)])] if x.shape[1] else x
        edges = np.flatnonzero(np.diff(x[0])) + 1
        rows = [(int(g[0][0]), *f) for g in np.split(x, edges, axis=1) if g.shape[1] for f in parsed(*g[1:], window)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_PARSED.names)

    factors = written(dealt.mapInArrow(factored, _PARSED), "parsed")
    for old in (index, shared, marks, looked, block):
        dropped(old)
    whole = copies.groupBy("id").agg(F.max_by("n", "of").alias("length"), F.min("first").alias("reference"), F.max("of").alias("digest"))
    whole = whole.select("id", F.lit(0).cast("long").alias("start"), "length", "reference", F.lit(0).cast("long").alias("at"), "digest")
    again = _read_again(factors, bare)
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sure = factors.join(F.broadcast(again) if few else again, ["reference", "at", "length"]).select(whole.columns).unionByName(whole)
    packed = sure.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "reference", "at", "digest"))).alias("factors"))
    return written(packed, "factors")


def _read_again(factors: DataFrame, bare: DataFrame) -> DataFrame:
    """``reference``, ``at``, ``length``, ``digest`` of the words that factors refer to, each span read once."""
    spans = factors.select("reference", "at", "length").distinct()
    wanted = written(spans.groupBy("reference").agg(F.collect_list(F.struct("at", "length")).alias("spans")), "spans")
    out = _fields(("reference", _LONG), ("at", _LONG), ("length", _LONG), ("digest", T.BinaryType()))

    def read(batches):
        for b in batches:
            for i, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                ws = wordhash.split(t.as_py(), lower=False)
                x = spans.values
                at, n = (x.field(k).to_pylist() for k in (0, 1))
                made = [digest(ws[a : a + k]) for a, k in zip(at, n)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(n), pa.array(made, pa.binary())], names=out.names)

    few = wanted.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0] <= BROADCAST_FACTORS
    texts = bare.join(F.broadcast(wanted) if few else wanted, F.col("id") == F.col("reference")).select("reference", "text", "spans")
    # rows that repeat an id may differ in their words: a factor that fits any of them is told by its digest
    return written(texts.mapInArrow(read, out).distinct(), "digests")


def substring_dedup(
    docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """``columns`` of ``docs`` (all but the text by default), then ``text_col`` with the words under
    factors removed and the others joined by one space, ``n_words``, ``n_removed`` and ``factors``.

    Null and empty texts have no words and come back empty. A factor is removed only from rows whose
    own words are those of the reference, so rows that repeat an id may differ in their texts. Texts
    may be of any length. An empty table gives none; columns with the added names are replaced, all others
    pass through whatever their names.
    """
    added = ["n_words", "n_removed", "factors"]
    names = [c for c in columns or docs.columns if c not in (*added, text_col)]
    factors = repeated_factors(docs, window=window, id_col=id_col, text_col=text_col)
    few = factors.agg(F.coalesce(F.sum(F.size("factors")), F.lit(0))).first()[0] <= BROADCAST_FACTORS
    side = F.broadcast(factors) if few else factors
    there, back = placed(docs, names)
    mine = docs.select(*there, F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    joined = mine.join(side.select(F.col("id").alias("of"), "factors"), F.col("key") == F.col("of"), "left").drop("key", "of")
    schema = T.StructType(
        joined.schema.fields[:-2] + [T.StructField("text", T.StringType()), *_fields(("n_words", _LONG), ("n_removed", _LONG), ("factors", _FACTOR))]
    )

    def removed(batches):
        for b in batches:
            texts, n, gone, used = [], [], [], []
            for t, fs in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1)):
                ws = wordhash.split(t.as_py(), lower=False)
                left, true = np.ones(len(ws), bool), []
                for f in fs.as_py() or []:
                    span = slice(f["start"], f["start"] + f["length"])
                    if span.stop <= len(ws) and digest(ws[span]) == f.pop("digest"):
                        left[span] = False
                        true.append(f)
                used.append(true)
                texts.append(b" ".join(w for w, k in zip(ws, left.tolist()) if k).decode("utf-8", "surrogatepass"))
                n.append(len(ws))
                gone.append(len(ws) - int(left.sum()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(used, _ARROW)], names=schema.names
            )

    return joined.mapInArrow(removed, schema).select(*back, F.col("text").alias(text_col), *added)
