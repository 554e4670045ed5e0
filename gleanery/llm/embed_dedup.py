"""Embedding near-dedup by sorted projection passes.

Each pass orders all vectors lexicographically by concatenated random hashes (the largest of some
random projections and its sign; then signs of further ones). Neighbours in that order are compared:
all that agree in the leading hashes, so many that about ``WINDOW`` vectors are expected to, and
those within ``BORDER`` places on both sides of every boundary between such cells. Cells with more than ``WINDOW``
vectors are compared whole too, in tiles of bounded size, so no partner is cut off. The links of all passes are united.

What travels is a byte for each component with a bound of the rounding error: pairs that the bound
leaves open are looked up and decided in double precision. A pair that shared a cell in an
earlier pass counts there only, which the cells of both tell, so counts add up without a list of
pairs; only pairs across boundaries and open ones are listed. Equal vectors are one class with a weight.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import BROADCAST_ROWS, dropped, written
from gleanery.llm.links import components

COSINE = 0.9
#: Vectors expected in a cell at most, vectors of a tile's side, places of a window across a boundary,
#: cells that are ordered in one group, and the chance to miss a pair at the threshold.
WINDOW, TILE, BORDER, GROUP, MISS = 4_096, 2_048, 256, 8, 1e-3
#: Projections of one hash at most, and signs that order a cell.
MOST, FINE = 32, 20
SEED = 20_240_229


@functools.lru_cache(256)
def agree(k: int, cosine: float) -> float:
    """Chance that the largest of k projections and its sign agree for two vectors of this cosine, as drawn."""
    rng = np.random.default_rng([SEED, k])
    a = rng.standard_normal((1 << 15, k))
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * rng.standard_normal(a.shape)
    return float((_largest(a) == _largest(b)).mean())


@functools.lru_cache(4_096)
def passes(n: int, cosine: float = COSINE) -> tuple[int, int, int]:
    """Hashes that make a cell, projections of each, and passes, for n vectors."""
    if n <= WINDOW:
        return 0, 1, 1
    hashes = max(1, math.ceil(math.log(n / WINDOW) / math.log(2 * MOST)))
    k = max(1, math.ceil((n / WINDOW) ** (1 / hashes) / 2))
    meet = min(agree(k, cosine) ** hashes, 1 - 1e-9)
    return hashes, k, math.ceil(math.log(MISS) / math.log(1 - meet))


def _largest(projected: np.ndarray) -> np.ndarray:
    """The place of the largest projection by size, doubled, plus 1 where it is positive."""
    at = np.abs(projected).argmax(axis=-1)
    return 2 * at + (np.take_along_axis(projected, at[..., None], -1)[..., 0] > 0)


@functools.lru_cache(64)
def _planes(length: int, hashes: int, k: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, length, hashes, k, count]).standard_normal((length, count, hashes * k + FINE))


def _order(unit: np.ndarray, hashes: int, k: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector and pass the leading hashes and the further signs, as one number each."""
    cells, fine = (np.zeros((len(unit), count), np.int64) for _ in range(2))
    planes = _planes(unit.shape[1], hashes, k, count)
    for p in range(count):
        x = unit @ planes[:, p]
        fine[:, p] = (x[:, hashes * k :] >= 0) @ (1 << np.arange(FINE, dtype=np.int64))
        for h in range(hashes):
            cells[:, p] = cells[:, p] * 2 * k + _largest(x[:, h * k : (h + 1) * k])
    return cells, fine


def _unit(data: list[np.ndarray]) -> np.ndarray:
    x = np.stack(data)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, their scale, and a bound of the distance to the vector itself."""
    scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
    q = np.rint(unit / scale[:, None].astype(float)).clip(-127, 127).astype(np.int8)
    off = np.sqrt(((unit - q * scale[:, None].astype(float)) ** 2).sum(axis=1))
    return q, scale, (off * 1.001 + 1e-6).astype(np.float32)


class Rows:
    """Rounded vectors with ids, weights and the cells of all passes."""

    def __init__(self, ids, w, q, scale, off, cells) -> None:
        self.ids, self.w, self.off, self.cells = ids, w, off, cells
        self.x = q.astype(np.float32) * scale[:, None]

    def close(self, mine: slice, other: slice, cosine: float):
        """(i, j, sure) of pairs that may be linked: rows of ``mine`` with rows of ``other``."""
        for at in range(mine.start, mine.stop, 512):
            a, b = slice(at, min(at + 512, mine.stop)), other
            near = self.x[a] @ self.x[b].T
            # 1e-5 is more than single precision takes from a product of unit vectors
            most = float(self.off[a].max() + self.off[b].max()) * 1.5 + 1e-5
            i, j = np.nonzero(near >= cosine - most)
            if not len(i):
                continue
            value, i, j = near[i, j], i + a.start, j + b.start
            open_ = self.off[i] + self.off[j] + 3 * self.off[i] * self.off[j] + 1e-5
            keep = (i != j) & (value >= cosine - open_)
            yield i[keep], j[keep], (value - open_ >= cosine)[keep]


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "peer", "n")])


def similar_vectors(
    vectors: DataFrame, *, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id``, ``kept``: a row for each row of ``vectors``.

    Vectors are linked if their cosine, in double precision, is at least ``cosine``; vectors of
    different lengths never are, and there may be any number of lengths. Null or empty vectors, those of zeros only and those with null or
    non-finite components have no links. Ids are integers and should be unique: rows of one id
    have the links of all. A row with a null id is linked with nothing. Up to ``WINDOW`` different
    vectors of a length, every pair is compared; of more, a pair at the threshold is missed with a
    chance below ``MISS``. An empty table gives none; other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(good, F.transform(v, lambda x: x + 0.0)).alias("v"))
    classes = written(
        rows.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "vectors"
    )
    found = _compared(classes, cosine)
    open_ = written(found.where("n < 0").select(F.least("id", "peer").alias("a"), F.greatest("id", "peer").alias("b")).distinct(), "open")
    found = found.where("n > 0")
    if not open_.isEmpty():
        found = found.unionByName(_decided(open_, classes, cosine))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    at = components(found.where("id <> peer").select(F.col("id").alias("a"), F.col("peer").alias("b")))
    by_vector = classes.join(counts, "id", "left").join(at, "id", "left").where("w > 1 or n is not null").select(
        F.col("v").alias("of"), (F.coalesce("n", F.lit(0).cast("long")) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    # without an id a row is in no class
    out = rows.join(by_vector, (F.col("v") == F.col("of")) & F.col("id").isNotNull(), "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _decided(open_: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs that are linked, in both directions, as ``id``, ``peer``, ``n``."""
    ids = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    side = classes.join(ids, "id", "left_semi")
    a = side.select(F.col("id").alias("a"), F.col("v").alias("va"), F.col("w").alias("wa"))
    b = side.select(F.col("id").alias("b"), F.col("v").alias("vb"), F.col("w").alias("wb"))
    pairs = open_.join(a, "a").join(b, "b").select("a", "b", "va", "vb", "wa", "wb")

    def decided(batches):
        for x in batches:
            if not x.num_rows:
                continue
            u, v = ([np.asarray(r.values) for r in x.column(i)] for i in (2, 3))
            on = np.array([float(_unit([p])[0] @ _unit([q])[0]) >= cosine for p, q in zip(u, v)], bool)
            a, b, wa, wb = (x.column(i).to_numpy()[on] for i in (0, 1, 4, 5))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64)) for c in ((a, b), (b, a), (wb, wa))], names=_FOUND.names
            )

    return written(pairs.mapInArrow(decided, _FOUND), "decided")


def _compared(classes: DataFrame, cosine: float) -> DataFrame:
    """``id``, ``peer``, ``n``: in one cell or tile, n vectors linked with ``id`` and the least id reached
    by them; or with n = -1 a pair to be decided."""
    long, small = T.LongType(), T.IntegerType()
    key = [T.StructField("len", small), T.StructField("pass", small), T.StructField("cell", long)]
    wide = T.StructType(key + [
        T.StructField("fine", small), T.StructField("id", long), T.StructField("w", long), T.StructField("q", T.BinaryType()), T.StructField("cells", T.BinaryType()),
    ])
    lengths = written(classes.groupBy(F.size("v").alias("len")).agg(F.count(F.lit(1)).alias("of")), "lengths")
    few = lengths.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    data = classes.withColumn("len", F.size("v")).join(F.broadcast(lengths) if few else lengths, "len").select("len", "of", "id", "w", "v")

    def projected(batches, alone):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                length, of = (c.column(i).to_numpy() for i in (0, 1))
                vectors = [np.asarray(x.values) for x in c.column(4)]
                for n in np.unique(length):
                    rows = np.flatnonzero(length == n)
                    unit = _unit([vectors[i] for i in rows])
                    hashes, k, count = passes(int(of[rows[0]]), cosine)
                    cells, fine = _order(unit, hashes, k, count)
                    made = [pa.array(np.full(cells.size, n, np.int32)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(rows))), pa.array(cells.reshape(-1))]
                    if alone:
                        yield pa.RecordBatch.from_arrays(made, names=[f.name for f in key])
                        continue
                    q, scale, off = _rounded(unit)
                    q = [x.tobytes() + np.array([s, o], np.float32).tobytes() for x, s, o in zip(q, scale, off)]
                    own = [x.astype(np.int32).tobytes() for x in cells]  # enough for 2**43 vectors
                    each = pa.array(np.repeat(np.arange(len(rows)), count))
                    made += [pa.array(fine.reshape(-1).astype(np.int32))]
                    made += [x.take(pa.array(rows)).take(each) for x in c.columns[2:4]]
                    made += [pa.array(x, pa.binary()).take(each) for x in (q, own)]
                    yield pa.RecordBatch.from_arrays(made, names=wide.names)

    sizes = data.mapInArrow(lambda it: projected(it, True), T.StructType(key)).groupBy("len", "pass", "cell").count()
    large = written(sizes.where(F.col("count") > WINDOW).select("len", "pass", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("chunks")), "cells")
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    dealt = data.mapInArrow(lambda it: projected(it, False), wide).join(F.broadcast(large) if few else large, ["len", "pass", "cell"], "left")
    # A large cell goes to tiles of two of its chunks each, (t1, t2); all others, in order, to a group of
    # cells (t1 = -1), whose first cell goes to the group before too.
    group = F.floor(F.col("cell") / GROUP)
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("long")
    tile = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda t: F.struct(F.least(own, t).alias("t1"), F.greatest(own, t).alias("t2")))
    here = F.struct(F.lit(-1).cast("long").alias("t1"), group.alias("t2"))
    before = F.struct(F.lit(-1).cast("long").alias("t1"), (group - 1).alias("t2"))
    ordered = F.when((F.col("cell") % GROUP == 0) & (group > 0), F.array(here, before)).otherwise(F.array(here))
    split = dealt.withColumn("mine", F.coalesce(own, F.lit(0).cast("long"))).withColumn("t", F.explode(F.when(F.col("chunks").isNull(), ordered).otherwise(tile)))
    spread = F.when(F.col("t.t1") >= 0, F.col("cell")).otherwise(F.lit(-1).cast("long")).alias("of")
    split = split.select("len", "pass", spread, "t.t1", "t.t2", "cell", "fine", "mine", "id", "w", "q", "cells")
    keys = ["len", "pass", "of", "t1", "t2"]

    def compared(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(5)])
            edges = [0, *(np.flatnonzero(np.any(np.diff(k, axis=1) != 0, axis=0)) + 1).tolist(), b.num_rows]
            for a, e in zip(edges, edges[1:]):
                now = tuple(k[:, a].tolist())
                if held and now != last:
                    yield from one(held, last)
                    held = []
                held.append(b.slice(a, e - a))
                last = now
        if held:
            yield from one(held, last)

    def one(parts, now):
        t = pa.Table.from_batches(parts)
        if t.num_rows < 2:
            return
        length, p, _, t1, t2 = now
        cell, mine, ids, w = (t.column(i).to_numpy() for i in (5, 7, 8, 9))
        data = [np.frombuffer(x, np.int8) for x in t.column(10).to_pylist()]
        tail = np.stack([x[length:] for x in data]).view(np.float32)
        cells = np.stack([np.frombuffer(x, np.int32) for x in t.column(11).to_pylist()])
        rows = Rows(ids, w, np.stack([x[:length] for x in data]), tail[:, 0], tail[:, 1], cells)
        whole = slice(0, len(ids))
        if t1 >= 0:
            yield from told(rows, rows.close(whole, whole, cosine), p, (lambda i, j: mine[i] != mine[j]) if t1 != t2 else None)
            return
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(ids)]
        first = GROUP * t2  # cells after the group's own are here for its last boundary alone
        for a, e in zip(edges, edges[1:]):
            if cell[a] < first + GROUP:
                yield from told(rows, rows.close(slice(a, e), slice(a, e), cosine), p, None)
        for at in edges[1:-1]:
            if cell[at - 1] >= first + GROUP:
                break
            low, high = max(0, at - BORDER), min(len(ids), at + BORDER)
            for i, j, _ in rows.close(slice(low, at), slice(at, high), cosine):
                apart = (j - i <= BORDER) & ~(cells[i] == cells[j]).any(axis=1)
                yield from listed(ids[i[apart]], ids[j[apart]])

    def listed(a, b):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), -1, np.int64))], names=_FOUND.names)

    def told(rows, found, p, also):
        """Counts of sure pairs that did not share a cell before pass p, and the open ones listed."""
        n, peer = np.zeros(len(rows.ids), np.int64), rows.ids.copy()
        links = []
        for i, j, sure in found:
            fresh = ~(rows.cells[i, :p] == rows.cells[j, :p]).any(axis=1)
            if also:
                fresh &= also(i, j)
            up = fresh & ~sure & (i < j)
            yield from listed(rows.ids[i[up]], rows.ids[j[up]])
            i, j = i[fresh & sure], j[fresh & sure]
            n += np.bincount(i, weights=rows.w[j], minlength=len(n)).astype(np.int64)
            links.append((i, j))
        if not n.any():
            return
        i, j = (np.concatenate(x) for x in zip(*links))
        before = None
        while before is None or (peer != before).any():
            before = peer.copy()
            np.minimum.at(peer, i, peer[j])
        have = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(rows.ids[have]), pa.array(peer[have]), pa.array(n[have])], names=_FOUND.names)

    found = split.repartition(*keys).sortWithinPartitions(*keys, "cell", "fine", "id").mapInArrow(compared, _FOUND)
    out = written(found, "found")
    dropped(large)
    dropped(lengths)
    return out
