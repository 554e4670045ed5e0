"""MinHash near-dedup by min-max hashing: both ends of every permutation are kept.

Each of 64 permutations of a document's shingles gives two signature values, its minimum and its maximum,
so 128 values cost 64 hash evaluations. Four values make a band, 32 bands a document. Texts with
the same set are one class. In each band's bucket the members are compared with one hub, on their
full sets; what a hub does not connect is compared by the rarest shingles (prefix filter), which
finds every other pair that can be linked. So no pair list of a group is ever made, no bucket is
cut, and copies are never compared with each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import wordhash
from gleanery.llm.common import BROADCAST_ROWS, written
from gleanery.llm.links import components

SHINGLE, PERCENT = 5, 85
PERMUTATIONS, ROWS = 64, 4


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; all words as one if they are fewer; none without."""
    h = wordhash.word_hashes(wordhash.split(text, lower=True))
    if 0 < len(h) < k:
        return wordhash.windows(h, len(h), wordhash.BASES[1])
    return np.unique(wordhash.windows(h, k))


_FACTORS = wordhash.mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(wordhash.BASES[0])) | np.uint64(1)


def bands(s: np.ndarray) -> np.ndarray:
    """A hash for each band of the min-max signature of ``s``."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 2_048):
        x = np.multiply.outer(_FACTORS, s[at : at + 2_048])
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    rows = np.stack([low, high], axis=1).reshape(-1, ROWS)
    out = np.arange(len(rows), dtype=np.uint64)
    for j in range(ROWS):
        out = wordhash.mixed(out * np.uint64(wordhash.BASES[1]) + rows[:, j])
    return out.view(np.int64)


def near_duplicates(
    docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, ``kept``: a row for each row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    a component is all that links reach. Pairs are found by their bands (a pair at 85 % is missed
    with a chance below 1e-10) and confirmed on full sets. Documents without words have no shingles and are linked with nothing. Ids are
    integers, rows of one id are one document; a null id stands for itself, has no component and is kept. Texts may be of any
    length; of buckets with ties the least id is the hub, so the order of rows does not matter. Other columns are not read, whatever
    their names. An empty table gives none.
    """
    out = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("of", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def signed(batches):
        for b in batches:
            n, of, marks = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), shingle)
                n.append(len(s))
                of.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                marks.append(bands(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(of, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=out.names
            )
        wordhash.forget()

    bare = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signatures = written(bare.mapInArrow(signed, out), "signatures")
    linked = _linked(signatures.where("id is not null and of is not null"), bare, percent, shingle)
    named = signatures.join(linked, "of", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")
    )
    return named.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _linked(signatures: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``of``, ``component`` of the classes of equal sets that hold or are linked with another document."""
    classes = written(
        signatures.groupBy("of").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.min_by("bands", "id").alias("bands")
        ),
        "classes",
    )
    marked = classes.select("id", "copies", "n", F.explode("bands").alias("bucket"))
    hubs = written(
        marked.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.max(F.struct(F.col("copies"), (-F.col("id")).alias("id"))).alias("top"))
        .where("m > 1")
        .select("bucket", (-F.col("top.id")).alias("hub")),
        "hubs",
    )
    few = hubs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    members = written(marked.join(F.broadcast(hubs) if few else hubs, "bucket").select("bucket", "hub", "id", "n"), "members")
    sets = _sets(members.select("id").distinct(), texts, shingle)
    pairs = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    first = written(_confirmed(pairs, sets, percent), "first")
    at = components(first)
    second = written(_confirmed(_rare_pairs(members, at, sets, percent), sets, percent), "second")
    if not second.isEmpty():
        at = components(first.unionByName(second))
    return (
        classes.select("of", "id", "copies")
        .join(at, "id", "left")
        .where("copies > 1 or component is not null")
        .select("of", F.coalesce("component", "id").alias("component"))
    )


def _sets(ids: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``id``, ``n``, ``set`` of the documents that have to be compared, written once."""
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def made(batches):
        for b in batches:
            s = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=out.names
            )
        wordhash.forget()

    ids = written(ids, "compared")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(ids) if few else ids, "id").mapInArrow(made, out)
    return written(found, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b").distinct()


def _rare_pairs(members: DataFrame, at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members that buckets put together, that no link connects yet, and that can be linked.

    All sets are put in one order, from rare to frequent shingles, so those in one set only come first.
    Linked sets have so much in common that after their first common shingle, itself included, both
    still have percent / (100 + percent) of both sizes together. Only shingles with so many behind
    them are joined, and only where both sides still have enough: a group's common shingles, which stand last, seldom do. Of
    the members that share such a shingle, those outside its largest component meet all others.
    """
    placed = members.select("bucket", "id").join(at, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("bucket")
    open_ = written(placed.join(split, "bucket").select("id", "c").distinct(), "open")
    long = open_.join(sets, "id").select("id", "c", "n", F.explode("set").alias("s"))
    shared = long.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    behind = F.row_number().over(W.partitionBy("id").orderBy(F.desc("df"), "s")).alias("rest")
    ranked = long.join(shared, "s").select("id", "c", "n", "s", behind)
    prefix = written(ranked.where(100 * F.col("rest") >= percent * F.col("n")), "prefix")
    sized = prefix.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m"))
    main = sized.groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("cs")).where("cs > 1")
    met = written(prefix.join(main.select("s", "main"), "s"), "met")
    left = met.where("c <> main").select("s", *[F.col(x).alias(x + "a") for x in ("id", "c", "n", "rest")])
    right = met.select("s", *[F.col(x).alias(x + "b") for x in ("id", "c", "n", "rest")])
    enough = (100 + percent) * F.least("resta", "restb") >= percent * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "s").where(enough & (F.col("ca") != F.col("cb")))
    return pairs.select(F.greatest("ida", "idb").alias("a"), F.least("ida", "idb").alias("b")).distinct()
