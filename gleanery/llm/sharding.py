"""Histogram sort: documents are dealt into shards of nearly equal bytes with one exchange.

Rows are ordered by a 120-bit key: 60 bits of the md5 of the text, then 60 bits of the md5 of the
id, so equal texts are neighbours and a hot text can still be split. Splitters are found by
counting: each round counts the exact bytes below candidate boundaries (4096 inside each
interval that is still open), keeps the interval that holds each wanted position, and probes finer
there. Built from DataFrame functions only; the driver sees counts of a fixed number, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import dropped, written

#: Bits of the key, of each of its two parts, and of one round of probes.
PART, STEP = 60, 12
#: A splitter between two groups of equal texts is taken if it misses the wanted position by at most
#: this share of a shard; otherwise the group is split.
TOLERANCE = 0.02
#: Rows of a block inside which slots are counted, about.
BLOCK_ROWS = 65_536
LEAST_BLOCKS = 8


def key_part(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, PART // 4), 16, 10).cast("long")


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int]], int]:
    """For ``keys`` (k1, k2, size): the last key of each shard but the last, and the number of rows.

    Splitter i lies where the bytes up to it are nearest to i/shards of all (the lower of two as
    near): between two k1 if one is within the tolerance, else between two (k1, k2). Repeated
    splitters mean empty shards.
    """
    spark = keys.sparkSession
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bytes_all, rows = int(total[0]), int(total[1])
    if not rows:
        return [], 0
    most = (1 << PART) - 1
    out: dict[int, tuple[int, int]] = {}
    nearest = _search(spark, keys, "k1", {i: (None, 0, i * bytes_all / shards) for i in range(1, shards)})
    inside: dict[int, tuple[int | None, int, float]] = {}
    for i, (below, at, low, high) in nearest.items():
        want = i * bytes_all / shards
        side = (below, low) if want - low <= high - want else (at, high)
        if abs(side[1] - want) <= tolerance * bytes_all / shards:
            out[i] = (side[0], most)
        else:
            inside[i] = (at, low, want)
    for i, (below, at, low, high) in _search(spark, keys, "k2", inside).items():
        k1, _, want = inside[i]
        if want - low <= high - want:
            out[i] = (k1, below) if below >= 0 else (k1 - 1, most)
        else:
            out[i] = (k1, at)
    return [out[i] for i in range(1, shards)], rows


def _search(spark, keys: DataFrame, part: str, wants: dict) -> dict[int, tuple[int, int, int, int]]:
    """For each want (k1 or None, bytes before, wanted bytes): the key value that holds the wanted
    position, the value before it, and the exact bytes before it and up to it."""
    open_ = {i: (k1, 0, low, low, want) for i, (k1, low, want) in wants.items()}
    shift = PART
    while open_ and shift:
        shift -= STEP
        groups = sorted({(-1 if k1 is None else k1, prefix) for k1, prefix, *_ in open_.values()})
        rows = keys
        if shift < PART - STEP or part == "k2":
            here = F.struct(
                F.col("k1") if part == "k2" else F.lit(-1).cast("long"), F.shiftright(part, shift + STEP)
            ).isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in groups])
            if part == "k2":
                rows = rows.where(F.col("k1").isin(sorted({a for a, _ in groups})))
            rows = rows.where(here)
        counts = rows.groupBy(
            (F.col("k1") if part == "k2" else F.lit(-1).cast("long")).alias("g"), F.shiftright(part, shift).alias("p")
        ).agg(F.sum("size").alias("b"))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for g, p, b in counts.collect():
            found.setdefault((g, p >> STEP), []).append((p, int(b)))
        for i, (k1, prefix, low, _, want) in open_.items():
            probes = sorted(found[(-1 if k1 is None else k1, prefix)])
            at, below = low, low
            for p, b in probes:
                below, at = at, at + b
                if at >= want:
                    break
            open_[i] = (k1, p, below, at, want)
    return {i: (p - 1, p, low, high) for i, (k1, p, low, high, _) in open_.items()}


def histogram_shard(
    docs: DataFrame,
    *,
    size: Column,
    text: Column,
    ident: Column,
    shards: int = 40,
    tolerance: float = TOLERANCE,
    payload: list[str] | None = None,
) -> DataFrame:
    """All columns of ``docs`` (or those in ``payload``, so that no others are moved) plus ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in it).

    Shard sizes, as ``size`` gives them, are nearly equal: each splitter misses its place by at most
    ``tolerance`` of a shard or half a document. Rows equal in text and id stay in one shard and
    follow each other in an unspecified order; null texts and ids are values of their own. An empty
    table gives none. Texts may be of any length. All other columns pass through whatever their names; ``shard`` and ``slot`` are replaced.
    """
    text, ident = F.coalesce(text, F.lit("")), F.coalesce(ident.cast("string"), F.lit("\x00"))
    # the caller's columns go by their place, so no name can clash
    place = {c: f"c{i}" for i, c in enumerate(payload or docs.columns) if c not in ("shard", "slot")}
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(p) for c, p in place.items()], key_part(text).alias("k1"), key_part(ident).alias("k2"), size.cast("long").alias("size")
    )
    keys = written(keyed.select("k1", "k2", "size"), "keys")
    bounds, rows = splitters(keys, shards, tolerance)
    blocks = max(LEAST_BLOCKS, -(-rows // (shards * BLOCK_ROWS)))

    def dealt(k1: Column, k2: Column) -> list[Column]:
        ends = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in bounds])
        shard = F.size(F.filter(ends, lambda e: e < F.struct(k1.alias("a"), k2.alias("b")))) if bounds else F.lit(0)
        return [shard.cast("int").alias("shard"), F.pmod(k2, F.lit(blocks)).cast("int").alias("block")]

    per = keys.select(*dealt(F.col("k1"), F.col("k2"))).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    order = "partition by shard order by block rows between unbounded preceding and 1 preceding"
    starts = written(per.select("shard", "block", F.expr(f"coalesce(sum(n) over ({order}), 0L)").alias("begin")), "starts")
    dropped(keys)
    at = "partition by shard, block order by k1, k2"
    return (
        keyed.select(*place.values(), "k1", "k2", *dealt(F.col("k1"), F.col("k2")))
        .join(starts, ["shard", "block"])
        .withColumn("slot", F.col("begin") + F.expr(f"row_number() over ({at})") - 1)
        .select(*[F.col(p).alias(c) for c, p in place.items()], "shard", "slot")
    )
