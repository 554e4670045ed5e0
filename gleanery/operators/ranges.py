"""Byte and time ranges: composition sweep, gaps and overlaps, entropy, search, numbered windows."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


_SLICES = "file_id {}, start bigint, end bigint, role string, node_id bigint"


def composition(ranges: DataFrame) -> DataFrame:
    """Disjoint slices (file_id, start, end, role, node_id) that tile each file from 0 to its last end.

    ``ranges`` has file_id, node_id, depth, start, end (exclusive), role. In each elementary interval the
    deepest range wins, of those the one with the largest id; where none is, the role is ``hidden``;
    neighbours of one role are one slice, which keeps the node of its larger part. Each file is swept once, from left to right, with
    the open ranges in a heap; a file has as many ranges as its decoder has nodes at most.
    """
    kind = ranges.schema["file_id"].dataType

    def swept(key, table):
        start, end, depth, node = (table[c].to_numpy().astype(np.int64) for c in ("start", "end", "depth", "node_id"))
        roles = table["role"].to_pylist()
        cuts = np.unique(np.concatenate([[0], start, end]))
        order, heap, next_, out = np.argsort(start, kind="stable"), [], 0, []
        for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
            while next_ < len(order) and start[order[next_]] <= low:
                i = int(order[next_])
                heapq.heappush(heap, (-int(depth[i]), -int(node[i]), i))
                next_ += 1
            while heap and end[heap[0][2]] <= low:
                heapq.heappop(heap)
            i = heap[0][2] if heap else None
            role, of = (roles[i], int(node[i])) if i is not None else ("hidden", None)
            if out and out[-1][2] == role:
                last = out[-1]
                last[1] = high
                last[4].append((high - low, of))
            else:
                out.append([low, high, role, None, [(high - low, of)]])
        for row in out:
            size: dict = {}
            for n, of in row[4]:
                size[of] = size.get(of, 0) + n
            row[3] = max(size, key=lambda of: (size[of], of is not None, of or 0))
        columns = list(zip(*(r[:4] for r in out))) if out else [()] * 4
        return pa.table({
            "file_id": pa.array([key[0].as_py()] * len(out), table["file_id"].type), "start": pa.array(columns[0], pa.int64()), "end": pa.array(columns[1], pa.int64()),
            "role": pa.array(columns[2], pa.string()), "node_id": pa.array(columns[3], pa.int64()),
        })

    good = ranges.where("end > start and start >= 0").select("file_id", "node_id", "depth", "start", "end", "role")
    return good.groupBy("file_id").applyInArrow(swept, _SLICES.format(kind.simpleString()))


def gaps_and_overlaps(ranges: DataFrame, group: str, start: str, end: str, tie: str) -> DataFrame:
    """Each range with ``gap`` before it (null for the first) and whether it ``overlaps`` an earlier one."""
    w = W.partitionBy(group).orderBy(start, tie).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(end).over(w)
    return ranges.select(
        group, tie, start, end, F.when(F.col(start) > before, F.col(start) - before).alias("gap"), F.coalesce(F.col(start) < before, F.lit(False)).alias("overlaps")
    )


def _counted(files: DataFrame, bins: int, least: int, made, schema: str) -> DataFrame:
    """Rows that ``made`` makes of the byte counts of each window of each file; contents are read once, in one Arrow stage."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    kinds = [pa.string() if x.strip().endswith("string") else pa.float64() if x.strip().endswith("double") else pa.int64() for x in schema.split(",")]

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data = b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else None
                if data is None or not data.size:
                    continue
                n = max(1, min(bins, data.size // least))
                step = -(-data.size // n)
                x = np.frombuffer(data, np.uint8)
                for w, at in enumerate(range(0, len(x), step)):
                    out += made(b.column(0)[i].as_py(), w, np.bincount(x[at : at + step], minlength=256))
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, schema)


def entropy_windows(files: DataFrame, bins: int = 8, least: int = 256) -> DataFrame:
    """Shannon entropy in bits a byte of up to ``bins`` equal windows of 256 bytes at least. Empty files have none."""

    def made(ident, window, counts):
        n, c = int(counts.sum()), counts[counts > 0]
        return [(ident, window, n, round(float(np.log2(n) - (c * np.log2(c)).sum() / n), 6) + 0.0)]

    return _counted(files, bins, least, made, "file_id string, window bigint, bytes bigint, entropy double")


def byte_histogram(files: DataFrame) -> DataFrame:
    """``byte``, ``n`` over all files: at most 256 rows leave a file."""
    made = lambda _, __, counts: [(int(b), int(counts[b])) for b in np.flatnonzero(counts)]
    return _counted(files, 1, 256, made, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))


def search_pattern(query: str) -> tuple[str, bytes | int]:
    """What a query asks for: ``("hex", bytes)`` for ``FF D8`` or ``0xFFD8``, ``("at", offset)`` for ``@1024`` or ``@0x400``, else ``("text", bytes)``."""
    q = query.strip()
    if re.fullmatch(r"@(0[xX][0-9A-Fa-f]+|[0-9]+)", q):
        return "at", int(q[1:], 0) if q[1:2] != "0" or q[2:3] in "xX" else int(q[1:])
    bare = re.sub(r"\s", "", q)
    if re.fullmatch(r"(0[xX])?([0-9A-Fa-f]{2})+", bare) and (bare[:2].lower() == "0x" or re.fullmatch(r"[0-9A-Fa-f]{2}(\s+[0-9A-Fa-f]{2})*", q)):
        return "hex", bytes.fromhex(bare[2:] if bare[:2].lower() == "0x" else bare)
    return "text", query.encode("utf-8")


def occurrences(files: DataFrame, query: str) -> DataFrame:
    """``file_id``, ``at``: every place (bytes from 0) where a query stands in the files, overlapping ones too; text whatever the case of
    A-Z. A place that is asked for is there if the file reaches it."""
    kind, want = search_pattern(query)
    fold = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
    pattern = None if kind == "at" else re.compile(b"(?=" + re.escape(want.translate(fold) if kind == "text" else want) + b")")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, data = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                if pattern is None:
                    hits = [want] if want < len(data) else []
                else:
                    hits = [m.start() for m in pattern.finditer(data.translate(fold) if kind == "text" else data)] if want else []
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(hits), pa.string()), pa.array(hits, pa.int64())], names=["file_id", "at"])

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, "file_id string, at bigint")


def nearest_rank(rows: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the first value whose cumulated count reaches the share."""
    return rows.groupBy(*group).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(100 * p)}") for p in shares])


def spread(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Median, median absolute deviation and coefficient of variation."""
    mid = rows.groupBy(*group).agg(F.median(value).alias("median"), (F.stddev_pop(value) / F.avg(value)).alias("cv"))
    off = rows.join(mid, group).groupBy(*group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return mid.join(off, group)
