"""Very large movies read with gaps: all boxes but the bodies of their media, from a folder that executors share."""

from __future__ import annotations

import glob
import os
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files from this size on are read with gaps; media bodies from this size on are gaps.
LEAST_FILE, LEAST_GAP = 64 << 20, 1 << 20
#: Bytes of what is read of one movie.
MOST_KEPT = 64 << 20
SCHEMA = "file_id string, name string, length bigint, parts array<struct<start: bigint, data: binary>>, gaps array<struct<start: bigint, length: bigint>>, error string"


def gapped(path: str, least_gap: int = LEAST_GAP) -> tuple[list[tuple[int, bytes]], list[tuple[int, int]], str | None]:
    """Parts (start, bytes) and gaps (start, length) of a movie, in order, and why some of it was not read."""
    size, parts, gaps, kept, at = os.path.getsize(path), [], [], 0, 0
    with open(path, "rb") as f:
        while at < size:
            f.seek(at)
            head = f.read(16)
            if len(head) < 8:
                parts.append((at, head))
                return parts, gaps, "box cut short"
            n, skip = struct.unpack(">I", head[:4])[0], 8
            if n == 1 and len(head) == 16:
                n, skip = struct.unpack(">Q", head[8:])[0], 16
            n = n or size - at
            if n < skip:
                return parts, gaps, "box cut short"
            end = min(size, at + n)
            if head[4:8] == b"mdat" and end - at - skip >= least_gap:
                parts.append((at, head[:skip]))
                gaps.append((at + skip, end - at - skip))
                kept += skip
            else:
                kept += end - at
                if kept > MOST_KEPT:
                    return parts, gaps, "more boxes than are read"
                f.seek(at)
                parts.append((at, f.read(end - at)))
            if at + n > size:
                return parts, gaps, "box cut short"
            at = end
    return parts, gaps, None


def joined(parts: list[tuple[int, bytes]]) -> bytes:
    """The parts without their gaps, media boxes given the size that is left of them, for the decoders."""
    out = bytearray()
    for _, data in parts:
        out += struct.pack(">I", 8) + b"mdat" if data[4:8] == b"mdat" and len(data) <= 16 else data
    return bytes(out)


def clean_parts(parts: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """The parts that change in a clean copy, at their places: everything keeps its offset, so gaps are not touched."""
    from gleanery.sources.cleaners import movie

    out = []
    for start, data in parts:
        if data[4:8] != b"mdat":
            new, gone = movie(data)
            if gone:
                out.append((start, new))
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.pattern = options.get("path", "").removeprefix("file://")
        self.least_file, self.least_gap = int(options.get("least_file", LEAST_FILE)), int(options.get("least_gap", LEAST_GAP))

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.pattern, "**"), recursive=True) if os.path.isdir(self.pattern) else glob.glob(self.pattern))
        if not found:
            raise ValueError(f"no files at {self.pattern}: movies are read with gaps from a shared folder only")
        return [InputPartition(p) for p in found if os.path.isfile(p) and os.path.getsize(p) >= self.least_file]

    def read(self, partition):
        import hashlib

        path = partition.value
        parts, gaps, error = gapped(path, self.least_gap)
        yield hashlib.md5(path.encode()).hexdigest(), path, os.path.getsize(path), parts, gaps, error


class GappedMovies(DataSource):
    """``spark.read.format("gapped_movies").load(folder)`` once it is registered: a row and a task a movie."""

    @classmethod
    def name(cls):
        return "gapped_movies"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
