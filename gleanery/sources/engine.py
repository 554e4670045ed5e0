"""Inspection: files in, long rows of nodes, problems and facts out. Content is read and dropped in one stage."""

from __future__ import annotations

import email
import email.policy
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from gleanery.operators.sniff import identified, refined
from gleanery.sources.decode import decode

LONG = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("format", T.StringType()), T.StructField("row", T.StringType()), T.StructField("ordinal", T.LongType()),
    T.StructField("parent", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("complete", T.BooleanType()),
])
#: Rows of one output batch, about.
BATCH = 20_000


def inspect(files: DataFrame, format_col: str | None = None) -> DataFrame:
    """One row for each file (``row`` = file), node, problem and fact; filter by ``row`` for the tables."""
    named = files if format_col else identified(files).withColumnRenamed("format", "_format")
    col = format_col or "_format"

    def decoded(batches):
        rows: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                ident, form, content = (b.column(c)[i].as_py() for c in range(3))
                form = refined(content or b"", form)
                f = decode(content, form)
                rows.append((ident, form, "file", 0, None, form, None, 0, len(content or b""), f.complete))
                rows += [(ident, form, "node", n, p, label, v, s, size, None) for n, p, label, s, size, v in f.nodes]
                rows += [(ident, form, "problem", j, None, c, label, s, n, None) for j, (c, label, s, n) in enumerate(f.problems)]
                rows += [(ident, form, "fact", j, n, k, t, None, None, None) for j, (k, t, n) in enumerate(f.facts)]
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.bool_()]

    def batch(rows):
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=LONG.names)

    return named.select(F.col("file_id").cast("string"), F.col(col).alias("format"), "content").mapInArrow(decoded, LONG)


def tables(long: DataFrame) -> dict[str, DataFrame]:
    """``files``, ``nodes``, ``problems`` and ``facts`` out of what ``inspect`` returns."""
    of = lambda r: long.where(F.col("row") == r)
    return {
        "files": of("file").select("file_id", "format", F.lit(None).cast("string").alias("misnamed"), F.col("complete").alias("metadata_complete"), F.col("length").alias("bytes")),
        "nodes": of("node").select("file_id", F.col("ordinal").alias("node_id"), F.col("parent").alias("parent_id"), F.col("kind").alias("label"), "start", "length", F.col("text").alias("value")),
        "problems": of("problem").select("file_id", "ordinal", F.col("kind").alias("concern"), F.col("text").alias("label"), "start", "length"),
        "facts": of("fact").select("file_id", "ordinal", "kind", "text", F.col("parent").alias("node_id")),
    }


@udtf(returnType="node_id bigint, parent_id bigint, label string, start bigint, length bigint, value string")
class Nodes:
    """``SELECT * FROM files, LATERAL nodes(content, format)``."""

    def eval(self, content: bytes, format_: str):
        for n, p, label, s, size, v in decode(bytes(content) if content is not None else None, format_).nodes:
            yield n, p, label, s, size, v


@udtf(returnType="name string, position bigint, span bigint, method int, size bigint, packed bigint, crc bigint")
class ArchiveEntries:
    """``SELECT * FROM files, LATERAL archive_entries(content)``."""

    def eval(self, content: bytes):
        from gleanery.sources.archive import entries

        for e in entries(bytes(content or b""))[0]:
            yield e["name"], e["offset"], e["span"], e["method"], e["size"], e["packed"], e["crc"]


def register(spark: SparkSession) -> None:
    """The table functions under their SQL names."""
    spark.udtf.register("nodes", Nodes)
    named = {
        "archive_entries": ArchiveEntries, "deflate_blocks": DeflateBlocks, "facts": Facts, "problems": Problems, "members": Members, "page_marks": PageMarks,
    }
    for name, function in named.items():
        spark.udtf.register(name, function)


_MEMBER = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("parent_file_id", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType()),
])


def opened(content: bytes, form: str, most: int):
    """Files inside one: (name, content or None, why not). Each is unpacked when it is reached, so one at a time is held."""
    import re

    from gleanery.sources import archive, compound, pages

    if form == "zip":
        for e in archive.entries(content)[0]:
            if not e["name"].endswith("/"):
                got = e["unpack"](most)
                yield e["name"], got.data if not got.error and got.whole else None, got.error or (None if got.whole else "too large")
    elif form == "eml":
        for p in email.message_from_bytes(content, policy=email.policy.default).walk():
            if p.get_filename() or p.get_content_disposition() == "attachment":
                data = p.get_payload(decode=True) or b""
                yield p.get_filename() or "", data if len(data) <= most else None, None if len(data) <= most else "too large"
    elif form == "pdf":
        found = pages.objects(content)
        for number, body in found.items():
            named, at = re.search(rb"/(?:UF|F)\s*\(((?:\\.|[^\\()])*)\)", body), re.search(rb"/EF\s*<<[^>]*?/(?:UF|F)\s+(\d+)\s+\d+\s+R", body)
            if at:
                data = pages.stream(found.get(int(at[1]), b""))
                yield named[1].decode("latin-1") if named else f"object {number}", data, None if data is not None else "does not unpack"
    elif form == "cfb":
        yield from ((n, x, None) for n, x in compound.attachments(content))


def members(files: DataFrame, most_bytes: int = 1 << 26) -> DataFrame:
    """Files inside archives, messages and documents as files of their own: ``file_id, parent_file_id, depth, name, length, content,
    error``. A member larger than ``most_bytes``, or one that does not unpack, is a row without content that says why."""
    depth = F.col("depth") if "depth" in files.columns else F.lit(0)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, form, d, content = (b.column(c)[i].as_py() for c in range(4))
                try:
                    for j, (name, data, error) in enumerate(opened(content or b"", form, most_bytes)):
                        row = (hashlib.md5(f"{ident}/{j}".encode()).hexdigest(), ident, d + 1, name, None if data is None else len(data), data, error)
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string()))], names=_MEMBER.names)
                except Exception:  # noqa: BLE001  what does not open has no members; the decoder says why
                    continue

    return identified(files.withColumn("depth", depth.cast("int"))).select(F.col("file_id").cast("string"), "format", "depth", "content").mapInArrow(run, _MEMBER)


def _end(d: bytes, form: str, at: int) -> int | None:
    """Where a file that begins at ``at`` ends, as its own structure says; null where it does not."""
    import struct

    if form == "png":
        o = at + 8
        while o + 12 <= len(d):
            n, kind = struct.unpack_from(">I4s", d, o)
            o += 12 + n
            if kind == b"IEND":
                return o if o <= len(d) else None
    elif form == "jpeg":
        end = d.find(b"\xff\xd9", at)
        return end + 2 if end >= 0 else None
    elif form == "pdf":
        end = d.find(b"%%EOF", at)
        return end + 5 if end >= 0 else None
    elif form == "zip":
        end = d.find(b"PK\5\6", at)
        return end + 22 + struct.unpack_from("<H", d, end + 20)[0] if 0 <= end <= len(d) - 22 else None
    elif form == "gif":
        end = d.find(b"\0;", at)
        return end + 2 if end >= 0 else None
    return None


def carved(files: DataFrame) -> DataFrame:
    """Signatures of known files inside the bytes of others: ``file_id, format, start, length``, from 1 byte on; the length is null
    where the file does not say where it ends. Every hit is a row."""
    import re

    # Signatures long enough to be looked for anywhere.
    marks = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "pdf": b"%PDF-", "zip": b"PK\x03\x04", "flac": b"fLaC", "ogg": b"OggS", "cfb": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "wasm": b"\0asm"}
    any_mark = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), re.escape(v)) for k, v in marks.items()))

    def found(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                out = []
                for m in any_mark.finditer(content, 1):
                    end = _end(content, m.lastgroup, m.start())
                    out.append((ident, m.lastgroup, m.start(), None if end is None else end - m.start()))
                    if len(out) == BATCH:
                        yield rows(out)
                        out = []
                yield rows(out)

    def rows(out):
        columns = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["file_id", "format", "start", "length"])

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(found, "file_id string, format string, start bigint, length bigint")


@udtf(returnType="kind string, first_bit bigint, last_bit bigint, literals bigint, matches bigint, bytes bigint, checkpoint bigint, error string")
class DeflateBlocks:
    """``SELECT * FROM files, LATERAL deflate_blocks(content)``: how a bare deflate stream is put together."""

    def eval(self, content: bytes):
        from gleanery.sources.unpack import traced

        blocks, error = traced(bytes(content or b""))
        for b in blocks:
            yield b["kind"], b["start"], b["end"], b["literals"], b["matches"], b["bytes"], b["checkpoint"], None
        if error:
            yield None, None, None, None, None, None, None, error


@udtf(returnType="kind string, text string, node_id bigint")
class Facts:
    """``SELECT * FROM files, LATERAL facts(content, format)``."""

    def eval(self, content: bytes, format_: str):
        yield from decode(bytes(content) if content is not None else None, format_).facts


@udtf(returnType="concern string, label string, start bigint, length bigint")
class Problems:
    """``SELECT * FROM files, LATERAL problems(content, format)``."""

    def eval(self, content: bytes, format_: str):
        yield from decode(bytes(content) if content is not None else None, format_).problems


@udtf(returnType="name string, length bigint, content binary, error string")
class Members:
    """``SELECT * FROM files, LATERAL members(content, format)``."""

    def eval(self, content: bytes, format_: str):
        for name, data, error in opened(bytes(content or b""), format_, 1 << 26):
            yield name, None if data is None else len(data), data, error


@udtf(returnType="page bigint, kind string, ordinal bigint, l double, b double, r double, t double, text string")
class PageMarks:
    """``SELECT * FROM files, LATERAL page_marks(content)``: glyphs, fills and images of a PDF."""

    def eval(self, content: bytes):
        from gleanery.sources.pages import painted

        for row in painted(bytes(content or b"")):
            yield row[:8]


def trace_summary(blocks: DataFrame, stream: str = "file_id") -> DataFrame:
    """Blocks, literals, matches and bytes of each stream out of the rows of ``deflate_blocks``."""
    return blocks.where("kind is not null").groupBy(stream).agg(F.count(F.lit(1)).alias("blocks"), *[F.sum(c).alias(c) for c in ("literals", "matches", "bytes")])


def structure(found, name: str, format_: str, size: int) -> str:
    """A file's tree as nested JSON, with what it reveals and what is wrong with it."""
    import json

    parts = [{"label": label, "offset": s, "length": n, **({"value": v} if v else {})} for _, _, label, s, n, v in found.nodes]
    for i, (_, parent, *_rest) in enumerate(found.nodes):
        if parent is not None:
            parts[parent].setdefault("children", []).append(parts[i])
    return json.dumps({
        "file": name, "format": format_, "size": size, "reveals": [{"kind": k, "text": t} for k, t, _ in found.facts],
        "problems": [{"label": x, "concern": c, "offset": s, "length": n} for c, x, s, n in found.problems], "structure": parts[0],
    }, indent=1)


def structures(files: DataFrame) -> DataFrame:
    """``file_id, format, json`` of each file's structure."""

    def made(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                ident, name, form, content = (b.column(c)[i].as_py() for c in range(4))
                form = refined(content or b"", form)
                rows.append((ident, form, structure(decode(content, form), name, form, len(content or b""))))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["file_id", "format", "json"])

    return identified(files).select(F.col("file_id").cast("string"), "name", "format", "content").mapInArrow(made, "file_id string, format string, json string")
