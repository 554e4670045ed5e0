"""Clean copies and repairs: bytes in, bytes without metadata out, with what was taken away."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators.sniff import identified, refined
from gleanery.shared import written

Removed = list[tuple[str, int]]


class Refused(Exception):
    """Why no copy was made."""


def _png(d: bytes) -> tuple[bytes, Removed]:
    out, gone, at = bytearray(d[:8]), [], 8
    while at + 12 <= len(d):
        (n,) = struct.unpack_from(">I", d, at)
        kind = d[at + 4 : at + 8]
        if at + 12 + n > len(d):
            raise Refused("damaged")
        if kind in (b"tEXt", b"zTXt", b"iTXt", b"tIME", b"eXIf", b"caBX"):
            gone.append((kind.decode(), 12 + n))
        else:
            out += d[at : at + 12 + n]
        at += 12 + n
        if kind == b"IEND":
            break
    else:
        raise Refused("damaged")
    if at < len(d):
        gone.append(("data after the image", len(d) - at))
    return bytes(out), gone


def _jpeg(d: bytes) -> tuple[bytes, Removed]:
    out, gone, at = bytearray(d[:2]), [], 2
    while at + 4 <= len(d) and d[at] == 0xFF and d[at + 1] != 0xDA:
        n = 2 + struct.unpack_from(">H", d, at + 2)[0]
        mark = d[at + 1]
        if at + n > len(d):
            raise Refused("damaged")
        if mark in (0xE1, 0xEB, 0xED, 0xFE) or mark == 0xE2 and d[at + 4 : at + 8] == b"MPF\0":
            gone.append((f"marker {mark:02x}", n))
        else:
            out += d[at : at + n]
        at += n
    end = d.find(b"\xff\xd9", at)
    if end < 0:
        raise Refused("damaged")
    out += d[at : end + 2]
    if end + 2 < len(d):
        gone.append(("data after the image", len(d) - end - 2))
    return bytes(out), gone


def _gif(d: bytes) -> tuple[bytes, Removed]:
    start = 13 + (3 << (d[10] & 7) + 1 if d[10] & 0x80 else 0)
    body, gone = d[start:], []
    while (i := body.find(b"\x21\xfe")) >= 0:
        at = i + 2
        while at < len(body) and body[at]:
            at += 1 + body[at]
        gone.append(("comment", at + 1 - i))
        body = body[:i] + body[at + 1 :]
    return d[:start] + body, gone


def _riff(d: bytes) -> tuple[bytes, Removed]:
    out, gone, at = bytearray(), [], 12
    while at + 8 <= len(d):
        (n,) = struct.unpack_from("<I", d, at + 4)
        size = 8 + n + (n & 1)
        name = d[at : at + 4]
        if at + 8 + n > len(d):
            raise Refused("damaged")
        if name in (b"bext", b"EXIF", b"XMP ", b"iXML") or name == b"LIST" and d[at + 8 : at + 12] == b"INFO":
            gone.append((name.decode().strip(), size))
        else:
            out += d[at : at + size]
        at += size
    return d[:4] + struct.pack("<I", 4 + len(out)) + d[8:12] + bytes(out), gone


def _flac(d: bytes) -> tuple[bytes, Removed]:
    keep, gone, at, last = [], [], 4, False
    while not last:
        if at + 4 > len(d):
            raise Refused("damaged")
        last, kind, n = bool(d[at] & 0x80), d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if kind in (2, 4, 5, 6):
            gone.append((f"block {kind}", 4 + n))
        else:
            keep.append((kind, d[at + 4 : at + 4 + n]))
        at += 4 + n
    head = b"".join(bytes([k | (0x80 if i == len(keep) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (k, b) in enumerate(keep))
    return d[:4] + head + d[at:], gone


def _mp3(d: bytes) -> tuple[bytes, Removed]:
    gone = []
    if d[:3] == b"ID3" and len(d) >= 10:
        n = 10 + sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(d[6:10]))
        gone.append(("ID3v2", min(n, len(d))))
        d = d[n:]
    if d[-128:-125] == b"TAG":
        gone.append(("ID3v1", 128))
        d = d[:-128]
    return d, gone


#: Bytes of an archive's members, unpacked, that are rewritten; and of one that is changed.
MOST_ARCHIVE, MOST_MEMBER = 1 << 30, 1 << 26
_BARE = re.compile(r"^docProps/(core|app|custom)\.xml$|^meta\.xml$")
_GONE = re.compile(r"^docProps/thumbnail\.|^Thumbnails/|(^|/)\._[^/]+$|(^|/)\.DS_Store$|(^|/)Thumbs\.db$|printerSettings\d*\.bin$")


_CHANGED = re.compile(r"^word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$|^content\.xml$")
#: What a change leaves in a text once it is accepted: deleted words and old formats go, inserted ones lose their frame.
_ACCEPTED = re.compile(
    rb"(?s)<w:del\s[^>]*(?<!/)>.*?</w:del>|<w:moveFrom\s[^>]*(?<!/)>.*?</w:moveFrom>|<w:(?:[rp]PrChange|sectPrChange|tblPrChange)\b.*?</w:(?:[rp]PrChange|sectPrChange|tblPrChange)>"
    rb"|<text:tracked-changes\b.*?</text:tracked-changes>|<text:change(?:-start|-end)?\s[^>]*/>|</?w:(?:ins|moveTo)(?:\s[^>]*)?>|<w:del\s[^>]*/>"
)


def _zip(d: bytes) -> tuple[bytes, Removed]:
    """Members copied as they are packed; property parts are emptied, changes accepted, what systems left behind goes."""
    out, gone = io.BytesIO(), []
    try:
        with zipfile.ZipFile(io.BytesIO(d)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
            if any(e.flag_bits & 1 for e in a.infolist()):
                raise Refused("encrypted")
            if sum(e.file_size for e in a.infolist()) > MOST_ARCHIVE:
                raise Refused("large")
            kept = [e for e in a.infolist() if not _GONE.search(e.filename)]
            gone += [(e.filename, e.compress_size) for e in a.infolist() if _GONE.search(e.filename)]
            for e in kept:
                info = zipfile.ZipInfo(e.filename, (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED if e.compress_type else zipfile.ZIP_STORED
                if e.date_time != info.date_time:
                    gone.append(("times", 4))
                if _BARE.search(e.filename) and e.file_size <= MOST_MEMBER:
                    body = a.read(e)
                    bare = re.sub(rb"(?s)<property\b.*?</property>|<meta:user-defined\b.*?</meta:user-defined>", b"", body)
                    bare = re.sub(rb">[^<>]+</", b"></", bare)
                    gone += [(e.filename, len(body) - len(bare))] if len(bare) < len(body) else []
                    b.writestr(info, bare)
                    continue
                if _CHANGED.search(e.filename) and e.file_size <= MOST_MEMBER:
                    body = a.read(e)
                    bare = _ACCEPTED.sub(b"", body)
                    gone += [(f"changes of {e.filename}", len(body) - len(bare))] if len(bare) < len(body) else []
                    b.writestr(info, bare)
                    continue
                with a.open(e) as source, b.open(info, "w") as to:  # a member at a time, a piece at a time
                    while piece := source.read(1 << 20):
                        to.write(piece)
    except NotImplementedError as e:
        raise Refused("unreadable") from e
    except (zipfile.BadZipFile, zlib.error, RuntimeError, EOFError) as e:
        raise Refused("damaged") from e
    return out.getvalue(), gone


def _rtf(d: bytes) -> tuple[bytes, Removed]:
    gone: Removed = []

    def drop(m):
        gone.append((m[1].decode(), len(m[0])))
        return b""

    keys = rb"title|subject|author|operator|keywords|doccomm|company|manager|category|creatim|revtim|printim|buptim|version|edmins|vern"
    d = re.sub(rb"\{\\(" + keys + rb")\b[^{}]*\}", drop, d)
    one = rb"(?:\\[{}\\]|[^{}])"
    for _ in range(3):  # groups inside groups, up to three deep
        one = rb"(?:\\[{}\\]|[^{}]|\{" + one + rb"*\})"
    d = re.sub(rb"\{\\\*\\(revtbl|rsidtbl|template|generator|userprops|annotation|atnauthor|atnid|atndate|atrfstart|atrfend)\b" + one + rb"*\}", drop, d)
    # deleted text goes up to the end of its group or to where deleting is turned off
    d = re.sub(rb"\\(deleted)(?![0a-z])(?:(?!\\deleted0)" + one + rb")*(?:\\deleted0 ?)?", drop, d)
    return re.sub(rb"\\(revised|revauthdel|revauth|revdttmdel|revdttm)(?![a-z])-?\d* ?", drop, d), gone


def _svg(d: bytes) -> tuple[bytes, Removed]:
    if d[:2] == b"\x1f\x8b":
        import gzip

        from gleanery.sources.unpack import inflated

        got = inflated(d, 31)
        if got.error or not got.whole:
            raise Refused("damaged" if got.error else "large")
        bare, gone = _svg(got.data)
        return gzip.compress(bare, mtime=0), gone
    gone: Removed = []

    def drop(m):
        gone.append((m[0][1:9].decode("latin-1"), len(m[0])))
        return b""

    d = re.sub(rb"(?s)<metadata\b.*?</metadata>|<(title|desc)\b[^>]*>.*?</\1>|<!--.*?-->", drop, d)
    return re.sub(rb"""\s(?:sodipodi|inkscape):[\w-]+=(?:"[^"]*"|'[^']*')""", drop, d), gone


CLEANERS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "wav": _riff, "webp": _riff, "flac": _flac, "mp3": _mp3, "zip": _zip, "rtf": _rtf, "svg": _svg}


#: Why no copy was made, in words.
REFUSALS = {
    "nothing": "there is nothing in it that could be taken out", "locked": "it is encrypted", "encrypted": "it holds encrypted members", "large": "it is too large to be rewritten",
    "damaged": "parts of it are damaged, and a copy could lose more", "unreadable": "parts of it are packed in a way that is not read", "unsupported": "there is no copy of this format",
    "signed": "a copy would break its signature", "covered": "a box covers a picture that can't be changed here", "incomplete": "it was not read in full", "changes": "the copy would be taken for another format",
}


def clean(content: bytes, format_: str) -> tuple[bytes | None, Removed, str | None]:
    """The clean copy, what was removed (label, bytes), and why there is none (a key of ``REFUSALS``)."""
    from gleanery.operators.sniff import sniffed
    from gleanery.sources.cleaners import MORE

    run = CLEANERS.get(format_) or MORE.get(format_)
    if run is None:
        return None, [], "unsupported"
    try:
        out, gone = run(content)
    except Refused as e:
        return None, [], str(e)
    except (IndexError, struct.error, ValueError):
        return None, [], "damaged"
    if not gone:
        return None, [], "nothing"
    if format_ != "ogg" and sniffed(out) != sniffed(content):
        return None, [], "changes"
    merged: dict[str, int] = {}
    for label, n in gone:
        merged[label] = merged.get(label, 0) + n
    return out, list(merged.items()), None


def repair(content: bytes, format_: str) -> tuple[bytes, list[str]]:
    """The file with checksums, end marks and directories made right where they can be."""
    done: list[str] = []
    if format_ == "png":
        out, at, ended = bytearray(b"\x89PNG\r\n\x1a\n"), 8, False
        if content[:8] != bytes(out):
            done.append("signature")
        while at + 12 <= len(content) and not ended:
            (n,) = struct.unpack_from(">I", content, at)
            if at + 12 + n > len(content):
                break
            part = content[at + 4 : at + 8 + n]
            crc = struct.pack(">I", zlib.crc32(part))
            if crc != content[at + 8 + n : at + 12 + n]:
                done.append(f"{part[:4].decode('latin-1')} checksum")
            out += content[at : at + 4] + part + crc
            ended, at = part[:4] == b"IEND", at + 12 + n
        if not ended:
            out += b"\0\0\0\0IEND\xaeB`\x82"
            done.append("end chunk")
        return bytes(out), done
    if format_ == "jpeg" and not content.rstrip(b"\0").endswith(b"\xff\xd9") and b"\xff\xd9" not in content:
        return content + b"\xff\xd9", ["end marker"]
    if format_ == "zip":
        from gleanery.sources.archive import entries

        rows, _, trouble = entries(content)
        if any("directory" in t[1] for t in trouble) and rows:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for e in rows:
                    z.writestr(zipfile.ZipInfo(e["name"], (1980, 1, 1, 0, 0, 0)), e["read"]() or b"")
            return out.getvalue(), ["directory"]
    return content, done


_COPY = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("format", T.StringType()), T.StructField("copy", T.BinaryType()), T.StructField("error", T.StringType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("bytes", T.LongType())]))),
])
_ARROW = pa.schema([
    ("file_id", pa.string()), ("name", pa.string()), ("format", pa.string()), ("copy", pa.binary()), ("error", pa.string()),
    ("removed", pa.list_(pa.struct([("label", pa.string()), ("bytes", pa.int64())]))),
])


def clean_copies(files: DataFrame) -> DataFrame:
    """Each file's clean copy, or the reason why there is none, and what was taken out."""

    def made(batches):
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: copies are as large as files
                ident, name, form, content = (b.column(c)[i].as_py() for c in range(4))
                form = refined(content or b"", form)
                copy, gone, error = clean(content or b"", form)
                row = {"file_id": ident, "name": name, "format": form, "copy": copy, "error": error, "removed": [{"label": x, "bytes": n} for x, n in gone]}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return identified(files).select(F.col("file_id").cast("string"), "name", "format", "content").mapInArrow(made, _COPY)


def _contract_format(format_: str) -> Column:
    return F.when(F.col(format_) == "cfb", "office97").otherwise(F.col(format_))


def verified_copies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean copies that are read again and compared with their files, finding by finding.

    Returns the comparison (file_id, kind, status, reason, unexpected) and the receipts (file_id, format, copy_sha256, copy_bytes,
    removed_bytes, removed_kinds, present_kinds, unchecked, unexpected, error, complete). Copies are written once; contents go through no shuffle.
    """
    from gleanery.functions.dims import removal_contract
    from gleanery.operators.verify import compare_copies
    from gleanery.sources.engine import inspect, tables

    spark = files.sparkSession
    copies = written(clean_copies(files), "copies")
    before = tables(written(inspect(files).where("row in ('file', 'fact')"), "before"))
    there = copies.where("copy is not null").select("file_id", "name", F.col("copy").alias("content"))
    after = tables(written(inspect(there).where("row in ('file', 'fact')"), "after"))
    made = there.select("file_id")
    finding = lambda t: t["facts"].join(made, "file_id", "left_semi").select("file_id", "ordinal", "kind", F.lit("file").alias("scope"), F.col("text").alias("value"))
    side = lambda t, p: t["files"].select("file_id", _contract_format("format").alias(f"{p}_format"), F.col("metadata_complete").alias(f"{p}_complete"))
    snapshots = written(side(before, "source").join(side(after, "copy"), "file_id"), "snapshots")
    items = written(compare_copies(finding(before), finding(after), snapshots, removal_contract(spark)), "items")
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("kind"))))
    totals = items.groupBy("file_id").agg(
        of("removed").alias("removed_kinds"), of("present").alias("present_kinds"), F.count_if(F.col("status") == "unchecked").alias("unchecked"), F.count_if("unexpected").alias("unexpected")
    )
    none = F.array().cast("array<string>")
    receipts_ = copies.join(totals, "file_id", "left").join(snapshots, "file_id", "left").select(
        "file_id", "format", F.sha2("copy", 256).alias("copy_sha256"), F.octet_length("copy").cast("long").alias("copy_bytes"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["bytes"]), F.lit(0).cast("long")).alias("removed_bytes"),
        F.coalesce("removed_kinds", none).alias("removed_kinds"), F.coalesce("present_kinds", none).alias("present_kinds"), F.coalesce("unchecked", F.lit(0)).alias("unchecked"),
        F.coalesce("unexpected", F.lit(0)).alias("unexpected"), "error", F.coalesce(F.col("source_complete") & F.col("copy_complete"), F.lit(False)).alias("complete"),
    )
    return items, receipts_


def related_copies(files: DataFrame, relations: DataFrame) -> DataFrame:
    """Copies of only those files that a relation (``indexes`` of file ids) puts together with others."""
    ids = relations.select(F.explode("indexes").alias("file_id")).distinct()
    return clean_copies(files.join(ids, "file_id", "left_semi"))
