"""Decoders: bytes to nodes (a tree of byte ranges), problems and facts. Plain Python, no Spark.

Every decoder is total: whatever it is given it returns a root node, and what it cannot follow becomes a
problem and an incomplete result, never an exception.
"""

from __future__ import annotations

import email
import email.header
import email.policy
import re
import struct
import zlib
from dataclasses import dataclass, field
from datetime import UTC, datetime
from html.parser import HTMLParser

from gleanery.sources.pictures import Pixels, captions, heif_items, png_chunk, profile, xmp
from gleanery.sources.unpack import inflated

#: Nodes of one file; one more says that the limit was reached.
MOST_NODES = 500_000
DAMAGE, HIDDEN, ODDITY = "damage", "hidden", "oddity"


@dataclass
class Found:
    nodes: list[tuple[int, int | None, str, int, int, str | None]] = field(default_factory=list)
    problems: list[tuple[str, str, int, int]] = field(default_factory=list)
    facts: list[tuple[str, str, int]] = field(default_factory=list)
    complete: bool = True
    most: int = MOST_NODES

    def node(self, parent: int | None, label: str, start: int, length: int, value: object = None) -> int:
        if len(self.nodes) >= self.most:
            if self.complete or self.nodes[-1][2] != "limit reached":
                self.nodes.append((len(self.nodes), 0, "limit reached", start, 0, None))
                self.problem(DAMAGE, "limit reached", start, 0)
            return len(self.nodes) - 1
        self.nodes.append((len(self.nodes), parent, label, start, length, None if value is None else str(value)))
        return len(self.nodes) - 1

    def problem(self, concern: str, label: str, start: int, length: int) -> None:
        self.problems.append((concern, label, start, length))
        if concern == DAMAGE:
            self.complete = False

    def bound(self, what: str, start: int, length: int) -> None:
        """Some of the file is not read, as a bound was reached: a problem, and the result is partial."""
        self.problems.append((ODDITY, f"more {what} than are read", start, length))
        self.complete = False

    def fact(self, kind: str, text: object, node: int) -> None:
        if str(text).strip():
            self.facts.append((kind, str(text).strip(), node))


def _text(data: bytes, charset: str = "utf-8") -> str:
    return data.decode(charset, "replace").strip("\x00 \r\n\t")


# Keywords of PNG texts and tags of other formats, by the kind of finding they make.
PNG_KINDS = {"Author": "author", "Title": "title", "Description": "description", "Software": "software", "Comment": "comments", "Creation Time": "created",
             "Copyright": "copyright", "parameters": "prompt", "prompt": "prompt", "Source": "camera"}
TIFF_TAGS = {0x010E: ("caption", "ImageDescription"), 0x010F: ("camera", "Make"), 0x0110: ("camera", "Model"), 0x0131: ("software", "Software"),
             0x0132: ("modified", "DateTime"), 0x013B: ("author", "Artist"), 0x8298: ("copyright", "Copyright"), 0x9003: ("taken", "DateTimeOriginal"),
             0xA430: ("owner", "CameraOwnerName"), 0xA431: ("serial", "BodySerialNumber"), 0xA434: ("lens", "LensModel")}
COMMENT_KINDS = {"TITLE": "title", "ARTIST": "artist", "ALBUM": "album", "ALBUMARTIST": "album-artist", "DATE": "year", "TRACKNUMBER": "track", "DISCNUMBER": "disc",
                 "GENRE": "genre", "COMPOSER": "composer", "ENCODER": "encoder", "ORGANIZATION": "organization", "LOCATION": "location", "COMMENT": "comment"}
ID3_KINDS = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TPE2": "album-artist", "TYER": "year", "TDRC": "year", "TRCK": "track", "TPOS": "disc",
             "TCON": "genre", "TCOM": "composer", "TSSE": "encoder", "COMM": "comment"}
OLD_ID3 = {"TT2": "title", "TP1": "artist", "TAL": "album", "TP2": "album-artist", "TYE": "year", "TRK": "track", "TPA": "disc", "TCO": "genre", "TCM": "composer", "TSS": "encoder"}
INFO_KINDS = {"INAM": "title", "IART": "artist", "IPRD": "album", "ICMT": "description", "ICOP": "copyright", "ICRD": "created", "ISFT": "software",
              "IENG": "engineer", "IKEY": "keywords", "ISBJ": "subject", "IARL": "place", "ITRK": "track"}
MOVIE_KINDS = {"\xa9nam": "title", "\xa9too": "encoder", "\xa9ART": "artist", "\xa9alb": "album", "aART": "album-artist", "\xa9day": "created", "\xa9cmt": "comment", "\xa9gen": "genre",
               "\xa9wrt": "composer", "\xa9mak": "camera", "\xa9mod": "camera", "\xa9swr": "software", "desc": "description", "cprt": "copyright"}
RTF_KINDS = {"title": "title", "subject": "subject", "author": "author", "operator": "editor", "keywords": "keywords", "doccomm": "description", "company": "company", "manager": "manager", "category": "category"}


# First bytes of familiar formats that are named, not read.
FAMILIAR = [(b"7z\xbc\xaf\x27\x1c", "7z archive"), (b"Rar!\x1a\x07", "RAR archive"), (b"\x1f\x8b", "gzip stream"), (b"BZh", "bzip2 stream"), (b"\xfd7zXZ\0", "xz stream"),
            (b"\x28\xb5\x2f\xfd", "zstd stream"), (b"MZ", "Windows program"), (b"\x7fELF", "ELF program"), (b"SQLite format 3\0", "SQLite database"), (b"\0\1\0\0\0", "TrueType font"),
            (b"OTTO", "OpenType font"), (b"BM", "bitmap"), (b"PAR1", "Parquet table")]


def png(d: bytes, f: Found, root: int) -> None:
    f.node(root, "signature", 0, 8)
    if d[:8] != b"\x89PNG\r\n\x1a\n":
        f.problem(DAMAGE, "signature damaged", 0, 8)
    at, ended, pixels = 8, False, None
    while at + 12 <= len(d):
        (n,) = struct.unpack_from(">I", d, at)
        kind, body = d[at + 4 : at + 8].decode("latin-1"), d[at + 8 : at + 8 + n]
        if at + 12 + n > len(d):
            f.problem(DAMAGE, f"{kind} cut short", at, len(d) - at)
            break
        c = f.node(root, kind, at, 12 + n)
        if zlib.crc32(d[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            f.problem(DAMAGE, f"{kind} checksum differs", at + 8 + n, 4)
        if kind == "IHDR" and n >= 13:
            w, h, depth, color = struct.unpack_from(">IIBB", body)
            pixels = Pixels(w, h, depth, color, body[12])
            for label, value, o, size in (("width", w, 0, 4), ("height", h, 4, 4), ("bit depth", depth, 8, 1), ("color type", color, 9, 1)):
                f.node(c, label, at + 8 + o, size, value)
        elif kind == "tEXt":
            key, _, value = body.partition(b"\0")
            f.node(c, _text(key, "latin-1"), at + 8, n, _text(value, "latin-1"))
            f.fact(PNG_KINDS.get(_text(key, "latin-1"), "description"), _text(value, "latin-1"), c)
        elif kind in ("zTXt", "iTXt"):
            key, _, rest = body.partition(b"\0")
            parts = rest[2:].split(b"\0", 2) if kind == "iTXt" else [rest[1:]]
            value = parts[-1] if len(parts) in (1, 3) else b""
            if kind == "zTXt" or rest[:1] == b"\1":
                got = inflated(value)
                value = got.data
                if got.error:
                    f.problem(DAMAGE, f"{kind} {got.error}", at, n)
                elif not got.whole:
                    f.bound("characters of a text", at, n)
            if key == b"XML:com.adobe.xmp":
                xmp(value, f, c, at + 8)
            else:
                f.fact(PNG_KINDS.get(_text(key), "description"), _text(value), c)
        elif kind == "tIME" and n == 7:
            f.fact("modified", "%04d-%02d-%02d %02d:%02d:%02d" % struct.unpack(">HBBBBB", body), c)
        elif kind == "eXIf":
            tiff(body, f, c, at + 8)
        elif kind == "IDAT":
            if pixels is not None:
                pixels.add(body)
        else:
            png_chunk(kind, body, f, c, at + 8)
        at += 12 + n
        if kind == "IEND":
            ended = True
            break
    if pixels is not None:
        pixels.told(f)
    if not ended:
        f.problem(DAMAGE, "end chunk missing", len(d), 0)
    elif at < len(d):
        f.node(root, "data after the image", at, len(d) - at)
        f.problem(HIDDEN, "data after the image", at, len(d) - at)


def tiff(d: bytes, f: Found, root: int, base: int = 0) -> None:
    order = {b"II": "<", b"MM": ">"}.get(d[:2])
    if order is None or len(d) < 8:
        f.problem(DAMAGE, "TIFF header damaged", base, min(8, len(d)))
        return
    todo, seen, where = [(struct.unpack_from(order + "I", d, 4)[0], "IFD")], set(), {}
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    while todo:
        at, label = todo.pop(0)
        if at in seen or at == 0:
            continue
        seen.add(at)
        if at + 2 > len(d):
            f.problem(DAMAGE, f"{label} out of the file", base + min(at, len(d)), 0)
            continue
        (n,) = struct.unpack_from(order + "H", d, at)
        c = f.node(root, label, base + at, min(2 + 12 * n, len(d) - at))
        for i in range(n):
            e = at + 2 + 12 * i
            if e + 12 > len(d):
                f.problem(DAMAGE, f"{label} cut short", base + at, len(d) - at)
                break
            tag, kind, count = struct.unpack_from(order + "HHI", d, e)
            length = size.get(kind, 1) * count
            o = e + 8 if length <= 4 else struct.unpack_from(order + "I", d, e + 8)[0]
            body = d[o : o + length]
            node = f.node(c, f"tag {tag:04x}", base + e, 12)
            if tag in TIFF_TAGS and kind == 2:
                f.fact(TIFF_TAGS[tag][0], _text(body), node)
            elif tag in (0x8769, 0x8825):
                todo.append((struct.unpack_from(order + "I", d, e + 8)[0], "Exif" if tag == 0x8769 else "GPS"))
            elif label == "GPS" and tag in (1, 3):
                where[tag] = _text(body)[:1]
            elif label == "GPS" and tag in (2, 4) and len(body) >= 24:
                v = struct.unpack(order + "6I", body[:24])
                where[tag] = sum((v[2 * j] / v[2 * j + 1] if v[2 * j + 1] else 0) / 60**j for j in range(3))
        end = at + 2 + 12 * n
        if label == "IFD" and end + 4 <= len(d):
            todo.append((struct.unpack_from(order + "I", d, end)[0], "IFD"))
    if {2, 4} <= where.keys():
        lat = where[2] * (-1 if where.get(1) == "S" else 1)
        lon = where[4] * (-1 if where.get(3) == "W" else 1)
        f.fact("location", f"{lat:.5f}, {lon:.5f}", root)


def jpeg(d: bytes, f: Found, root: int) -> None:
    at, parts = 2, {}
    f.node(root, "SOI", 0, 2)
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            f.problem(DAMAGE, "marker expected", at, 1)
            return
        mark = d[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        (n,) = struct.unpack_from(">H", d, at + 2)
        if n < 2 or at + 2 + n > len(d):
            f.problem(DAMAGE, "segment cut short", at, len(d) - at)
            return
        body = d[at + 4 : at + 2 + n]
        c = f.node(root, f"marker {mark:02x}", at, 2 + n)
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            tiff(body[6:], f, c, at + 10)
        elif mark == 0xE1 and body[:29] == b"http://ns.adobe.com/xap/1.0/\0":
            xmp(body[29:], f, c, at + 33)
        elif mark == 0xED and body[:14] == b"Photoshop 3.0\0":
            captions(body[14:], f, c, at + 18)
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14:
            parts[body[12]] = (at + 18, body[14:])
            if len(parts) == body[13]:
                profile(b"".join(parts[i][1] for i in sorted(parts)), f, c, parts[min(parts)][0])
        elif mark == 0xE2 and body[:4] == b"MPF\0":
            more = body.count(b"\0\3\0\0", 4)
            f.node(c, "further pictures", at + 4, n, more)
            f.fact("embedded", "further pictures", c)
        elif mark == 0xEB and b"c2pa" in body:
            f.fact("credentials", "content credentials", c)
        elif mark == 0xFE:
            f.fact("comments", _text(body), c)
        elif 0xC0 <= mark <= 0xC3 and len(body) >= 5:
            h, w = struct.unpack_from(">HH", body, 1)
            f.node(c, "size", at + 5, 4, f"{w}x{h}")
        at += 2 + n
        if mark == 0xDA:
            end = d.find(b"\xff\xd9", at)
            f.node(root, "scan", at, (end if end >= 0 else len(d)) - at)
            at = end if end >= 0 else len(d)
    if d[at : at + 2] != b"\xff\xd9":
        f.problem(DAMAGE, "end marker missing", len(d), 0)
    else:
        f.node(root, "EOI", at, 2)
        if at + 2 < len(d):
            f.node(root, "data after the image", at + 2, len(d) - at - 2)
            f.problem(HIDDEN, "data after the image", at + 2, len(d) - at - 2)


def gif(d: bytes, f: Found, root: int) -> None:
    if len(d) < 13:
        f.problem(DAMAGE, "header cut short", 0, len(d))
        return
    w, h, flags = struct.unpack_from("<HHB", d, 6)
    f.node(f.node(root, "header", 0, 13), "size", 6, 4, f"{w}x{h}")
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(at: int) -> tuple[int, bytes]:
        out = bytearray()
        while at < len(d) and d[at]:
            out += d[at + 1 : at + 1 + d[at]]
            at += 1 + d[at]
        return at + 1, bytes(out)

    while at < len(d):
        if d[at] == 0x3B:
            f.node(root, "trailer", at, 1)
            if at + 1 < len(d):
                f.problem(HIDDEN, "data after the image", at + 1, len(d) - at - 1)
            return
        if d[at] == 0x21:
            end, body = blocks(at + 2)
            c = f.node(root, f"extension {d[at + 1] if at + 1 < len(d) else 0:02x}", at, min(end, len(d)) - at)
            if d[at + 1 : at + 2] == b"\xfe":
                f.fact("comments", _text(body), c)
            at = end
        elif d[at] == 0x2C and at + 10 <= len(d):
            flags = d[at + 9]
            end, _ = blocks(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            f.node(root, "image", at, min(end, len(d)) - at)
            at = end
        else:
            break
    f.problem(DAMAGE, "trailer missing", min(at, len(d)), 0)


def riff(d: bytes, f: Found, root: int) -> None:
    order = ">" if d[:4] == b"RIFX" else "<"
    at = 12

    def walk(at: int, end: int, parent: int) -> None:
        while at + 8 <= end:
            name = d[at : at + 4].decode("latin-1")
            (n,) = struct.unpack_from(order + "I", d, at + 4)
            if n == 0xFFFFFFFF and name == "data" and wide:
                n = wide[1]
            if at + 8 + n > end:
                f.problem(DAMAGE, f"{name.strip()} cut short", at, end - at)
                n = end - at - 8
            c = f.node(parent, name.strip(), at, 8 + n)
            body = d[at + 8 : at + 8 + n]
            if name == "LIST":
                walk(at + 12, at + 8 + n, c)
            elif name in INFO_KINDS:
                f.fact(INFO_KINDS[name], _text(body, "latin-1"), c)
            elif name == "bext" and n >= 346:
                for kind, a, b in (("description", 0, 256), ("originator", 256, 288), ("broadcast-reference", 288, 320), ("created", 320, 338)):
                    f.fact(kind, _text(body[a:b], "latin-1"), c)
            elif name in ("XMP ", "_PMX"):
                xmp(body, f, c, at + 8)
            elif name == "ICCP":
                profile(body, f, c, at + 8)
            elif name == "EXIF":
                tiff(body[6:] if body[:6] == b"Exif\0\0" else body, f, c, at + 8)
            at += 8 + n + (n & 1)

    total = struct.unpack_from(order + "I", d, 4)[0] + 8 if len(d) >= 8 else 0
    # of RF64 and BW64 files the sizes stand in a chunk of their own
    wide = struct.unpack_from("<QQ", d, 20) if d[:4] in (b"RF64", b"BW64") and d[12:16] == b"ds64" and len(d) >= 36 else None
    total = wide[0] + 8 if wide else total
    walk(at, min(total, len(d)), root)
    if total > len(d):
        f.problem(DAMAGE, "cut short", len(d), 0)
    elif total < len(d):
        f.problem(HIDDEN, "data after the end", total, len(d) - total)


_BOXES = {"moov", "trak", "mdia", "minf", "stbl", "udta", "ilst", "edts", "dinf", "iprp", "ipco"}


def boxes(d: bytes, f: Found, root: int) -> None:
    def walk(at: int, end: int, parent: int, depth: int) -> None:
        while at + 8 <= end:
            (n,) = struct.unpack_from(">I", d, at)
            name, head = d[at + 4 : at + 8].decode("latin-1"), 8
            if n == 1 and at + 16 <= end:
                (n,), head = struct.unpack_from(">Q", d, at + 8), 16
            n = n or end - at
            if n < head or at + n > end:
                f.problem(DAMAGE, f"{name} cut short", at, end - at)
                return
            c = f.node(parent, name, at, n)
            body = d[at + head : at + n]
            if name in _BOXES and depth < 16:
                walk(at + head, at + n, c, depth + 1)
            elif name == "meta" and depth < 16:
                walk(at + head + 4, at + n, c, depth + 1)
                if depth == 0:
                    heif_items(d, (at + head + 4, at + n), f, c)
            elif name == "mvhd" and len(body) >= 8:
                made = struct.unpack_from(">Q" if body[0] == 1 else ">I", body, 4)[0] - 2_082_844_800
                if 0 < made < 1 << 33:
                    f.fact("created", f"{datetime.fromtimestamp(made, UTC):%Y-%m-%d %H:%M:%S}", c)
            elif name == "\xa9xyz":
                f.fact("location", _text(body[4:]), c)
            elif name in MOVIE_KINDS:
                f.fact(MOVIE_KINDS[name], _text(body[16:] if body[4:8] == b"data" else body[4:]), c)
            elif name == "uuid" and body[:16].hex() == "be7acfcb97a942e89c71999491e3afac":
                xmp(body[16:], f, c, at + head + 16)
            at += n
        if at < end:
            f.problem(DAMAGE, "box cut short", at, end - at)

    walk(0, len(d), root, 0)


def archive(d: bytes, f: Found, root: int) -> None:
    from gleanery.sources import office
    from gleanery.sources.archive import checked, entries

    rows, end, trouble = entries(d)
    for concern, label, at, n in trouble + checked(rows):
        f.problem(concern, label, at, n)
        f.complete &= not label.endswith("larger than what is made sure of")
    nodes = {}
    for e in rows:
        nodes[e["name"]] = c = f.node(root, e["name"], e["offset"], e["span"])
        f.node(c, "size", e["offset"], 0, e["size"])
    if any(e["locked"] for e in rows):
        f.fact("encryption", "locked members", root)
    office.facts(rows, nodes, f)
    f.node(root, "directory", end, max(0, len(d) - end))


def ogg(d: bytes, f: Found, root: int) -> None:
    at, body, cut = 0, bytearray(), False
    while at + 27 <= len(d) and d[at : at + 4] == b"OggS":
        n = d[at + 26]
        size = 27 + n + sum(d[at + 27 : at + 27 + n])
        if at + size > len(d):
            f.problem(DAMAGE, "page cut short", at, len(d) - at)
            break
        page = bytearray(d[at : at + size])
        page[22:26] = b"\0\0\0\0"
        if _ogg_sum(page) != struct.unpack_from("<I", d, at + 22)[0]:
            f.problem(DAMAGE, "page checksum differs", at + 22, 4)
        f.node(root, "page", at, size)
        if len(body) < 1 << 24:
            body += d[at + 27 + n : at + size]
        elif not cut:
            cut = True  # comments stand in the first packets
        at += size
    if at < len(d) and f.complete:
        f.problem(HIDDEN, "data after the end", at, len(d) - at)
    for mark in (b"\x03vorbis", b"OpusTags"):
        i = bytes(body).find(mark)
        if i >= 0:
            _comments(bytes(body[i + len(mark) :]), f, root)


#: Sums of one byte under the polynomial 0x04c11db7, not reflected.
_OGG: list[int] = []


def _ogg_sum(page: bytes) -> int:
    if not _OGG:
        for i in range(256):
            r = i << 24
            for _ in range(8):
                r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
            _OGG.append(r & 0xFFFFFFFF)
    c = 0
    for b in page:
        c = ((c << 8) & 0xFFFFFFFF) ^ _OGG[(c >> 24) ^ b]
    return c


def _comments(b: bytes, f: Found, node: int) -> None:
    try:
        at = 4 + struct.unpack_from("<I", b)[0]
        f.fact("encoder", _text(b[4:at]), node)
        (n,), at = struct.unpack_from("<I", b, at), at + 4
        for _ in range(n):
            (size,), at = struct.unpack_from("<I", b, at), at + 4
            key, _, value = b[at : at + size].partition(b"=")
            f.fact(COMMENT_KINDS.get(_text(key).upper(), "audio-tag"), _text(value), node)
            at += size
    except struct.error:
        f.problem(DAMAGE, "comments cut short", 0, 0)


def flac(d: bytes, f: Found, root: int) -> None:
    at, last = 4, False
    while not last:
        if at + 4 > len(d):
            f.problem(DAMAGE, "block cut short", at, len(d) - at)
            return
        last, kind, n = bool(d[at] & 0x80), d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if at + 4 + n > len(d):
            f.problem(DAMAGE, "block cut short", at, len(d) - at)
            return
        c = f.node(root, f"block {kind}", at, 4 + n)
        if kind == 4:
            _comments(d[at + 4 : at + 4 + n], f, c)
        at += 4 + n
    f.node(root, "frames", at, len(d) - at)


def mp3(d: bytes, f: Found, root: int) -> None:
    at = 0
    if d[:3] == b"ID3" and len(d) >= 10:
        size = sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(d[6:10]))
        tag = f.node(root, "ID3v2", 0, 10 + size)
        if 10 + size > len(d):
            f.problem(DAMAGE, "tag cut short", 0, len(d))
        at, end = 10, min(10 + size, len(d))
        while d[3] == 2 and at + 6 <= end and d[at]:
            name, n = d[at : at + 3].decode("latin-1"), int.from_bytes(d[at + 3 : at + 6], "big")
            c = f.node(tag, name, at, 6 + n)
            body = d[at + 6 : at + 6 + n]
            if name in OLD_ID3 and body:
                f.fact(OLD_ID3[name], _text(body[1:], "utf-16" if body[0] == 1 else "latin-1"), c)
            at += 6 + n
        while d[3] > 2 and at + 10 <= end and d[at]:
            name = d[at : at + 4].decode("latin-1")
            n = int.from_bytes(d[at + 4 : at + 8], "big") if d[3] < 4 else sum((b & 0x7F) << 7 * (3 - i) for i, b in enumerate(d[at + 4 : at + 8]))
            c = f.node(tag, name, at, 10 + n)
            body = d[at + 10 : at + 10 + n]
            if name in ID3_KINDS and body:
                text = body[4:].split(b"\0")[-1] if name == "COMM" else body[1:]
                f.fact(ID3_KINDS[name], _text(text, {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")), c)
            elif name[:1] == "T":
                f.fact("audio-tag", _text(body[1:]), c)
            at += 10 + n
        at = end
    if d[-128:-125] == b"TAG":
        c = f.node(root, "ID3v1", len(d) - 128, 128)
        for kind, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            f.fact(kind, _text(d[-128:][a:b], "latin-1"), c)
    tail = len(d) - (128 if d[-128:-125] == b"TAG" else 0)
    if d[tail - 32 : tail - 24] == b"APETAGEX":
        size, n = struct.unpack_from("<II", d, tail - 20)
        start = max(0, tail - size)
        c, o = f.node(root, "APE tag", start, tail - start), start
        for _ in range(n):
            if o + 8 > tail - 32:
                break
            (length,) = struct.unpack_from("<I", d, o)
            name, _, _ = d[o + 8 : o + 264].partition(b"\0")
            value = d[o + 9 + len(name) : o + 9 + len(name) + length]
            f.fact(COMMENT_KINDS.get(_text(name).upper(), "audio-tag"), _text(value), c)
            o += 9 + len(name) + length
    f.node(root, "frames", at, len(d) - at)


def wasm(d: bytes, f: Found, root: int) -> None:
    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while at < len(d):
            out |= (d[at] & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if not d[at - 1] & 0x80:
                break
        return out, at

    at = 8
    while at < len(d):
        kind = d[at]
        n, body = number(at + 1)
        if body + n > len(d) or kind > 13:
            f.problem(DAMAGE, "section cut short", at, len(d) - at)
            return
        c = f.node(root, f"section {kind}", at, body + n - at)
        if kind == 0:
            size, a = number(body)
            name = _text(d[a : a + size])
            f.node(c, "name", a, size, name)
            if name == "name":
                f.fact("names", "function names", c)
            elif name == "sourceMappingURL":
                m, b = number(a + size)
                f.fact("sourcemap", _text(d[b : b + m]), c)
            elif name.startswith(".debug"):
                f.fact("debug", name, c)
            elif name == "producers":
                fields, b = number(a + size)
                for _ in range(fields):
                    k, b = number(b)
                    field_, b = _text(d[b : b + k]), b + k
                    many, b = number(b)
                    for _ in range(many):
                        k, b = number(b)
                        what, b = _text(d[b : b + k]), b + k
                        k, b = number(b)
                        f.fact({"language": "language", "sdk": "sdk"}.get(field_, "toolchain"), f"{what} {_text(d[b : b + k])}", c)
                        b += k
        elif kind == 2:
            many, b = number(body)
            mods: dict[str, int] = {}
            for _ in range(many):
                k, b = number(b)
                mod, b = _text(d[b : b + k]), b + k
                k, b = number(b)
                what, b = _text(d[b : b + k]), b + k
                f.node(c, f"{mod}.{what}", b, 1)
                mods[mod] = mods.get(mod, 0) + 1
                if b >= len(d) or d[b] > 3:
                    break
                if d[b] == 0:
                    _, b = number(b + 1)
                elif d[b] == 3:
                    b += 3
                else:
                    b += 2 if d[b] == 1 else 1
                    limits, (_, b) = d[b] if b < len(d) else 0, number(b + 1)
                    b = number(b)[1] if limits & 1 else b
            for mod, k in mods.items():
                f.fact("imports", f"{k} of {mod}", c)
        at = body + n


def pdf(d: bytes, f: Found, root: int) -> None:
    from gleanery.sources.pdf import read

    read(d, f, root)


def rtf(d: bytes, f: Found, root: int) -> None:
    depth = 0
    for m in re.finditer(rb"\\[\\{}]|[{}]", d):
        depth += {b"{": 1, b"}": -1}.get(m[0], 0)
        if depth < 0:
            break
    if depth:
        f.problem(DAMAGE, "groups do not close", len(d), 0)
    for key, kind in RTF_KINDS.items():
        m = re.search(rb"\{\\" + key.encode() + rb"[ \r\n]([^{}]*)\}", d)
        if m:
            f.fact(kind, _text(re.sub(rb"\\'([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), m[1]), "cp1252"), f.node(root, key, m.start(), len(m[0])))
    for key, kind in (("creatim", "created"), ("revtim", "modified")):
        m = re.search(rb"\{\\" + key.encode() + rb"\\yr(\d+)\\mo(\d+)\\dy(\d+)(?:\\hr(\d+))?(?:\\min(\d+))?", d)
        if m:
            v = [int(x or 0) for x in m.groups()]
            f.fact(kind, "%04d-%02d-%02d %02d:%02d" % tuple(v), f.node(root, key, m.start(), len(m[0])))
    if re.search(rb"\\deleted\b", d):
        f.fact("deleted", "deleted text", root)
    if re.search(rb"\\revised\b|\\revtbl\b", d):
        f.fact("tracked", "tracked changes", root)
    m = re.search(rb"\{\\\*\\template ([^{}]*)\}", d)
    if m:
        f.fact("template", _text(m[1]), root)


def eml(d: bytes, f: Found, root: int) -> None:
    from gleanery.sources.mail import read

    read(d, f, root)


def svg(d: bytes, f: Found, root: int) -> None:
    if d[:2] == b"\x1f\x8b":
        got = inflated(d, 31)
        if got.error:
            f.problem(DAMAGE, f"picture {got.error}", 0, len(d))
        elif not got.whole:
            f.bound("bytes of a picture", 0, len(d))
        d = got.data
    t = d.decode("utf-8", "replace")
    if "</svg>" not in t and not re.search(r"<svg[^>]*/>", t):
        f.problem(DAMAGE, "svg element does not close", len(d), 0)
    for tag, kind in (("title", "title"), ("desc", "description"), ("dc:creator", "author"), ("dc:date", "created"), ("dc:description", "description")):
        for m in re.finditer(rf"<{tag}\b[^>]*>(.*?)</{tag}>", t, re.S):
            f.fact(kind, re.sub(r"<[^>]*>", "", m[1]), f.node(root, tag, len(t[: m.start()].encode()), len(m[0].encode())))
    for m in re.finditer(r"<!--\s*(?:Created with|Generator:)\s*(.*?)\s*-->", t, re.S):
        f.fact("software", m[1], root)
    for m in re.finditer(r"""(?:sodipodi:docname|inkscape:export-filename)=["']([^"']+)["']""", t):
        f.fact("original", m[1], root)
    if re.search(r"(?i)<script\b|\bon\w+\s*=", t):
        f.problem(HIDDEN, "script in a picture", 0, 0)
    for m in re.finditer(r"""(?:xlink:)?href=["'](data:image/[^"']{0,40})""", t):
        f.fact("embedded", m[1].split(";")[0], root)


def cfb(d: bytes, f: Found, root: int) -> None:
    from gleanery.sources.compound import read

    read(d, f, root)


class _Tree(HTMLParser):
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self, f: Found, root: int, lines: list[int]) -> None:
        super().__init__(convert_charrefs=False)
        self.f, self.stack, self.lines = f, [(root, "")], lines

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        n = self.f.node(self.stack[-1][0], tag, self._at(), len(self.get_starttag_text() or ""))
        if tag not in self.VOID:
            self.stack.append((n, tag))

    def handle_startendtag(self, tag, attrs):
        self.f.node(self.stack[-1][0], tag, self._at(), len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                return

    def handle_comment(self, data):
        self.f.node(self.stack[-1][0], "#comment", self._at(), len(data) + 7)


def html(d: bytes, f: Found, root: int) -> None:
    t = d.decode("utf-8", "replace")
    lines = [0, *(m.end() for m in re.finditer("\n", t))]
    p = _Tree(f, root, lines)
    p.feed(t)
    p.close()


def text(d: bytes, f: Found, root: int) -> None:
    """Accounts and addresses of bytes of no known format, in ASCII and UTF-16."""
    from gleanery.functions.dims import NOT_DOMAINS, NOT_PEOPLE

    known = next((name for mark, name in FAMILIAR if d.startswith(mark)), None)
    plain = not re.search(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]", d[:65_536])
    f.node(root, "kind", 0, 0, known or ("empty" if not d else "text" if plain else "binary"))
    seen: dict[str, dict[str, str]] = {"account": {}, "emails": {}}
    for t in (d.decode("latin-1"), d.decode("utf-16-le", "replace") if b"\0" in d[:4096] else ""):
        for m in re.finditer(r"(?:/Users/|/home/)([A-Za-z0-9._ -]{1,64})/|\\Users\\([A-Za-z0-9._ -]{1,64})\\", t):
            name = m[1] or m[2]
            if name.lower() not in NOT_PEOPLE:
                seen["account"].setdefault(name.lower(), name)
        for m in re.finditer(r"([A-Za-z0-9._%+-]{1,64})@([A-Za-z0-9.-]{1,128})", t):
            name, host = m[1].lstrip(".-+"), m[2].rstrip(".-")
            top = host.rpartition(".")[2]
            ok = re.search("[A-Za-z]", name) and "." in host and re.fullmatch("[A-Za-z]{2,}", top) and top.lower() not in NOT_DOMAINS
            if ok and name != "git" and not host.endswith("example.com"):
                seen["emails"].setdefault(f"{name}@{host}".lower(), f"{name}@{host}")
    for kind, found in seen.items():
        if found:
            names = list(found.values())
            f.fact(kind, ", ".join(names[:4]) + (f" and {len(names) - 4} more" if len(names) > 4 else ""), root)


DECODERS = {
    "png": png, "jpeg": jpeg, "gif": gif, "webp": riff, "wav": riff, "tiff": tiff, "heif": boxes, "video": boxes, "zip": archive, "ogg": ogg, "flac": flac,
    "mp3": mp3, "wasm": wasm, "pdf": pdf, "rtf": rtf, "eml": eml, "svg": svg, "cfb": cfb, "html": html, "unknown": text,
}


def decode(content: bytes | None, format_: str, most: int = MOST_NODES) -> Found:
    d = content or b""
    f = Found(most=most)
    root = f.node(None, format_, 0, len(d))
    try:
        DECODERS.get(format_, text)(d, f, root)
    except Exception as e:  # noqa: BLE001  a decoder's own fault is a finding, not the end of a task
        f.problem(DAMAGE, f"decoder stopped: {type(e).__name__}", 0, len(d))
    return f
