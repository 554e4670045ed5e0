"""Clean copies of formats whose parts point at each other: what gives something away is blanked where it stands, so every offset holds."""

from __future__ import annotations

import re
import struct
import zlib

from gleanery.sources.rewrite import Refused, Removed


class Blanked:
    """Bytes being blanked in place, with what was taken away."""

    def __init__(self, d: bytes) -> None:
        self.d, self.gone = bytearray(d), []

    def fill(self, label: str, start: int, length: int, with_: bytes = b"\0") -> None:
        old = bytes(self.d[start : start + length])
        if old and old != with_ * len(old):
            self.d[start : start + length] = with_ * len(old)
            self.gone.append((label, len(old)))

    def done(self) -> tuple[bytes, Removed]:
        return bytes(self.d), self.gone


def tiff(d: bytes) -> tuple[bytes, Removed]:
    """Texts of known tags and the place blanked; entries stay."""
    from gleanery.sources.decode import TIFF_TAGS

    order, b = {b"II": "<", b"MM": ">"}.get(d[:2]), Blanked(d)
    if order is None or len(d) < 8:
        raise Refused("damaged")
    todo, seen = [(struct.unpack_from(order + "I", d, 4)[0], "main")], set()
    while todo:
        at, kind = todo.pop()
        if not at or at in seen:
            continue
        seen.add(at)
        if at + 2 > len(d):
            raise Refused("damaged")
        (n,) = struct.unpack_from(order + "H", d, at)
        if at + 2 + 12 * n > len(d):
            raise Refused("damaged")
        for i in range(n):
            e = at + 2 + 12 * i
            tag, form, count = struct.unpack_from(order + "HHI", d, e)
            value = struct.unpack_from(order + "I", d, e + 8)[0]
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(form, 1) * count
            where = e + 8 if size <= 4 else value
            if tag in (0x8769, 0x8825):
                todo.append((value, "Exif" if tag == 0x8769 else "GPS"))
            if kind == "GPS":
                b.fill("GPS", where, size)
            elif tag in TIFF_TAGS and form == 2:
                b.fill(TIFF_TAGS[tag][1], where, size)
            elif tag in (0x02BC, 0x83BB, 0x927C):
                b.fill({0x02BC: "XMP", 0x83BB: "IPTC", 0x927C: "maker notes"}[tag], where, size, b" " if tag == 0x02BC else b"\0")
        if kind == "GPS":
            b.d[at : at + 2] = b"\0\0"  # no entries: no place
        end = at + 2 + 12 * n
        if kind == "main" and end + 4 <= len(d):
            todo.append((struct.unpack_from(order + "I", d, end)[0], "main"))
    return b.done()


def movie(d: bytes) -> tuple[bytes, Removed]:
    """Boxes that describe the movie become free space of their size; its times are zero."""
    from gleanery.sources.decode import _BOXES

    b = Blanked(d)

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            (n,), name, head = struct.unpack_from(">I", d, at), d[at + 4 : at + 8].decode("latin-1"), 8
            if n == 1 and at + 16 <= end:
                (n,), head = struct.unpack_from(">Q", d, at + 8), 16
            n = n or end - at
            if n < head or at + n > end:
                raise Refused("damaged")
            if name in ("udta", "meta", "uuid") and n > head:
                b.fill(name, at + head, n - head)
                b.d[at + 4 : at + 8] = b"free"
            elif name in ("mvhd", "tkhd", "mdhd") and n > head + 20:
                b.fill("times", at + head + 4, 16 if d[at + head] == 1 else 8)
            elif name in _BOXES:
                walk(at + head, at + n)
            at += n

    walk(0, len(d))
    return b.done()


def heif(d: bytes) -> tuple[bytes, Removed]:
    """Data of Exif and XMP items blanked; Exif becomes one without entries."""
    from gleanery.sources.decode import decode

    b, found = Blanked(d), decode(d, "heif")
    if not found.complete:
        raise Refused("damaged")
    for _, _, label, start, length, _ in found.nodes:
        if re.fullmatch(r"item \d+ · (Exif|mime)", label) and 0 < start and start + length <= len(d):
            exif = label.endswith("Exif")
            b.fill(label, start, length, b"\0" if exif else b" ")
            if exif and length >= 18:
                b.d[start : start + 18] = b"\0\0\0\0II*\0\x08\0\0\0\0\0\0\0\0\0"
    return b.done()


def wasm(d: bytes) -> tuple[bytes, Removed]:
    """Custom sections dropped, but for those that linkers need."""
    from gleanery.sources.decode import decode

    found, out, gone = decode(d, "wasm"), bytearray(d[:8]), []
    if not found.complete:
        raise Refused("damaged")
    names = {p: v for _, p, label, _, _, v in found.nodes if label == "name"}
    for n, parent, label, start, length, _ in found.nodes:
        if parent != 0 or not label.startswith("section"):
            continue
        name = names.get(n)
        if name is None or name in ("dylink.0", "linking") or name.startswith("reloc."):
            out += d[start : start + length]
        else:
            gone.append((f"custom section {name}", length))
    return bytes(out), gone


def ogg(d: bytes) -> tuple[bytes, Removed]:
    """Comments of the first streams blanked letter by letter, page sums made right."""
    from gleanery.sources.decode import _ogg_sum, decode

    if not decode(d, "ogg").complete:
        raise Refused("damaged")
    spans, at, where, body = [], 0, [], bytearray()
    while at + 27 <= len(d) and d[at : at + 4] == b"OggS":
        n = d[at + 26]
        size = 27 + n + sum(d[at + 27 : at + 27 + n])
        spans.append((at, size))
        where += range(at + 27 + n, at + size) if len(body) < 1 << 24 else ()
        body += d[at + 27 + n : at + size] if len(body) < 1 << 24 else b""
        at += size
    out, gone = bytearray(d), []
    for mark in (b"\x03vorbis", b"OpusTags"):
        i = bytes(body).find(mark)
        if i < 0:
            continue
        try:
            o = i + len(mark)
            (n,) = struct.unpack_from("<I", body, o)
            fields, o = [(o + 4, n)], o + 4 + n
            (count,), o = struct.unpack_from("<I", body, o), o + 4
            for _ in range(count):
                (n,) = struct.unpack_from("<I", body, o)
                fields.append((o + 4, n))
                o += 4 + n
        except struct.error as e:
            raise Refused("damaged") from e
        for start, n in fields:
            if n:
                gone.append(("comments", n))
            for k in range(start, start + n):
                out[where[k]] = 0x20
    for at, size in spans:
        out[at + 22 : at + 26] = b"\0\0\0\0"
        out[at + 22 : at + 26] = struct.pack("<I", _ogg_sum(out[at : at + size]))
    return bytes(out), gone


def compound(d: bytes) -> tuple[bytes, Removed]:
    """Values of the property sets blanked where they stand."""
    from gleanery.sources.compound import located

    b = Blanked(d)
    for name, places in located(d).items():
        text = bytes(d[p] for p in places)
        try:
            at = struct.unpack_from("<I", text, 44)[0]
            for i in range(min(struct.unpack_from("<I", text, at + 4)[0], 1_000)):
                key, o = struct.unpack_from("<II", text, at + 8 + 8 * i)
                form, n = struct.unpack_from("<II", text, at + o)
                size = n * (2 if form == 31 else 1) if form in (30, 31) else 8 if form == 64 else 0
                start = at + o + (8 if form in (30, 31) else 4)
                old = text[start : start + size]
                if key > 1 and old.strip(b"\0"):
                    for p in places[start : start + size]:
                        b.d[p] = 0
                    b.gone.append((f"{name.strip(chr(5))} {key}", len(old)))
        except (struct.error, IndexError) as e:
            raise Refused("damaged") from e
    return b.done()


_STRING = rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)"


def pdf(d: bytes) -> tuple[bytes, Removed]:
    """Values of the information dictionary blanked, metadata streams replaced by blank ones of their length; earlier revisions go
    the same way. A locked or signed file is left alone."""
    from gleanery.sources.pdf import INFO

    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", d):
        raise Refused("locked")
    if b"/ByteRange" in d:
        raise Refused("signed")
    if not re.search(rb"%%EOF", d):
        raise Refused("damaged")
    b = Blanked(d)
    numbers = {int(n) for n in re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", d)}
    for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b(.*?)\bendobj", d, re.S):
        if int(m[1]) in numbers:
            for key in INFO:
                for s in re.finditer(rb"/" + key.encode() + rb"\s*" + _STRING, m[2], re.S):
                    b.fill(key, m.start(2) + s.start(1) + 1, len(s[1]) - 2, b"0" if s[1][:1] == b"<" else b" ")
        elif re.search(rb"/Type\s*/Metadata", m[2][:2048]):
            s = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", m[2], re.S)
            if s and b"/FlateDecode" in m[2][: s.start()]:
                blank = zlib.compress(b" ")
                b.fill("XMP metadata", m.start(2) + s.start(1), len(s[1]))
                b.d[m.start(2) + s.start(1) : m.start(2) + s.start(1) + len(blank)] = blank if len(blank) <= len(s[1]) else b""
            elif s:
                b.fill("XMP metadata", m.start(2) + s.start(1), len(s[1]), b" ")
    for m in re.finditer(rb"/ID\s*\[\s*(<[0-9A-Fa-f]*>)\s*(<[0-9A-Fa-f]*>)\s*\]", d):
        for i in (1, 2):
            b.fill("ID", m.start(i) + 1, len(m[i]) - 2, b"0")
    return b.done()


#: By format; those that ``rewrite`` has of its own are not repeated.
MORE = {"tiff": tiff, "video": movie, "heif": heif, "wasm": wasm, "ogg": ogg, "cfb": compound, "pdf": pdf}
