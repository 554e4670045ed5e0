"""What pictures carry besides their pixels: profiles, XMP, captions, further pictures, items of a container; and whether the pixels are all there."""

from __future__ import annotations

import re
import struct
import zlib

from gleanery.sources.unpack import inflated

#: Bytes of a colour profile, and entries of its table.
MOST_PROFILE, MOST_TAGS = 1 << 24, 256

# Properties of XMP, record numbers of captions, by the kind of finding they make.
XMP = {
    "xmp:CreatorTool": "software", "tiff:Software": "software", "xmp:CreateDate": "created", "photoshop:DateCreated": "created", "xmp:ModifyDate": "modified",
    "dc:creator": "author", "dc:title": "title", "dc:description": "description", "dc:rights": "copyright", "dc:subject": "keywords", "tiff:Make": "camera",
    "tiff:Model": "camera", "aux:SerialNumber": "serial", "aux:Lens": "lens", "exif:DateTimeOriginal": "taken", "photoshop:City": "place", "photoshop:Country": "place",
    "photoshop:Headline": "caption", "xmpMM:OriginalDocumentID": "original", "xmp:Label": "label",
}
CAPTION = {5: "title", 25: "keywords", 40: "notes", 55: "created", 80: "author", 90: "place", 101: "place", 105: "caption", 115: "original", 116: "copyright", 120: "description"}
#: Bands in which an interlaced PNG sends its pixels: first column and row, steps. Fixed values of the format.
BANDS = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def xmp(packet: bytes, f, node: int, at: int) -> None:
    """Properties as attributes or elements, lists joined; edits of a history counted."""
    t = packet.decode("utf-8", "replace")
    f.node(node, "XMP", at, len(packet))
    for name, kind in XMP.items():
        m = re.search(rf"""\s{name}=["']([^"']*)["']""", t) or re.search(rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", t)
        if m:
            items = re.findall(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>", m[1]) or [m[1]]
            f.fact(kind, ", ".join(re.sub(r"<[^>]*>", "", x).strip() for x in items), node)
    edits = len(re.findall(r"stEvt:action", t))
    if edits:
        f.fact("history", f"{edits} steps", node)
    if "c2pa" in t:
        f.fact("credentials", "content credentials", node)


def captions(body: bytes, f, node: int, at: int) -> None:
    """Image resources (``8BIM``), and the caption records among them."""
    o = 0
    while body[o : o + 4] == b"8BIM" and o + 12 <= len(body):
        number, name = struct.unpack_from(">HB", body, o + 4)
        start = o + 6 + (name + 2 & ~1)
        if start + 4 > len(body):
            return f.problem("damage", "image resource cut short", at + o, len(body) - o)
        (size,) = struct.unpack_from(">I", body, start)
        data = body[start + 4 : start + 4 + size]
        c = f.node(node, f"resource {number:04x}", at + o, min(len(body) - o, start + 4 + size - o))
        i = 0
        while number == 0x0404 and i + 5 <= len(data) and data[i] == 0x1C:
            (n,) = struct.unpack_from(">H", data, i + 3)
            if data[i + 1] == 2 and data[i + 2] in CAPTION:
                f.fact(CAPTION[data[i + 2]], data[i + 5 : i + 5 + n].decode("utf-8", "replace"), c)
            i += 5 + n
        o = start + 4 + (size + 1 & ~1)


def profile(data: bytes, f, node: int, at: int) -> None:
    """A colour profile's header, table and texts."""
    if len(data) < 132 or data[36:40] != b"acsp":
        return f.problem("damage", "colour profile damaged", at, len(data))
    if len(data) > MOST_PROFILE:
        return f.bound("colour profile", at, len(data))
    c = f.node(node, "colour profile", at, len(data), f"{data[12:16].decode('latin-1').strip()} {data[16:20].decode('latin-1').strip()}")
    if struct.unpack_from(">I", data)[0] != len(data):
        f.problem("oddity", "colour profile of another size than it says", at, 4)
    (n,) = struct.unpack_from(">I", data, 128)
    for i in range(min(n, MOST_TAGS, (len(data) - 132) // 12)):
        name, o, size = struct.unpack_from(">4sII", data, 132 + 12 * i)
        if o + size > len(data):
            f.problem("damage", f"profile entry {name.decode('latin-1')} out of the profile", at + 132 + 12 * i, 12)
            continue
        body = data[o : o + size]
        said = None
        if body[:4] in (b"text", b"desc") and size > 12:
            said = (body[8:] if body[:4] == b"text" else body[12 : 12 + struct.unpack_from(">I", body, 8)[0]]).split(b"\0")[0].decode("latin-1")
        elif body[:4] == b"mluc" and size >= 28:
            length, where = struct.unpack_from(">II", body, 20)
            said = body[where : where + length].decode("utf-16-be", "replace")
        f.node(c, name.decode("latin-1"), at + o, size, said)
        if said and name == b"cprt":
            f.fact("copyright", said, c)
    if n > MOST_TAGS:
        f.bound("entries of a colour profile", at, len(data))


class Pixels:
    """Image data of a PNG, unpacked as it comes and let go: how much there is against the size the header gives."""

    def __init__(self, width: int, height: int, depth: int, color: int, interlaced: int) -> None:
        samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color, 1)
        row = lambda w: (w * samples * depth + 7) // 8
        if interlaced:
            sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in BANDS]
            self.rows = [(row(w), h) for w, h in sizes if w > 0 and h > 0]
        else:
            self.rows = [(row(width), height)]
        self.expected = sum((w + 1) * h for w, h in self.rows)
        self.engine, self.got, self.wrong, self.error = zlib.decompressobj(), 0, 0, None

    def add(self, part: bytes) -> None:
        while part and not self.error and self.got <= self.expected:
            try:
                out = self.engine.decompress(part, 1 << 20)
            except zlib.error:
                self.error = "image data does not unpack"
                return
            self.filters(out)
            self.got += len(out)
            part = self.engine.unconsumed_tail
            if not out and not part:
                break

    def filters(self, out: bytes) -> None:
        """Filter numbers stand at the first byte of every row."""
        at, base = self.got, 0
        for w, h in self.rows:
            end = base + (w + 1) * h
            first = base + max(0, -(-(at - base) // (w + 1))) * (w + 1)
            if first < end:
                self.wrong += sum(b > 4 for b in out[first - at : max(0, end - at) : w + 1]) if first >= at else 0
            base = end

    def told(self, f) -> None:
        if self.error:
            f.problem("damage", self.error, 8, 0)
        elif self.got < self.expected:
            f.problem("damage", "image data ends too soon", 8, 0)
        elif self.got > self.expected or self.engine.unused_data:
            f.problem("hidden", "data after the image data", 8, 0)
        if self.wrong:
            f.problem("damage", f"{self.wrong} rows with no known filter", 8, 0)


def png_chunk(kind: str, body: bytes, f, c: int, at: int) -> None:
    """The fields of chunks that are not text."""
    if kind == "PLTE":
        f.node(c, "colours", at, len(body), len(body) // 3)
        if len(body) % 3:
            f.problem("damage", "palette cut short", at, len(body))
    elif kind == "gAMA" and len(body) == 4:
        f.node(c, "gamma", at, 4, struct.unpack(">I", body)[0] / 100_000)
    elif kind == "pHYs" and len(body) == 9:
        x, y, unit = struct.unpack(">IIB", body)
        f.node(c, "pixels a metre" if unit else "pixel shape", at, 9, f"{x} x {y}")
    elif kind == "tRNS":
        f.node(c, "transparency", at, len(body), len(body))
    elif kind == "iCCP":
        name, _, rest = body.partition(b"\0")
        f.node(c, "name", at, len(name), name.decode("latin-1"))
        got = inflated(rest[1:], kept=MOST_PROFILE)
        if got.error:
            f.problem("damage", f"colour profile {got.error}", at, len(body))
        else:
            profile(got.data, f, c, at + len(name) + 2)
    elif kind == "caBX":
        f.fact("credentials", "content credentials", c)


def heif_items(d: bytes, meta: tuple[int, int], f, root: int) -> None:
    """Items of a ``meta`` box (its body from ``meta[0]`` to ``meta[1]``): what they are, where they lie, and what the Exif and XMP ones say."""
    from gleanery.sources.decode import tiff

    kinds: dict[int, tuple[str, str]] = {}
    places: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    inner = 0

    def number(at: int, size: int) -> int:
        return int.from_bytes(d[at : at + size], "big")

    at = meta[0]
    while at + 8 <= meta[1]:
        n, name = number(at, 4), d[at + 4 : at + 8]
        if n < 8 or at + n > meta[1]:
            return
        body, version = at + 12, d[at + 8] if n > 8 else 0
        if name == b"idat":
            inner = at + 8
        elif name == b"iinf":
            o = body + (2 if version == 0 else 4)
            while o + 20 <= at + n:
                size, v = number(o, 4), d[o + 8]
                if size < 12 or d[o + 4 : o + 8] != b"infe":
                    break
                wide = 4 if v == 3 else 2
                kind = d[o + 12 + wide + 2 : o + 12 + wide + 6].decode("latin-1")
                rest = d[o + 12 + wide + 6 : o + size].split(b"\0")
                kinds[number(o + 12, wide)] = (kind, rest[1].decode("latin-1") if kind == "mime" and len(rest) > 1 else "")
                o += size
        elif name == b"iloc":
            sizes = [d[body] >> 4, d[body] & 15, d[body + 1] >> 4, d[body + 1] & 15 if version else 0]
            wide = 4 if version == 2 else 2
            count, o = number(body + 2, wide), body + 2 + wide
            for _ in range(min(count, 65_536)):
                ident, o = number(o, wide), o + wide
                method, o = (number(o, 2) & 15, o + 2) if version else (0, o)
                base, o = number(o + 2, sizes[2]), o + 2 + sizes[2]
                extents, o = number(o, 2), o + 2
                spans = []
                for _ in range(min(extents, 1_024)):
                    o += sizes[3]
                    spans.append((base + number(o, sizes[0]), number(o + sizes[0], sizes[1])))
                    o += sizes[0] + sizes[1]
                places[ident] = (method, spans)
                if o > at + n:
                    f.problem("damage", "item places cut short", at, n)
                    break
        at += n
    for ident, (kind, said) in kinds.items():
        method, spans = places.get(ident, (0, []))
        spans = [(s + (inner if method == 1 else 0), k or len(d) - s) for s, k in spans]
        c = f.node(root, f"item {ident} · {kind}", spans[0][0] if spans else 0, sum(k for _, k in spans), said or None)
        if any(s + k > len(d) for s, k in spans):
            f.problem("damage", f"item {ident} out of the file", 0, 0)
            continue
        data = b"".join(d[s : s + k] for s, k in spans) if kind in ("Exif", "mime") and method < 2 else b""
        if kind == "Exif" and len(data) > 8:
            skip = 4 + number(spans[0][0], 4)
            tiff(data[skip:], f, c, spans[0][0] + skip)
        elif kind == "mime" and b"<x:xmpmeta" in data or b"<rdf:RDF" in data:
            xmp(data, f, c, spans[0][0])
