"""Small files of many formats, made from bytes: for demonstrations and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*more: bytes) -> bytes:
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(more) + _chunk(b"IDAT", zlib.compress(b"\0" + bytes(6))) + _chunk(b"IEND", b"")


def exif() -> bytes:
    """Camera, serial number and a place, as TIFF."""
    ifd = lambda rows, base: struct.pack("<H", len(rows)) + b"".join(rows) + b"\0\0\0\0"
    gps = struct.pack("<6I", 50, 1, 27, 1, 0, 1), struct.pack("<6I", 30, 1, 30, 1, 0, 1)
    model, serial = b"Cam One\0", b"SN12345\0"
    at = 8 + 2 + 12 * 3 + 4
    data = {"model": at, "serial": at + 8, "lat": at + 16, "lon": at + 40, "gps": at + 64}
    row = lambda tag, kind, n, value: struct.pack("<HHI", tag, kind, n) + value
    p = lambda x: struct.pack("<I", x)
    main = ifd([row(0x0110, 2, 8, p(data["model"])), row(0x8825, 4, 1, p(data["gps"])), row(0xA431, 2, 8, p(data["serial"]))], 0)
    place = ifd([row(1, 2, 2, b"N\0\0\0"), row(2, 5, 3, p(data["lat"])), row(3, 2, 2, b"E\0\0\0"), row(4, 5, 3, p(data["lon"]))], 0)
    return b"II*\0" + p(8) + main + model + serial + gps[0] + gps[1] + place


def jpeg(end: bytes = b"\xff\xd9") -> bytes:
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    size = struct.pack(">BHHB", 8, 1, 1, 1) + b"\1\x11\0"
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + exif()) + seg(0xFE, b"made at home") + seg(0xC0, size) + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x55" + end


def gif() -> bytes:
    return b"GIF89a\1\0\1\0\0\0\0\x21\xfe\x05hello\0\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0;"


def wav() -> bytes:
    c = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    body = b"WAVE" + c(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)) + c(b"LIST", b"INFO" + c(b"IART", b"Ann") + c(b"INAM", b"Song")) + c(b"data", b"\x80\x80")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def zipped(**files: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def docx() -> bytes:
    core = b'<cp:coreProperties xmlns:dc="x"><dc:creator>Vera K</dc:creator><dc:title>Plan</dc:title></cp:coreProperties>'
    return zipped(**{"[Content_Types].xml": b"<Types/>", "docProps/core.xml": core, "word/document.xml": b"<w:document/>"})


def flac() -> bytes:
    tags = [b"TITLE=Air", b"ARTIST=Bo"]
    c = struct.pack("<I", 3) + b"enc" + struct.pack("<I", len(tags)) + b"".join(struct.pack("<I", len(t)) + t for t in tags)
    return b"fLaC" + b"\0" + (34).to_bytes(3, "big") + bytes(34) + b"\x84" + len(c).to_bytes(3, "big") + c + b"\xff\xf8"


def mp3() -> bytes:
    frame = lambda n, t: n + struct.pack(">I", len(t) + 1) + b"\0\0\3" + t
    body = frame(b"TIT2", b"Tune") + frame(b"TPE1", b"Cy")
    return b"ID3\3\0\0" + bytes([0, 0, 0, len(body)]) + body + b"\xff\xfb\x90\0" + bytes(8)


def mp4() -> bytes:
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"mvhd", struct.pack(">II", 0, 3_800_000_000) + bytes(92)) + box(b"udta", box(b"\xa9xyz", b"\0\x10\0\0+50.4-030.5/")))


def wasm() -> bytes:
    body = b"\x10sourceMappingURL" + b"\x05a.map"
    return b"\0asm\1\0\0\0" + b"\0" + bytes([len(body)]) + body


def pdf() -> bytes:
    return b"%PDF-1.4\n1 0 obj\n<< /Title (Note) /Author (Zed) >>\nendobj\n2 0 obj\n<< /Type /Catalog >>\nendobj\ntrailer << /Root 2 0 R /Info 1 0 R >>\n%%EOF\n"


def rtf() -> bytes:
    return rb"{\rtf1{\info{\author Ivo}{\title Lease}{\creatim\yr2024\mo2\dy3\hr4\min5}}\deleted gone}"


def eml() -> bytes:
    return (
        b"Received: from laptop-x1 (laptop-x1 [93.184.216.34]) by mx\r\nFrom: Bank <info@my-bank.com>\r\nReply-To: x@evil.org\r\nTo: a@b.org\r\n"
        b"Date: Mon, 1 Jan 2024 10:00:00 +0200\r\nSubject: hi\r\nX-Mailer: Quill 1\r\nAuthentication-Results: mx; spf=pass; dkim=fail\r\nMIME-Version: 1.0\r\n"
        b'Content-Type: multipart/mixed; boundary="q"\r\n\r\n--q\r\nContent-Type: text/html\r\n\r\n<a href="http://evil.org/x">my-bank.com</a>\r\n'
        b'--q\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="bill.pdf.html"\r\n\r\n<p>\r\n--q--\r\n'
    )


def svg() -> bytes:
    return b'<svg xmlns="http://www.w3.org/2000/svg" inkscape:export-filename="/home/vera/a.png"><title>Map</title><metadata>x</metadata></svg>'


def heif() -> bytes:
    """A picture container with an Exif item in its ``mdat``."""
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    full = lambda n, b, v=0: box(n, bytes([v, 0, 0, 0]) + b)
    data = b"\0\0\0\0" + exif()
    head = box(b"ftyp", b"heic\0\0\0\0mif1heic")
    info = full(b"iinf", b"\0\1" + full(b"infe", b"\0\1\0\0Exif\0", 2))
    meta = lambda at: full(b"meta", full(b"hdlr", bytes(20)) + info + full(b"iloc", b"\x44\0\0\1" + struct.pack(">HHHII", 1, 0, 1, at, len(data))))
    return head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", data)


def ogg() -> bytes:
    """Two pages: an identification and comments."""
    from gleanery.sources.decode import _ogg_sum

    tags = [b"TITLE=Wind", b"ARTIST=Dee"]
    comments = b"\x03vorbis" + struct.pack("<I", 4) + b"lib1" + struct.pack("<I", len(tags)) + b"".join(struct.pack("<I", len(t)) + t for t in tags) + b"\1"
    out = b""
    for i, packet in enumerate((b"\x01vorbis" + bytes(23), comments)):
        page = bytearray(b"OggS\0" + bytes([2 if i == 0 else 4]) + bytes(8) + struct.pack("<III", 7, i, 0) + bytes([1, len(packet)]) + packet)
        page[22:26] = struct.pack("<I", _ogg_sum(page))
        out += bytes(page)
    return out


def cfb() -> bytes:
    """A compound file with one property set, in sectors of 512 bytes."""
    said = {4: b"Gita\0", 2: b"Memo\0"}
    body, rows = b"", []
    for key, text in said.items():
        rows.append((key, 8 + 8 * len(said) + len(body)))
        body += struct.pack("<II", 30, len(text)) + text + bytes(-len(text) % 4)
    part = struct.pack("<II", 8 + 8 * len(said) + len(body), len(said)) + b"".join(struct.pack("<II", *r) for r in rows) + body
    stream = (b"\xfe\xff\0\0" + bytes(20) + struct.pack("<I", 1) + bytes(16) + struct.pack("<I", 48) + part).ljust(4096, b"\0")

    def entry(name: str, kind: int, child: int, start: int, size: int) -> bytes:
        n = name.encode("utf-16-le") + b"\0\0"
        return n.ljust(64, b"\0") + struct.pack("<HBBIII", len(n), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<III", start, size, 0)

    directory = (entry("Root Entry", 5, 1, 0xFFFFFFFE, 0) + entry("\x05SummaryInformation", 2, 0xFFFFFFFF, 2, len(stream))).ljust(512, b"\0")
    fat = struct.pack("<12I", 0xFFFFFFFD, 0xFFFFFFFE, *range(3, 10), 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, 0) + b"\xff" * 432
    return head[:512] + fat + directory + stream


def xlsx() -> bytes:
    """A sheet that is hidden, a link out, a comment, a custom property."""
    return zipped(**{
        "[Content_Types].xml": b"<Types/>", "xl/workbook.xml": b'<workbook><sheets><sheet name="Open"/><sheet name="Secret &amp; Co" state="veryHidden"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": b'<worksheet><row r="1" hidden="1"/></worksheet>', "xl/comments1.xml": b"<comments><authors><author>Ida</author></authors></comments>",
        "xl/_rels/workbook.xml.rels": b'<Relationships><Relationship Type="x/hyperlink" Target="https://Out.example/a" TargetMode="External"/></Relationships>',
        "docProps/custom.xml": b'<Properties><property name="Client"><vt:lpwstr>Acme</vt:lpwstr></property></Properties>',
    })


def odt() -> bytes:
    change = b"<text:tracked-changes><text:deletion><office:change-info><dc:creator>Jo</dc:creator></office:change-info><text:p>old words</text:p></text:deletion></text:tracked-changes>"
    return zipped(**{"mimetype": b"application/vnd.oasis.opendocument.text", "content.xml": b"<office:text>" + change + b"</office:text>", "meta.xml": b"<meta:initial-creator>Jo</meta:initial-creator>"})


def icc(text: bytes = b"Copy by Kim") -> bytes:
    tag = b"text\0\0\0\0" + text + b"\0"
    out = bytearray(132) + struct.pack(">4sII", b"cprt", 144, len(tag)) + tag
    out[:4], out[12:20], out[36:40], out[128:132] = struct.pack(">I", len(out)), b"mntrRGB ", b"acsp", struct.pack(">I", 1)
    return bytes(out)


def rich_jpeg() -> bytes:
    """XMP, caption records and a colour profile in segments of their own."""
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    xmp = b"http://ns.adobe.com/xap/1.0/\0" + b'<x:xmpmeta><rdf:Description xmp:CreatorTool="Tool 9"><dc:creator><rdf:Seq><rdf:li>Ana</rdf:li></rdf:Seq></dc:creator></rdf:Description></x:xmpmeta>'
    record = b"\x1c\2\x74" + struct.pack(">H", 3) + b"(c)"
    iptc = b"Photoshop 3.0\0" + b"8BIM" + struct.pack(">HBBI", 0x0404, 0, 0, len(record)) + record + b"\0" * (len(record) & 1)
    return b"\xff\xd8" + seg(0xE1, xmp) + seg(0xED, iptc) + seg(0xE2, b"ICC_PROFILE\0\1\1" + icc()) + seg(0xDA, b"\1\1\0\0\x3f\0") + b"\x55\xff\xd9"


def interlaced_png() -> bytes:
    """Nine by nine pixels of one byte in seven bands, a gamma and a colour profile."""
    sizes = [(2, 2), (1, 2), (3, 1), (2, 3), (5, 2), (4, 5), (9, 4)]
    raw = b"".join((b"\0" + bytes(w)) * h for w, h in sizes)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 9, 8, 0, 0, 0, 1)) + _chunk(b"gAMA", struct.pack(">I", 45_455)) + _chunk(b"iCCP", b"p\0\0" + zlib.compress(icc()))
    return b"\x89PNG\r\n\x1a\n" + head + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def svgz() -> bytes:
    import gzip

    return gzip.compress(svg(), mtime=0)


SAMPLES = {
    "plain.png": png, "noted.png": lambda: png(_chunk(b"tEXt", b"Author\0Olena")), "cut.png": lambda: png()[:-8], "tail.png": lambda: png() + b"secret", "photo.jpg": jpeg,
    "cut.jpg": lambda: jpeg(b""), "a.gif": gif, "a.wav": wav, "a.docx": docx, "cut.docx": lambda: docx()[:-30], "a.flac": flac, "a.mp3": mp3, "a.mp4": mp4, "a.wasm": wasm, "a.pdf": pdf,
    "a.rtf": rtf, "a.eml": eml, "a.svg": svg, "a.svgz": svgz, "a.tif": exif, "a.heic": heif, "a.ogg": ogg, "a.doc": cfb, "a.xlsx": xlsx, "a.odt": odt, "rich.jpg": rich_jpeg, "bands.png": interlaced_png, "bin": lambda: b"x /Users/olena/lib/ y me@site.org z", "empty": lambda: b"",
}


def drawn_pdf() -> bytes:
    """A page with a name under a black box, a word beside it, and one off the page."""
    content = b"BT /F1 10 Tf 50 700 Td (SECRET) Tj ET BT /F1 10 Tf 200 700 Td (open) Tj ET BT /F1 10 Tf 900 700 Td (far) Tj ET 0 g 48 695 40 20 re f"
    packed = zlib.compress(content)
    body = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Page /MediaBox [0 0 612 792] /Contents 2 0 R >>\nendobj\n2 0 obj\n" + body + b"\nendobj\n%%EOF\n"


SAMPLES["drawn.pdf"] = drawn_pdf
