"""PDF: objects, painting with transparency, forms and clips, findings on pages, redaction."""

import zlib

import pytest

from gleanery.sources import samples as S
from gleanery.sources.pages import painted
from gleanery.sources.pdfobj import Document, Name, Reader, Ref, written
from gleanery.sources.redact import places, redact
from gleanery.sources.rewrite import Refused


def page(content: bytes, resources: bytes = b"", annots: bytes = b"", more: bytes = b"", box: bytes = b"[0 0 612 792]") -> bytes:
    packed = zlib.compress(content)
    return (
        b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 5 0 R >>\nendobj\n5 0 obj\n<< /Type /Pages /Kids [3 0 R] /MediaBox " + box + b" >>\nendobj\n"
        b"3 0 obj\n<< /Type /Page /Parent 5 0 R /Contents 2 0 R /Resources << " + resources + b" >> " + annots + b" >>\nendobj\n"
        b"2 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n" + more + b"trailer << /Root 1 0 R >>\n%%EOF\n"
    )


def shown(d: bytes) -> str:
    return "".join(r[7] for r in painted(d) if r[1] == "glyph")


def test_values():
    v = Reader(b"<< /A#42 [1 -2.5 (x\\(y\\)\\101) <4142> /N 7 0 R true null] >>").value()
    assert v == {b"AB": [1, -2.5, bytearray(b"x(y)A"), bytearray(b"AB"), Name(b"N"), Ref(7), True, None]} and Reader(written(v)).value() == v


def test_transparency_forms_and_clips():
    text = b"BT /F1 10 Tf 50 700 Td (SECRET) Tj ET "
    dark = lambda d: [(r[1], round(r[8], 2), r[9]) for r in painted(d) if r[1] == "fill"]
    assert dark(page(text + b"/G gs 0 g 48 695 60 20 re f", b"/ExtGState << /G << /ca 0.3 >> >>")) == [("fill", 0.0, 0.3)]
    form = b"7 0 obj\n<< /Type /XObject /Subtype /Form /BBox [0 0 100 100] /Matrix [2 0 0 2 10 10] /Length 18 >>\nstream\n0 g 0 0 10 10 re f\nendstream\nendobj\n"
    got = [r for r in painted(page(text + b"/X Do", b"/XObject << /X 7 0 R >>", more=form)) if r[1] == "fill"]
    assert [r[3:7] for r in got] == [(10.0, 10.0, 30.0, 30.0)]
    clipped = [r for r in painted(page(b"q 0 0 20 20 re W n 0 g 10 10 50 50 re f Q")) if r[1] == "fill"]
    assert [r[3:7] for r in clipped] == [(10.0, 10.0, 20.0, 20.0)]
    drawn = [r for r in painted(page(b"0 g 1 1 m 5 1 l 5 4 l 1 4 l h f 1 1 m 9 9 l 4 2 l f")) if r[1] == "fill"]
    assert [r[3:7] for r in drawn] == [(1.0, 1.0, 5.0, 4.0)]


def test_fonts_say_what_they_mean():
    cmap = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <0042> endbfrange"
    font = b"8 0 obj\n<< /Subtype /Type0 /DescendantFonts [<< /DW 600 /W [1 [250]] >>] /ToUnicode 9 0 R >>\nendobj\n9 0 obj\n<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream\nendobj\n"
    d = page(b"BT /F1 10 Tf 0 0 Td <000100020003> Tj ET", b"/Font << /F1 8 0 R >>", more=font)
    assert shown(d) == "ABC" and [round(r[3], 2) for r in painted(d) if r[1] == "glyph"] == [0.0, 2.5, 8.5]


def test_redaction():
    d = page(b"BT /F1 10 Tf 50 700 Td (name: Secret Person, open) Tj 0 -20 Td [(sec) -10 (ret) 5 ( rest)] TJ ET")
    areas = places(d, "secret")
    assert len(areas) == 2
    copy, n = redact(d, areas)
    assert n == 12 and "Person, open" in shown(copy) and "ecret" not in shown(copy).lower() and shown(copy).endswith(" rest")
    raw = b"".join(s.data().data for p in Document(copy).pages() for s in Document(copy).contents(p))
    assert b"Secret" not in copy and b"Secret" not in raw and bytes(b"Secret").hex().encode() not in raw
    moved = {r[7]: r[3] for r in painted(copy) if r[1] == "glyph" and r[7] in ",r"}
    assert moved[","] == pytest.approx({r[7]: r[3] for r in painted(d) if r[1] == "glyph"}[","], abs=0.01)
    with pytest.raises(Refused):
        redact(S.pdf().replace(b"/Root", b"/Encrypt 9 0 R /Root"), areas)
    image = b"7 0 obj\n<< /Subtype /Image /Width 1 /Height 1 /Length 3 >>\nstream\nabc\nendstream\nendobj\n"
    with pytest.raises(Refused):
        redact(page(b"q 100 0 0 100 0 0 cm /I Do Q", b"/XObject << /I 7 0 R >>", more=image), [(0, 10.0, 10.0, 20.0, 20.0)])


def test_findings_and_copies(spark):
    from gleanery.sources.pages import page_findings
    from gleanery.sources.redact import redacted

    link = b"/Annots [<< /Subtype /Link /Rect [45 595 200 615] /A << /URI (https://evil.org/x) >> >> << /Subtype /Redact /Rect [45 495 200 515] >>]"
    content = b"BT /F1 10 Tf 50 700 Td (COVERED) Tj 0 -100 Td (bank.com) Tj 0 -100 Td (MARKED) Tj 0 -100 Td 3 Tr (UNSEEN) Tj ET 0 g 40 690 100 30 re f"
    see_through = page(b"BT /F1 10 Tf 50 700 Td (FINE) Tj ET /G gs 0 g 48 695 60 20 re f", b"/ExtGState << /G << /ca 0.3 >> >>")
    files = spark.createDataFrame([("a", bytearray(page(content, annots=link))), ("b", bytearray(see_through)), ("c", bytearray(b"no"))], "file_id string, content binary")
    got = {(r["file_id"], r["kind"], r["text"]) for r in page_findings(files).collect()}
    assert got == {("a", "covered", "COVEREDMARKED"), ("a", "hiddentext", "UNSEEN"), ("a", "linkmismatch", "bank.com goes to https://evil.org/x")}
    copies = {r["file_id"]: r for r in redacted(files, ["unseen", "fine"]).collect()}
    assert copies["a"]["removed"] == 6 and copies["a"]["error"] is None and copies["b"]["removed"] == 4 and copies["c"]["error"] == "nothing"


def test_findings_never_broadcast_painted_rows(spark):
    """Painted rows pack so well that their files look small enough to be broadcast, whatever they hold."""
    from gleanery.sources.pages import covered_text, page_findings

    files = spark.createDataFrame([("a", bytearray(page(b"BT /F1 10 Tf 50 700 Td (COVERED) Tj ET 0 g 40 690 100 30 re f")))], "file_id string, content binary")
    for found in (page_findings(files), covered_text(files)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert [r["text"] for r in found.collect()] == ["COVERED"]


def test_removed_by_an_update(spark):
    from gleanery.sources.pages import removed_texts

    first = page(b"BT /F1 10 Tf 50 700 Td (old price 9) Tj 0 -20 Td (kept) Tj ET")
    packed = zlib.compress(b"BT /F1 10 Tf 50 700 Td (new price 8) Tj 0 -20 Td (kept) Tj ET")
    update = b"2 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\ntrailer << /Root 1 0 R >>\n%%EOF\n"
    files = spark.createDataFrame([("a", bytearray(first + update)), ("b", bytearray(first)), ("c", None)], "file_id string, content binary")
    assert [tuple(r) for r in removed_texts(files).collect()] == [("a", 0, "old price 9")]


def locked(version: int) -> bytes:
    """A file that opens without a password, by the three ways of locking."""
    import hashlib

    from gleanery.sources import pdflock as L

    ident, o, rights = b"0123456789abcdef", b"o" * 32, (-44) & 0xFFFFFFFF
    if version == 5:
        key, check, salt = b"k" * 32, b"checksal", b"key salt"
        lock = {b"V": 5, b"R": 6, b"Length": 256, b"P": -44, b"O": bytearray(o + b"x" * 16), b"U": bytearray(L.strengthened(b"", check) + check + salt), b"UE": bytearray(L.cbc_encrypted(L.strengthened(b"", salt), bytes(16), key))}
    else:
        key = hashlib.md5(L.PAD + o + rights.to_bytes(4, "little") + ident).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        u = hashlib.md5(L.PAD + ident).digest()
        for i in range(20):
            u = L.rc4(bytes(b ^ i for b in key), u)
        lock = {b"V": version, b"R": 3 if version == 2 else 4, b"Length": 128, b"P": -44, b"O": bytearray(o), b"U": bytearray(u + bytes(16))}
    if version > 2:
        lock |= {b"CF": {b"Std": {b"CFM": Name(b"AESV2" if version == 4 else b"AESV3")}}, b"StmF": Name(b"Std"), b"StrF": Name(b"Std")}

    def shut(data: bytes, number: int) -> bytes:
        k = key if version == 5 else hashlib.md5(key + number.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if version == 4 else b"")).digest()[:16]
        if version == 2:
            return L.rc4(k, data)
        n = 16 - len(data) % 16
        return b"i" * 16 + L.cbc_encrypted(k, b"i" * 16, data + bytes([n]) * n)

    content = shut(b"BT /F1 10 Tf 50 700 Td (inside) Tj ET", 2)
    return (
        b"%PDF-1.7\n1 0 obj\n" + written({b"Title": bytearray(shut(b"Hidden title", 1))}) + b"\nendobj\n2 0 obj\n<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream\nendobj\n"
        b"3 0 obj\n<< /Type /Page /MediaBox [0 0 612 792] /Contents 2 0 R >>\nendobj\n4 0 obj\n" + written(lock) + b"\nendobj\n"
        b"trailer << /Info 1 0 R /Encrypt 4 0 R /ID [<" + ident.hex().encode() + b"> <00>] >>\n%%EOF\n"
    )


def test_ciphers():
    from gleanery.sources import pdflock as L

    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        cipher = L.Aes(bytes(range(size)))
        assert cipher.encrypted(block).hex() == want and cipher.decrypted(bytes.fromhex(want)) == block
    assert L.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


@pytest.mark.parametrize("version", [2, 4, 5])
def test_files_that_open_without_a_password(version):
    from gleanery.sources.decode import decode

    d = locked(version)
    f = decode(d, "pdf")
    assert ("title", "Hidden title") in {(k, t) for k, t, _ in f.facts} and f.complete and shown(d) == "inside"
    assert "opens without a password" in [t for k, t, _ in f.facts if k == "encryption"][0]
    shut = decode(d.replace(b"/U <", b"/U <00"), "pdf")
    assert not shut.complete and {k for k, _, _ in shut.facts} == {"encryption"}
