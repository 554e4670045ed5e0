"""Decoders in depth, clean copies of every format, members, carving, verified copies."""

import struct
import zlib

import pytest

from gleanery.operators.sniff import sniffed
from gleanery.sources import samples as S
from gleanery.sources.decode import decode
from gleanery.sources.rewrite import clean
from gleanery.sources.unpack import inflated, traced, unfiltered


def facts(content, form):
    return {(k, t) for k, t, _ in decode(content, form).facts}


def test_depth_of_decoders():
    assert {("software", "Tool 9"), ("author", "Ana"), ("copyright", "(c)"), ("copyright", "Copy by Kim")} <= facts(S.rich_jpeg(), "jpeg")
    f = decode(S.interlaced_png(), "png")
    assert f.complete and not f.problems and ("copyright", "Copy by Kim") in facts(S.interlaced_png(), "png")
    assert {("location", "50.45000, 30.50000"), ("serial", "SN12345")} <= facts(S.heif(), "heif")
    assert {("hiddensheets", "Secret & Co"), ("hiddencells", "1 hidden rows or columns"), ("comments", "comments by Ida"), ("weblinks", "out.example"), ("custom", "Client: Acme")} <= facts(S.xlsx(), "zip")
    assert {("tracked", "changes by Jo"), ("deleted", "old words"), ("author", "Jo")} <= facts(S.odt(), "zip")
    assert facts(S.ogg(), "ogg") == {("title", "Wind"), ("artist", "Dee"), ("encoder", "lib1")} and decode(S.ogg(), "ogg").complete
    assert facts(S.cfb(), "cfb") == {("author", "Gita"), ("title", "Memo")}
    assert facts(S.svgz(), "svg") == facts(S.svg(), "svg") and sniffed(S.svgz()) == "svg"
    assert ("created", "2024-05-31 11:33:20") in facts(S.mp4(), "video")


def test_pixels_against_the_header():
    chunk = S._chunk
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0))
    png = lambda raw: b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    labels = lambda raw: [p[1] for p in decode(png(raw), "png").problems]
    assert labels(b"\0ab\1cd") == [] and labels(b"\0ab") == ["image data ends too soon"] and labels(b"\0ab\7cd") == ["1 rows with no known filter"]
    assert labels(b"\0ab\1cd" + bytes(9)) == ["data after the image data"]
    assert unfiltered(b"\1\5\1\2\1\1", 2, 1) == (bytes([5, 6, 6, 7]), 0)


def test_bombs_are_bounded():
    bomb = zlib.compress(bytes(1 << 27), 9)
    got = inflated(bomb, kept=1000)
    assert (got.size, len(got.data), got.whole) == (1 << 27, 1000, False) and inflated(bomb, counted=1 << 22).error == "unpacks to too much"
    text = S._chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"x" * (17 << 20)))
    f = decode(S.png(text), "png")
    assert not f.complete and any("more characters of a text than are read" == p[1] for p in f.problems)


def test_archives_agree_with_themselves():
    d = bytearray(S.docx())
    at = d.find(b"word/document.xml")
    d[at - 16] ^= 1  # a checksum in a local header
    assert any("other sizes in its own header" in p[1] for p in decode(bytes(d), "zip").problems)
    d = bytearray(S.zipped(a=b"hello"))
    d[31 + 1] ^= 0xFF
    assert not decode(bytes(d), "zip").complete
    assert decode(S.docx(), "zip").complete
    assert any(p[1] == "data before the archive" for p in decode(b"stub" + S.docx(), "zip").problems)


@pytest.mark.parametrize("form,make", [("tiff", S.exif), ("video", S.mp4), ("heif", S.heif), ("wasm", S.wasm), ("ogg", S.ogg), ("cfb", S.cfb), ("pdf", S.pdf), ("svg", S.svgz), ("zip", S.docx), ("jpeg", S.rich_jpeg)])
def test_clean_copies(form, make):
    d = make()
    copy, gone, error = clean(d, form)
    kept = {"copyright"} if form == "jpeg" else {"created"} if form == "heif" else set()  # a colour profile belongs to the picture
    assert error is None and gone and {k for k, _ in facts(copy, form)} <= kept and decode(copy, form).complete
    assert sniffed(copy) == sniffed(d)
    again = clean(copy, form)
    assert again[2] == "nothing" or again[0] == copy or form == "pdf"


def test_changes_are_accepted():
    body = b'<w:p><w:ins w:id="1" w:author="Ann"><w:r><w:t>new </w:t></w:r></w:ins><w:del w:id="2" w:author="Bo"><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:rPr><w:rPrChange w:author="Cy"><w:b/></w:rPrChange></w:rPr><w:t>text</w:t></w:r><w:instrText>x</w:instrText></w:p>'
    d = S.zipped(**{"word/document.xml": body})
    assert {k for k, _ in facts(d, "zip")} == {"tracked", "deleted"}
    copy, gone, error = clean(d, "zip")
    assert error is None and not facts(copy, "zip")
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(copy)) as z:
        assert z.read("word/document.xml") == b"<w:p><w:r><w:t>new </w:t></w:r><w:r><w:rPr></w:rPr><w:t>text</w:t></w:r><w:instrText>x</w:instrText></w:p>"
    copy, _, _ = clean(S.odt(), "zip")
    assert not facts(copy, "zip")
    rtf = rb"{\rtf1{\*\revtbl{Unknown;}{Ann;}}{\*\template C:\\x.dot}{\info{\title T}}{\revised\revauth1\revdttm5 new} {\deleted\revauthdel1 old {\b \'e9} \} w} \deleted gone \deleted0 kept\par}"
    copy, _, _ = clean(rtf, "rtf")
    assert copy == rb"{\rtf1{\info}{new} {} kept\par}" and not facts(copy, "rtf")


def test_refusals():
    assert clean(b"x", "unknown")[2] == "unsupported" and clean(S.png(), "png")[2] == "nothing" and clean(S.png()[:-5], "png")[2] == "damaged"
    assert clean(S.pdf().replace(b"/Root", b"/Encrypt 9 0 R /Root"), "pdf")[2] == "locked" and clean(S.pdf() + b"/ByteRange", "pdf")[2] == "signed"
    assert clean(b"ID3\3\0\0\0\0\0\0" + S.gif(), "mp3")[2] == "changes"


def test_deflate_blocks():
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = b"abc" * 4000 + bytes(range(256)) * 40
    blocks, error = traced(c.compress(data) + c.flush())
    assert error is None and sum(b["bytes"] for b in blocks) == len(data) and blocks[0]["checkpoint"] == 0
    assert traced(b"\xff\xff")[1] and traced(b"")[1] == "ends too soon"


def test_members_and_carving(spark):
    from pyspark.sql import functions as F

    from gleanery.sources.engine import carved, members, register, trace_summary

    inner = S.zipped(**{"b.txt": b"hello"})
    files = spark.createDataFrame([("a", "a.zip", bytearray(S.zipped(**{"in.zip": inner, "x.png": S.png()}))), ("m", "m.eml", bytearray(S.eml()))], "file_id string, name string, content binary")
    first = members(files)
    assert {(r["name"], r["depth"]) for r in first.collect()} == {("in.zip", 1), ("x.png", 1), ("bill.pdf.html", 1)}
    assert {(r["name"], r["depth"]) for r in members(first).collect()} == {("b.txt", 2)}
    assert {r["error"] for r in members(files, 10).collect()} == {"too large", None}
    hidden = spark.createDataFrame([("h", bytearray(b"xx" + S.png() + b"yy" + S.gif()))], "file_id string, content binary")
    assert [(r["format"], r["start"], r["length"]) for r in carved(hidden).collect()] == [("png", 2, len(S.png())), ("gif", 4 + len(S.png()), len(S.gif()))]
    register(spark)
    spark.createDataFrame([("z", bytearray(zlib.compress(b"abcabcabcabc" * 9)[2:-4]))], "file_id string, content binary").createOrReplaceTempView("packed_streams")
    row = trace_summary(spark.sql("SELECT file_id, b.* FROM packed_streams, LATERAL deflate_blocks(content) b")).first()
    assert row["bytes"] == 108 and 3 <= row["literals"] <= 5
    assert files.where(F.col("file_id") == "a").count() == 1


def test_verified_copies(spark):
    from gleanery.sources.rewrite import verified_copies

    rows = [(n, n, bytearray(make())) for n, make in S.SAMPLES.items()]
    items, receipts = verified_copies(spark.createDataFrame(rows, "file_id string, name string, content binary"))
    got = {r["file_id"]: r for r in receipts.collect()}
    assert set(got) == set(S.SAMPLES) and got["bin"]["error"] == "unsupported" and got["plain.png"]["error"] == "nothing"
    assert set(got["a.docx"]["removed_kinds"]) == {"author", "title"} and not got["a.docx"]["present_kinds"] and got["a.docx"]["complete"]
    assert set(got["a.flac"]["removed_kinds"]) == {"artist", "encoder", "title"} and set(got["a.doc"]["removed_kinds"]) == {"author", "title"}
    assert got["a.heic"]["removed_kinds"] and got["a.tif"]["removed_kinds"] and all(r["unexpected"] == 0 for r in got.values())
    assert {r["status"] for r in items.collect()} <= {"removed", "present", "unchecked"}
