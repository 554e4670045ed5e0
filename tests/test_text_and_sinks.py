"""Text functions, numbers in bytes, reports and files that go out, on small inputs."""

import io
import json
import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import batch, geometry, roles
from gleanery.sources import sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_addresses(spark):
    v6 = lambda v: one(spark, X.ipv6, v)
    assert v6("[2001:DB8::1] fe80::a%1 1:2:3:4:5:6:7:8 ::1 12:30:11 a::b::c 1:2:3:4:5:6:7:8:9 :: 12345::1") == ["2001:db8::1", "fe80::a", "1:2:3:4:5:6:7:8", "::1"]
    assert one(spark, X.private_ipv6, "fd00::1") and one(spark, X.private_ipv6, "::1") and not one(spark, X.private_ipv6, "2001:db8::1")


def test_addresses_of_large_ids(spark, tmp_path):
    import duckdb

    from gleanery.plans import more

    ids = [0, 9, 65_533, 65_534, 65_535, 65_536, 256_409, (1 << 32) - 2, (1 << 32) - 1, 1 << 32, (1 << 48) + 7, (1 << 63) - 2]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(more.SQL["ipv6_found"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, more.ipv6_found(spark, str(tmp_path)).select("doc_id", "address_tail", "private").collect())) == sorted(want)


def test_decoding(spark):
    assert one(spark, X.entities, "&#65;&#x1F600;&#0;&#x110000;&lt;&amp;lt; &#") == "A\U0001f600&#0;&#x110000;<&lt; &#"
    assert one(spark, X.quoted_printable, "a=C3=A9=\r\nb = c=3D") == "aéb = c=" and one(spark, X.percent_decoded, "a%2fb%zz%C3%A9") == "a/b%zzé"
    assert bytes(one(spark, X.base64_decoded, "aGVs\r\nbG8")) == b"hello" and bytes(one(spark, X.base64_decoded, "aGVsbG8=ignored")) == b"hello"
    p = lambda v: one(spark, lambda c: X.header_parameter(c, "filename"), v)
    assert p("attachment; filename*=UTF-8''a%20b.txt") == "a b.txt" and p('x; filename="q.pdf"') == "q.pdf" and p("x") is None
    assert p("x; filename*0*=utf-8''%41; filename*1=b") == "Ab"


def test_numbers_at(spark):
    data = struct.pack("<IfdB", 1_700_000_000, 1.5, -2.25, 200)
    row = spark.createDataFrame([(bytearray(data),)], "x binary")
    n = lambda *a: row.select(X.number_at(F.col("x"), F.lit(a[0]), *a[1:])).first()[0]
    assert n(0, 4) == 1_700_000_000 and n(16, 1) == 200 and n(16, 1, True, True) == -56 and n(16, 2) is None and n(8, 8, False) == struct.unpack_from(">Q", data, 8)[0]
    assert row.select(X.unix_time_at(F.col("x"), F.lit(0))).first()[0] == "2023-11-14 22:13:20 UTC" and row.select(X.bits_at(F.col("x"), F.lit(16))).first()[0] == "11001000"
    f = lambda at, size: row.select(X.float_at("x", F.lit(at), F.lit(size), F.lit(True))).first()[0]
    assert f(4, 4) == 1.5 and f(8, 8) == -2.25 and f(14, 8) is None


def test_xml(spark):
    x = '<w:doc><dc:creator role="a">V &amp; <b>K</b></dc:creator><p/><p a="1">t</p></w:doc>'
    assert one(spark, lambda c: X.xml_text(c, "creator"), x) == "V & K" and one(spark, lambda c: X.xml_attribute(c, "creator", "role"), x) == "a"
    assert [r["body"] for r in one(spark, lambda c: X.xml_elements(c, "p"), x)] == ["", "t"] and one(spark, lambda c: X.xml_text(c, "none"), x) is None


def test_parts_of_pages(spark, tmp_path):
    import duckdb

    from gleanery.plans import more

    pages = [
        "<title>token = &quot;1&quot; &amp;lt; &#65;</title><p>a</p>", "<HTML><TITLE lang='x'> A &amp; B\u00a0\u3000</Title><P>a</P><p\nid=1>b</p><P>open", "<title>a<b>c</b> \n</title><p/>x</p><p />y</p><pre>z</pre>",
        "<svg:title>t</svg:title><x:p>a</x:p><title/>u</title><p>a</p >", "<titles>v</title><p>a<p>b</p></p><p\x0bq>c</p>", "<title>\t&lt;&nbsp;</title>", "<title a='<'>w</title><title>2</title>", "", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(more.SQL["xml_parts"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in more.xml_parts(spark, str(tmp_path)).select("page_id", "title", "paragraphs").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(pages)


def test_batches(spark):
    rows = spark.createDataFrame([("/a/./b",), ("/a//b",), ("file:///a/c/../b",), ("/out/x",), ("/outer",)], "path string")
    assert sorted(r["path"] for r in batch.collected(rows, "/out/").collect()) == ["/a/b", "/outer"]
    with pytest.raises(ValueError):
        batch.collected(rows, most=1)


def test_roles(spark):
    rows = [("png", 1, "IDAT", None, None), ("png", 1, "tEXt", None, None), ("jpeg", 1, "APP1 Exif", None, None), ("zip", 1, "docProps/core.xml", None, None), ("eml", 1, "x", "warning", "hidden"), ("png", 2, "x", "error", None), ("gif", 1, "x", "warning", "hidden")]
    got = spark.createDataFrame(rows, "f string, d int, l string, s string, c string").select(roles.role_of(F.col("f"), F.col("d"), F.col("l"), F.col("s"), F.col("c")).alias("r")).collect()
    assert [r["r"] for r in got] == ["content", "metadata", "metadata", "metadata", None, "damaged", "hidden"]


def test_hidden_glyphs(spark):
    g = "file_id string, page int, ordinal int, l double, b double, r double, t double, mode int, lightness double, off_page boolean"
    rows = [("f", 0, 1, 0.0, 0.0, 9.0, 9.0, 3, 0.0, False), ("f", 0, 5, 0.0, 0.0, 9.0, 9.0, 0, 1.0, False), ("f", 1, 6, 50.0, 50.0, 59.0, 59.0, 0, 1.0, False), ("f", 1, 7, 0.0, 0.0, 5.0, 0.5, 0, 0.0, False), ("f", 1, 8, 0.0, 0.0, 9.0, 9.0, 3, 0.0, False)]
    box = "file_id string, page int, ordinal int, l double, b double, r double, t double"
    fills, images = spark.createDataFrame([("f", 0, 2, 0.0, 0.0, 50.0, 50.0)], box), spark.createDataFrame([("f", 0, 0, 0.0, 0.0, 90.0, 90.0)], box)
    pages = spark.createDataFrame([("f", p, 0, 0.0, 0.0, 100.0, 100.0) for p in (0, 1)], box).drop("ordinal")
    got = {(r["page"], r["ordinal"]): r["reason"] for r in geometry.hidden_glyphs(spark.createDataFrame(rows, g), fills, images, pages).collect()}
    assert got == {(1, 6): "white", (1, 7): "tiny", (1, 8): "invisible"}


def test_sinks(spark, tmp_path):
    copies = spark.createDataFrame([("a", "../x/a.txt", bytearray(b"one")), ("b", "b.txt", None)], "file_id string, name string, copy binary")
    assert [(r["path"], r["bytes"]) for r in sinks.write_copies(copies, str(tmp_path)).collect()] == [(str(tmp_path / "a.txt"), 3)]
    assert os.listdir(tmp_path) == ["a.txt"] and (tmp_path / "a.txt").read_bytes() == b"one"
    files = spark.createDataFrame([("g", "a.txt", bytearray(b"1")), ("g", "a.txt", bytearray(b"2")), ("h", "../e", bytearray(b"3"))], "g string, name string, content binary")
    got = {r["group"]: r for r in sinks.stored_archives(files, "g").collect()}
    assert got["h"]["error"] == "a name leaves the folder" and got["g"]["files"] == 2
    with zipfile.ZipFile(io.BytesIO(got["g"]["archive"])) as z:
        assert z.namelist() == ["a.txt", "a (2).txt"] and z.read("a (2).txt") == b"2"
    rows = spark.createDataFrame([("=1", 'a"b'), (None, "c")], "x string, y string")
    sinks.write_csv(rows, ["x", "y"], str(tmp_path / "csv"))
    lines = [p.read_bytes() for p in (tmp_path / "csv" / "rows").glob("part-*")]
    assert b'\'=1,"a""b"\r\n' in b"".join(lines)
    cover = spark.createDataFrame([("png", 1, 1, 0, 0, 9), ("gif", 2, 0, 2, 0, 8)], "format string, files int, complete int, partial int, unsupported int, bytes int")
    assert [r["format"] for r in json.loads(sinks.coverage_json(cover).first()["json"])["rows"]] == ["gif", "png"]


def test_summary_table(spark):
    t = spark.createDataFrame([(i, "png", None, ["emails"], [], 1, 0, i % 2 == 0) for i in range(5)], "file_id int, format string, misnamed string, kinds array<string>, concerns array<string>, n_facts int, n_problems int, fails boolean")
    text = sinks.summary_table(t, most=3).first()["text"]
    assert text.splitlines()[2:] == ["| 0 | png | emails | - | yes |", "| 1 | png | emails | - |  |", "| 2 | png | emails | - | yes |", "and 2 more files"]


def test_descriptions(spark):
    from gleanery.sources import samples as S
    from gleanery.sources.engine import inspect, tables

    files = spark.createDataFrame([("a", "a.png", bytearray(S.interlaced_png())), ("b", "b.docx", bytearray(S.docx()))], "file_id string, name string, content binary")
    long = inspect(files)
    nodes = roles.with_depth(tables(long)["nodes"].join(long.where("row = 'file'").select("file_id", "format"), "file_id"))
    got = {(r["file_id"], r["label"]): r["sentence"] for r in roles.described(nodes, roles.descriptions(spark)).collect()}
    assert got["a", "IDAT"] == "the packed pixels" and got["a", "cprt"] == "an entry of a colour profile" and got["b", "docProps/core.xml"] == "what the program knows about the document"
    assert got["a", "width"] is None


def test_depths_of_deep_trees(spark):
    rows = [("f", n, n - 1 if n else None, "html" if n % 100 == 7 else f"t{n}") for n in range(300)]
    rows = rows[::-1] + [("g", 0, None, ""), ("g", 1, 0, "head"), ("g", 2, 1, "html"), ("g", 3, 0, "p"), ("h", 1, 2, "a"), ("h", 2, 1, "b")]
    nodes = spark.createDataFrame(rows, "file_id string, node_id long, parent_id long, label string").repartition(3)
    got = {(r["file_id"], r["node_id"]): r for r in roles.with_depth(nodes).collect()}
    assert len(got) == 304 and all(got["f", n]["depth"] == n for n in range(300)) and got["g", 2]["depth"] == 2
    assert got["f", 299]["ancestors"] == ["html" if n % 100 == 7 else f"t{n}" for n in range(299)] and got["g", 2]["ancestors"] == ["", "head"]
    few = {(r["file_id"], r["node_id"]): r["ancestors"] for r in roles.with_depth(nodes, ["h*", "html"]).collect()}
    assert few["f", 7] == [] and few["f", 8] == few["f", 299] == ["html"] and few["g", 2] == ["head"] and few["g", 3] == []
    assert all(r["ancestors"] == [] for r in roles.with_depth(nodes.drop("label"), []).collect())


def test_described_nodes_of_deep_pages(spark, tmp_path):
    import duckdb

    from gleanery.plans import more

    pages = [(1, "<html><head><title>t</title></head><body>" + "<div><p>" * 60 + "<a href='x'>y</a>"), (2, "<h1>z</h1>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(more.SQL["described_nodes"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, more.described_nodes(spark, str(tmp_path)).select("sentence", "n").collect())) == sorted(want)


def test_node_depths_of_deep_pages(spark, tmp_path):
    from gleanery.plans import queries as plans

    spark.createDataFrame([(1, "<p>" * 150), (2, "<h1>z</h1>"), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert dict(plans.node_depths(spark, str(tmp_path)).collect()) == {0: 3, 1: 2} | {n: 1 for n in range(2, 151)}


def test_filled(spark):
    from gleanery.operators.reports import filled

    a, b = spark.createDataFrame([(1, None, "x"), (2, "p", None)], "k int, v string, w string"), spark.createDataFrame([(1, "q", "y", 9), (3, "r", None, 8)], "k int, v string, w string, z int")
    assert sorted(map(tuple, filled(a, b, ["k"]).collect())) == [(1, "q", "x", 9), (2, "p", None, None), (3, "r", None, 8)]


def test_copies_of_related_files(spark):
    from gleanery.sources import samples as S
    from gleanery.sources.rewrite import related_copies

    files = spark.createDataFrame([(n, n, bytearray(S.gif())) for n in ("a.gif", "b.gif", "c.gif")], "file_id string, name string, content binary")
    groups = spark.createDataFrame([(["a.gif", "b.gif"],)], "indexes array<string>")
    assert sorted(r["file_id"] for r in related_copies(files, groups).collect()) == ["a.gif", "b.gif"]
