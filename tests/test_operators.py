from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.dims import finding_kinds, removal_contract
from gleanery.operators import ranges, relate, reports, sniff, verify


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_hosts(spark):
    h = lambda v: one(spark, X.host, v)
    assert h("HTTPS://user@Example.COM:80/x") == "example.com" and h("ftp://a.b") is None and h("http://localhost/") is None
    base = lambda v: one(spark, X.base_domain, v)
    assert base("login.example-bank.com") == "example-bank.com" and base("pay.rozetka.com.ua") == "rozetka.com.ua" and base("localhost") == "localhost"
    assert one(spark, X.named, "Click here") is None and one(spark, X.named, " my-bank.com/ ") == "my-bank.com"
    assert one(spark, X.host, None) is None


def test_emails_and_accounts(spark):
    e = lambda v: one(spark, lambda c: X.emails(c), v)
    assert e("a@b.org A@B.ORG, git@x.org icon@2x.png x@example.com .c@d.net.") == ["a@b.org", "c@d.net"]
    assert one(spark, X.home_accounts, "/Users/Olena/x /home/olena/y C:\\Users\\Ivan\\z /home/root/") == ["Olena", "Ivan"]
    assert one(spark, X.listed, list("abcdef"), "array<string>") == "a, b, c, d and 2 more"


def test_risky_and_codes(spark):
    assert one(spark, X.risky, "invoice.pdf.HTML") == "page as pdf" and one(spark, X.risky, "a.txt") is None
    assert one(spark, X.code_kind, "https://bank.com@evil.example/") == "qrtrick" and one(spark, X.code_kind, "WIFI:S:x;;") == "qrwifi"
    assert one(spark, X.csv_cell, '=1+"2"') == '"\'=1+""2"""'


def test_sniff(spark):
    rows = [("a.jpg", b"\x89PNG\r\n\x1a\n"), ("b.txt", b""), ("c", None), ("d.eml", b"From: a\r\nTo: b\r\n\r\nx"), ("e.svg", b"<?xml?>\n<svg>"), ("f.pdf", b"xx%PDF-1.4")]
    got = {r["name"]: (r["format"], r["misnamed"]) for r in sniff.identified(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert got == {"a.jpg": ("png", "jpeg"), "b.txt": ("unknown", None), "c": ("unknown", None), "d.eml": ("eml", None), "e.svg": ("svg", None), "f.pdf": ("pdf", None)}


def compare(spark, a, b, complete=True, form="text"):
    s = "file_id string, ordinal int, kind string, scope string, value string"
    snap = spark.createDataFrame([("f", "text", form, complete, complete)], "file_id string, source_format string, copy_format string, source_complete boolean, copy_complete boolean")
    mk = lambda rows: spark.createDataFrame([("f", i, k, "file", v) for i, (k, v) in enumerate(rows)], s)
    return sorted((r["kind"], r["status"], r["reason"]) for r in verify.compare_copies(mk(a), mk(b), snap, removal_contract(spark)).collect())


def test_compare_rules(spark):
    e = "emails"
    assert compare(spark, [(e, "a"), (e, "a")], [(e, "a")]) == [(e, "present", "still_present"), (e, "removed", "removed")]
    assert compare(spark, [(e, "a")], [(e, "b")]) == [(e, "present", "value_changed_same_kind")]
    assert compare(spark, [(e, " ")], []) == [(e, "unchecked", "no_stable_value")]
    assert compare(spark, [("camera", "x")], []) == [("camera", "unchecked", "coverage_incomplete")]
    assert compare(spark, [(e, "a")], [], complete=False) == [(e, "unchecked", "parse_incomplete")]
    assert compare(spark, [(e, "a")], [(e, "a")], form="png") == [(e, "unchecked", "format_changed")]
    assert compare(spark, [], [(e, "a")]) == [(e, "present", "unexpected_output")]
    assert compare(spark, [], []) == [("file", "unchecked", "no_comparable_findings")]


def test_signals(spark):
    rows = [(1, " A1 ", 50.0, 30.0), (2, "A1", 50.0005, 30.0), (3, "unknown", 50.001, 30.0), (4, "unknown", 0.0, 180.0), (5, None, 0.0, -180.0), (6, "B", 91.0, 0.0)]
    s = spark.createDataFrame(rows, "index long, serial string, lat double, lon double")
    assert [r["indexes"] for r in relate.repeated_serials(s).collect()] == [[1, 2]]
    p = relate.located(s)
    assert sorted((r["a"], r["b"]) for r in relate.near_pairs(p, 100.0).collect()) == [(1, 2), (2, 3), (4, 5)]
    assert dict(relate.greedy_clusters(p, 100.0).collect()) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_dates(spark):
    rows = [(1, "2024:01:01 10:00:00+02:00"), (2, "2024-01-01T09:00:00Z"), (3, "2024:02:31 00:00:00"), (4, "2024:01:01 00:00:00"), (5, None)]
    got = relate.date_orders(spark.createDataFrame(rows, "i long, t string").withColumn("g", F.lit(1)), ["g"], "i", "t").collect()
    assert {r["zoned"]: r["indexes"] for r in got} == {True: [1, 2], False: [4]}


def test_composition_tiles(spark):
    rows = [("f", 0, 0, 0, 100, "content"), ("f", 1, 1, 10, 20, "metadata"), ("f", 2, 2, 15, 18, "thumbnail"), ("f", 3, 0, 120, 130, "content")]
    got = sorted(ranges.composition(spark.createDataFrame(rows, "file_id string, node_id int, depth int, start long, end long, role string")).collect(), key=lambda r: r["start"])
    assert [r["node_id"] for r in got] == [0, 1, 2, 1, 0, None, 3]
    assert [(r["start"], r["end"], r["role"]) for r in got] == [(0, 10, "content"), (10, 15, "metadata"), (15, 18, "thumbnail"), (18, 20, "metadata"), (20, 100, "content"), (100, 120, "hidden"), (120, 130, "content")]


def test_policy(spark):
    s = spark.createDataFrame([("a", "png", ["emails"], "complete"), ("b", "png", [], "partial"), ("c", "png", [], "complete")], "file_id string, format string, kinds array<string>, status string")
    got = {r["file_id"]: r["result"] for r in reports.policy_result(s, finding_kinds(spark), ["emails"], True).collect()}
    assert got == {"a": "blocked", "b": "unchecked", "c": "passed"}
    assert {r["result"] for r in reports.policy_result(s, finding_kinds(spark), ["nosuch"], False).collect()} == {"unchecked"}


def test_streams_give_what_tables_give(spark, tmp_path):
    from gleanery.streaming.counters import run_once, type_counts

    e = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "a"), ("2024-01-01 11:00:00", "b")], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    assert sorted(run_once(type_counts(stream), "counted").collect()) == sorted(type_counts(e).collect())


def test_film():
    import numpy as np
    import pytest

    from gleanery.sources.film import Settings, develop, weighted_rank

    ramp = np.repeat(np.arange(256, dtype=np.uint8)[None, :, None], 4, axis=2)
    same = develop(ramp, Settings())
    assert np.abs(same.pixels[0, :, 0].astype(int) - ramp[0, :, 0]).max() <= 1 and (same.pixels[..., 3] == 255).all() and same.shadows == same.highlights == 0.8
    turned = develop(ramp, Settings("mono-negative"))
    assert turned.base == (243, 243, 243) and turned.pixels[0, 10, 0] > turned.pixels[0, 200, 0]
    assert develop(ramp, Settings("mono-negative", base=(9, 9, 9))).base == (9, 9, 9)
    assert develop(np.repeat(ramp, 10, axis=0), Settings(crop=(0.25, 0.1, 0.25, 0.1))).pixels.shape == (8, 128, 4)
    assert weighted_rank(np.array([3, 1, 2]), np.array([1, 1, 2]), 0.5) == 2
    for wrong in ({"exposure": 3.0}, {"mode": "sepia"}, {"base": (0, 1, 1)}, {"crop": (0.5, 0, 0, 0)}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_structures_and_tables(spark):
    import json

    from gleanery.sources import samples as S
    from gleanery.sources.engine import inspect, members, structures, tables

    files = spark.createDataFrame([("a", "a.jpg", bytearray(S.jpeg())), ("b", "b.docx", bytearray(S.docx())), ("c", "c", None)], "file_id string, name string, content binary")
    t = tables(inspect(files))
    assert {r["file_id"]: r["metadata_complete"] for r in t["files"].collect()} == {"a": True, "b": True, "c": True}
    assert t["facts"].where("kind = 'serial'").count() == 1 and t["nodes"].where("parent_id is null").count() == 3
    got = {r["file_id"]: json.loads(r["json"]) for r in structures(files).collect()}
    assert got["a"]["structure"]["children"] and got["c"]["size"] == 0
    assert members(files).where("parent_file_id = 'b'").count() == 3


def test_covered_text(spark):
    from gleanery.sources import samples as S
    from gleanery.sources.pages import covered_text, painted

    files = spark.createDataFrame([("a", bytearray(S.drawn_pdf())), ("b", bytearray(b"%PDF-1.4 nothing")), ("c", None)], "file_id string, content binary")
    assert [(r["file_id"], r["page"], r["text"]) for r in covered_text(files).collect()] == [("a", 0, "SECRET")]
    assert "".join(r[7] for r in painted(S.drawn_pdf()) if r[-1] and r[1] == "glyph") == "far"
