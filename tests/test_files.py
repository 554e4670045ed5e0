"""Files from folders, movies with gaps, settings as documents, a folder that is watched."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from gleanery.sources import samples as S
from gleanery.sources.files import binary_files, checked_paths, read_policy, read_recipe
from gleanery.sources.movies import GappedMovies, clean_parts, gapped, joined


def test_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello")
    (tmp_path / "a" / "big.bin").write_bytes(bytes(100))
    (tmp_path / ".git" / "c").write_bytes(b"x")
    os.symlink(tmp_path / "a" / "x.txt", tmp_path / "link")
    got = {r["name"].rsplit("/", 1)[1]: (r["content"], r["error"]) for r in binary_files(spark, str(tmp_path / "a"), most_bytes=50).collect()}
    assert got == {"x.txt": (bytearray(b"hello"), None), "big.bin": (None, "too large")}
    rows = {os.path.relpath(r["path"], tmp_path): r["error"] for r in checked_paths(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert rows == {"a/big.bin": None, "a/x.txt": None, "link": "symbolic links are not followed", "none": "not there"}


def test_movies_with_gaps(spark, tmp_path):
    box = lambda n, b: struct.pack(">I", len(b) + 8) + n + b
    movie = S.mp4()
    split = movie.find(b"moov") - 4
    big = movie[:split] + box(b"mdat", bytes(5_000)) + movie[split:]
    (tmp_path / "m.mp4").write_bytes(big)
    parts, gaps, error = gapped(str(tmp_path / "m.mp4"), 1_000)
    assert error is None and gaps == [(split + 8, 5_000)] and sum(len(d) for _, d in parts) == len(big) - 5_000
    from gleanery.sources.decode import decode

    found = decode(joined(parts), "video")
    assert found.complete and ("location", "+50.4-030.5/") in {(k, t) for k, t, _ in found.facts}
    patched = bytearray(big)
    for start, data in clean_parts(parts):
        patched[start : start + len(data)] = data
    assert len(patched) == len(big) and not decode(bytes(patched), "video").facts
    spark.dataSource.register(GappedMovies)
    row = spark.read.format("gapped_movies").option("least_file", 1_000).option("least_gap", 1_000).load(str(tmp_path)).first()
    assert row["length"] == len(big) and [tuple(g) for g in row["gaps"]] == gaps
    (tmp_path / "m.mp4").write_bytes(big[:-20])
    assert gapped(str(tmp_path / "m.mp4"), 1_000)[2] == "box cut short"


def test_settings(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    assert read_policy(spark, put("p", {"schema": "gleanery.policy", "version": 1, "blocked_kinds": ["emails"]})) == {"blocked": ["emails"], "require_complete": False}
    assert read_recipe(spark, put("r", {"schema": "gleanery.film", "version": 1, "mode": "mono-negative", "exposure": 0.5})).exposure == 0.5
    for wrong in ({"schema": "x", "version": 1}, {"schema": "gleanery.policy", "version": 2}, {"schema": "gleanery.policy", "version": 1, "blocked_kinds": ["x" * 70_000]}):
        with pytest.raises(ValueError):
            read_policy(spark, put("w%d" % len(str(wrong)), wrong))


def test_pdf_says_what_it_holds():
    from gleanery.sources.decode import decode

    d = (
        b"%PDF-1.5\n1 0 obj\n<< /Type /Catalog /AcroForm << /Fields [4 0 R] >> /OpenAction << /S /JavaScript /JS (x) >> >>\nendobj\n"
        b"4 0 obj\n<< /T (name) /FT /Tx /V (Ann) >>\nendobj\n5 0 obj\n<< /Type /Filespec /F (old.txt) /UF (new.txt) /EF << /F 9 0 R >> >>\nendobj\n"
        b"6 0 obj\n<< /Subtype /Text /T (Bo) /Contents (fix this) >>\nendobj\n7 0 obj\n<< /Subtype /Link /A << /S /URI /URI (https://a.org/) >> >>\nendobj\n"
        b"trailer << /Root 1 0 R >>\n%%EOF\n"
    )
    got = {(k, t) for k, t, _ in decode(d, "pdf").facts}
    assert got == {
        ("attachments", "new.txt"), ("comments", "Bo: fix this"), ("weblinks", "https://a.org/"),
        ("form", "a form of 1 fields, filled in: name: Ann"), ("opens", "does something when opened"), ("scripts", "scripts"),
    }


def test_watched_folder(spark, tmp_path):
    from gleanery.streaming.counters import run_once, watched

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(S.jpeg())
    out = run_once(watched(spark, str(tmp_path / "in")), "watched_rows", "append", str(tmp_path / "check"))
    assert {r["text"] for r in out.where(F.col("row") == "fact").collect()} >= {"SN12345", "Cam One"}
