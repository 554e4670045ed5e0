from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.sources import samples as S
from gleanery.sources.decode import DECODERS, decode
from gleanery.sources.rewrite import CLEANERS, clean, repair


def facts(content, form):
    return {(k, t) for k, t, _ in decode(content, form).facts}


def test_facts_of_samples():
    assert ("serial", "SN12345") in facts(S.jpeg(), "jpeg") and ("location", "50.45000, 30.50000") in facts(S.jpeg(), "jpeg")
    assert facts(S.gif(), "gif") == {("comments", "hello")}
    assert {("artist", "Ann"), ("title", "Song")} == facts(S.wav(), "wav")
    assert {("author", "Vera K"), ("title", "Plan")} == facts(S.docx(), "zip")
    assert ("title", "Air") in facts(S.flac(), "flac") and ("title", "Tune") in facts(S.mp3(), "mp3")
    assert ("location", "+50.4-030.5/") in facts(S.mp4(), "video") and facts(S.wasm(), "wasm") == {("sourcemap", "a.map")}
    assert {("title", "Note"), ("author", "Zed")} <= facts(S.pdf(), "pdf")
    assert {("author", "Ivo"), ("created", "2024-02-03 04:05")} <= facts(S.rtf(), "rtf")
    mail = facts(S.eml(), "eml")
    assert {("sentfrom", "93.184.216.34"), ("computer", "laptop-x1"), ("timezone", "UTC+02:00"), ("mailer", "Quill 1"), ("authclaim", "spf=pass")} <= mail
    assert {"linkmismatch", "riskyfile", "replyto", "weblinks"} <= {k for k, _ in mail}
    assert ("original", "/home/vera/a.png") in facts(S.svg(), "svg")
    assert facts(b"/Users/olena/x me@site.org git@a.org icon@2x.png", "unknown") == {("account", "olena"), ("emails", "me@site.org")}


def test_damage_and_hidden():
    cut = decode(S.png()[:-8], "png")
    assert not cut.complete and cut.problems[0][0] == "damage"
    tail = decode(S.png() + b"x", "png")
    assert tail.complete and ("hidden", "data after the image") == tail.problems[0][:2]
    assert not decode(S.docx()[:-30], "zip").complete


def test_node_limit_adds_one_node():
    f = decode(S.png(), "png", most=3)
    assert len(f.nodes) == 4 and f.nodes[-1][2] == "limit reached" and not f.complete


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(sorted(DECODERS)))
def test_any_bytes_have_a_root(data, form):
    f = decode(data, form)
    assert f.nodes and f.nodes[0][1] is None
    assert all(p is None or p < n for n, p, *_ in f.nodes)


def test_mutated_samples_never_raise():
    forms = {"png": S.png, "jpeg": S.jpeg, "gif": S.gif, "wav": S.wav, "zip": S.docx, "flac": S.flac, "mp3": S.mp3, "video": S.mp4, "wasm": S.wasm, "pdf": S.pdf, "rtf": S.rtf, "eml": S.eml, "svg": S.svg, "tiff": S.exif}
    for form, make in forms.items():
        d = make()
        for n in range(len(d)):
            assert decode(d[:n], form).nodes
            clean(d[:n], form)


def test_clean_copies_reveal_nothing():
    for form, make in {"jpeg": S.jpeg, "gif": S.gif, "wav": S.wav, "zip": S.docx, "flac": S.flac, "mp3": S.mp3}.items():
        copy, gone, error = clean(make(), form)
        assert error is None and gone and not facts(copy, form), form
    assert set(CLEANERS) <= set(DECODERS)


def test_repair():
    broken = bytearray(S.png())
    broken[30] ^= 1
    fixed, done = repair(bytes(broken[:-12]), "png")
    assert decode(fixed, "png").complete and done
    fixed, done = repair(S.docx()[:-30], "zip")
    assert decode(fixed, "zip").complete and done == ["directory"]
