"""Office documents in archives: properties, links, hidden parts, notes, changes, and what programs and systems leave behind."""

from __future__ import annotations

import re
import struct
from html import unescape

# Elements of properties by the kind of finding they make.
PROPERTIES = {
    "creator": "author", "lastModifiedBy": "editor", "title": "title", "subject": "subject", "keywords": "keywords", "description": "description", "created": "created",
    "modified": "modified", "revision": "revisions", "category": "category", "lastPrinted": "printed", "Company": "company", "Manager": "manager", "Application": "application",
    "Template": "template", "initial-creator": "author", "creation-date": "created", "date": "modified", "generator": "application", "editing-cycles": "revisions",
    "printed-by": "editor", "print-date": "printed", "keyword": "keywords",
}
#: Characters of a list of findings that are shown before the rest is counted.
SHOWN = 4


def _text(xml: bytes) -> str:
    return unescape(re.sub(r"<[^>]*>", "", xml.decode("utf-8", "replace"))).strip()


def _listed(found: list[str]) -> str:
    names = list(dict.fromkeys(x for x in found if x))
    return ", ".join(names[:SHOWN]) + (f" and {len(names) - SHOWN} more" if len(names) > SHOWN else "")


class Parts:
    """An archive's members by name; each is unpacked when it is asked for, and a member past the bound is told."""

    def __init__(self, rows: list[dict], nodes: dict[str, int], f) -> None:
        self.rows, self.nodes, self.f = {e["name"]: e for e in rows}, nodes, f
        self.told: set[str] = set()

    def names(self, pattern: str) -> list[str]:
        return [n for n in self.rows if re.search(pattern, n)]

    def read(self, name: str) -> bytes:
        e = self.rows[name]
        got = e["unpack"](1 << 26)
        if not got.whole and not got.error and name not in self.told:
            self.told.add(name)
            self.f.bound(f"bytes of {name}", e["offset"], e["span"])
        return got.data

    def fact(self, kind: str, said: str, name: str) -> None:
        self.f.fact(kind, said, self.nodes.get(name, 0))


def properties(p: Parts) -> None:
    for name in p.names(r"^(docProps/(core|app)\.xml|meta\.xml)$"):
        body = p.read(name)
        for tag, kind in PROPERTIES.items():
            m = re.search(rf"(?s)<(?:[\w-]+:)?{tag}(?:\s[^>]*)?>(.*?)</".encode(), body)
            if m:
                p.fact(kind, _text(m[1]), name)
    for name in p.names(r"^docProps/custom\.xml$"):
        for key, value in re.findall(rb'(?s)<property\b[^>]*\bname="([^"]*)"[^>]*>(.*?)</property>', p.read(name)):
            p.fact("custom", f"{_text(key)}: {_text(value)}", name)
    for name in p.names(r"^meta\.xml$"):
        for key, value in re.findall(rb'(?s)<meta:user-defined\b[^>]*\bmeta:name="([^"]*)"[^>]*>(.*?)</meta:user-defined>', p.read(name)):
            p.fact("custom", f"{_text(key)}: {_text(value)}", name)
    for name in p.names(r"^docProps/thumbnail\.|^Thumbnails/"):
        p.fact("thumbnail", "a small picture of the document", name)


def relations(p: Parts) -> None:
    """Targets outside the document: pages, templates, other files."""
    for name in p.names(r"\.rels$"):
        sites, files = [], []
        for tag in re.findall(rb"<Relationship\b[^>]*>", p.read(name)):
            target, kind = re.search(rb'Target="([^"]*)"', tag), re.search(rb'Type="[^"]*/(\w+)"', tag)
            if b'TargetMode="External"' not in tag or not target:
                continue
            to = _text(target[1])
            if kind and kind[1] == b"attachedTemplate":
                p.fact("template", to, name)
            elif re.match(r"(?i)https?://", to):
                sites.append(re.sub(r"(?i)^https?://(?:[^/?#]*@)?([^/?#:]*).*", r"\1", to).lower())
            else:
                files.append(to)
        for kind, found in (("weblinks", sites), ("linked", files)):
            if found:
                p.fact(kind, _listed(found), name)


def parts(p: Parts) -> None:
    """What a reader does not see at once: hidden sheets, cells and slides, notes, comments, changes, files inside."""
    f = p.fact
    for name in p.names(r"^xl/workbook\.xml$"):
        hidden = [_text(m) for tag in re.findall(rb"<sheet\b[^>]*>", p.read(name)) if b'state="' in tag and b"idden" in tag for m in re.findall(rb'name="([^"]*)"', tag)]
        if hidden:
            f("hiddensheets", _listed(hidden), name)
    for name in p.names(r"^xl/worksheets/[^/]*\.xml$"):
        n = len(re.findall(rb'<(?:row|col)\b[^>]*\bhidden="(?:1|true)"', p.read(name)))
        if n:
            f("hiddencells", f"{n} hidden rows or columns", name)
    slides = [n for n in p.names(r"^ppt/slides/[^/]*\.xml$") if re.search(rb'<p:sld\b[^>]*\bshow="(?:0|false)"', p.read(n))]
    if slides:
        f("hiddenslides", f"{len(slides)} hidden slides", slides[0])
    for name in p.names(r"^ppt/notesSlides/[^/]*\.xml$"):
        said = " ".join(_text(t) for t in re.findall(rb"(?s)<a:t>(.*?)</a:t>", p.read(name))).strip()
        if said and not said.isdigit():
            f("notes", said, name)
    for name in p.names(r"^word/(footnotes|endnotes)\.xml$"):
        if re.search(rb"<w:t[ >]", p.read(name)):
            f("notes", "notes of the document", name)
    for name in p.names(r"(^|/)comments?\d*\.xml$|^word/comments\.xml$|^ppt/comments/"):
        who = [_text(x) for x in re.findall(rb'w:author="([^"]*)"|<author>(.*?)</author>', p.read(name)) for x in x]
        f("comments", f"comments by {_listed(who)}" if any(who) else "comments", name)
    for name in p.names(r"^word/(document|header\d*|footer\d*)\.xml$"):
        body = p.read(name)
        who = [_text(x) for x in re.findall(rb'<w:(?:ins|del|moveFrom|moveTo)\b[^>]*\bw:author="([^"]*)"', body)]
        if who:
            f("tracked", f"changes by {_listed(who)}", name)
        gone = " ".join(_text(x) for x in re.findall(rb"(?s)<w:delText[^>]*>(.*?)</w:delText>", body)).strip()
        if gone:
            f("deleted", gone, name)
        unseen = [_text(x) for x in re.findall(rb"(?s)<w:r\b(?:(?!</w:r>).)*?<w:vanish/>(?:(?!</w:r>).)*?<w:t[^>]*>(.*?)</w:t>", body)]
        if unseen:
            f("hiddentext", _listed(unseen), name)
    for name in p.names(r"(^|/)embeddings/[^/]+$|^Object \d+/content\.xml$"):
        f("embedded", name.rsplit("/", 1)[-1], name)
    for name in p.names(r"(?i)vbaProject\.bin$|^Basic/"):
        f("scripts", "macros", name)
    for name in p.names(r"^(customXml/item\d+|word/people)\.xml$"):
        who = [_text(x) for x in re.findall(rb'w15:author="([^"]*)"', p.read(name))]
        if who:
            f("editor", _listed(who), name)


def open_document(p: Parts) -> None:
    for name in p.names(r"^content\.xml$"):
        body = p.read(name)
        tracked = re.search(rb"(?s)<text:tracked-changes\b.*?</text:tracked-changes>", body)
        if tracked:
            who = [_text(x) for x in re.findall(rb"(?s)<dc:creator>(.*?)</dc:creator>", tracked[0])]
            p.fact("tracked", f"changes by {_listed(who)}", name)
            gone = [_text(x) for x in re.findall(rb"(?s)<text:deletion>(.*?)</text:deletion>", re.sub(rb"(?s)<office:change-info>.*?</office:change-info>", b"", tracked[0]))]
            if any(gone):
                p.fact("deleted", _listed(gone), name)
        notes = re.findall(rb"(?s)<office:annotation\b.*?</office:annotation>", body)
        if notes:
            who = [_text(x) for n in notes for x in re.findall(rb"(?s)<dc:creator>(.*?)</dc:creator>", n)]
            p.fact("comments", f"comments by {_listed(who)}", name)
        hidden = [_text(x) for x in re.findall(rb'<table:table\b[^>]*table:name="([^"]*)"[^>]*table:display="false"', body)]
        if hidden:
            p.fact("hiddensheets", _listed(hidden), name)
        sites = [re.sub(r"(?i)^https?://(?:[^/?#]*@)?([^/?#:]*).*", r"\1", _text(x)) for x in re.findall(rb'xlink:href="(https?://[^"]*)"', body)]
        if sites:
            p.fact("weblinks", _listed(sites), name)


def traces(p: Parts) -> None:
    """Printers, folders and templates that a program wrote down, and what a system keeps beside files: where they came from, labels."""
    for name in p.names(r"printerSettings\d*\.bin$"):
        said = p.read(name)[:64].decode("utf-16-le", "replace").split("\0")[0].strip()
        if said.isprintable() and said:
            p.fact("printer", said, name)
    for name in p.names(r"^(settings\.xml|word/settings\.xml|xl/workbook\.xml|xl/externalLinks/_rels/.*\.rels)$"):
        body = p.read(name)
        for x in re.findall(rb'config:name="PrinterName"[^>]*>([^<]+)<', body):
            p.fact("printer", _text(x), name)
        for x in re.findall(rb'(?:x15ac:absPath\b[^>]*\burl|w:attachedTemplate\b[^>]*\br:id|Target)="((?:file:|[A-Za-z]:\\|/Users/|/home/)[^"]*)"', body):
            p.fact("folder", _text(x), name)
    for name in p.names(r"(^|/)\.DS_Store$|(^|/)Thumbs\.db$"):
        p.fact("folder", f"a folder's own file {name}", name)
    for name in p.names(r"(^|/)\._[^/]+$"):
        body = p.read(name)
        if body[:4] != b"\0\5\x16\7":
            continue
        if b"com.apple.quarantine" in body:
            p.fact("downloaded", "marked as downloaded", name)
        where = [x.decode("latin-1") for x in re.findall(rb"https?://[\x21-\x7e]+", body)]
        if where:
            p.fact("downloaded", _listed(where), name)
        if b"kMDItemUserTags" in body or b"FinderInfo" in body:
            p.fact("label", "labels of the file manager", name)


def facts(rows: list[dict], nodes: dict[str, int], f) -> None:
    p = Parts(rows, nodes, f)
    for look in (properties, relations, parts, open_document, traces):
        look(p)


# ---- compound files: messages

# Properties of messages by the kind of finding they make.
MESSAGE = {"0037": "subject", "0C1F": "sentfrom", "0C1A": "author", "0E04": "keywords", "007D": "mailer", "3707": "attachments", "3704": "attachments"}


def message(streams: dict[str, bytes], f, root: int) -> None:
    """Facts of a message's property streams (``__substg1.0_`` and eight hex digits)."""
    for name, data in streams.items():
        m = re.fullmatch(r"__substg1\.0_([0-9A-F]{4})(001F|001E)", name)
        if m and m[1] in MESSAGE:
            said = data.decode("utf-16-le" if m[2] == "001F" else "cp1252", "replace").strip("\0 \r\n")
            if m[1] == "007D":
                for k, kind in (("X-Mailer", "mailer"), ("Reply-To", "replyto"), ("Return-Path", "returnpath")):
                    h = re.search(rf"(?mi)^{k}:\s*(.+)$", said)
                    if h:
                        f.fact(kind, h[1].strip(), root)
                continue
            f.fact(MESSAGE[m[1]], said, root)


def word_text(stream: bytes) -> tuple[int, int] | None:
    """First and last character of a Word document's text, as its header says."""
    if len(stream) < 84 or struct.unpack_from("<H", stream)[0] != 0xA5EC:
        return None
    return struct.unpack_from("<II", stream, 24)
