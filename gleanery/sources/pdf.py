"""PDF: objects, revisions, the information dictionary, and what a document holds, does and says beside its pages."""

from __future__ import annotations

import re

from gleanery.sources.pdfobj import Document, Name, Stream, text_of
from gleanery.sources.pictures import xmp

# Keys of the information dictionary, kinds of actions, by the kind of finding they make.
INFO = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "application", "Producer": "producer", "CreationDate": "created", "ModDate": "modified"}
ACTIONS = {b"JavaScript": ("scripts", "scripts"), b"Launch": ("launch", "opens a program"), b"SubmitForm": ("submits", "a form that goes out"), b"ImportData": ("submits", "reads data in")}
#: Keys without which an object holds or does nothing of interest.
_HELD, _DOES = {b"EF", b"Contents", b"URI", b"A", b"S"}, {b"S", b"A", b"AA", b"OpenAction", b"Names"}
#: Names in a list of findings before the rest is counted.
SHOWN = 4


def _listed(found: list[str]) -> str:
    names = list(dict.fromkeys(x for x in found if x))
    return ", ".join(names[:SHOWN]) + (f" and {len(names) - SHOWN} more" if len(names) > SHOWN else "")


def _text(value) -> str:
    return text_of(value) if isinstance(value, (bytes, bytearray)) and not isinstance(value, Name) else ""


def read(d: bytes, f, root: int) -> None:
    nodes, doc = {}, Document(d)
    for m in re.finditer(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b(?:.*?)\bendobj", d, re.S):
        nodes[int(m[1])] = f.node(root, f"object {int(m[1])}", m.start(), len(m[0]))
    ends = [m.start() for m in re.finditer(rb"%%EOF", d)]
    if not ends:
        f.problem("damage", "end mark missing", len(d), 0)
    elif len(d) - ends[-1] > 1024:
        f.problem("hidden", "data after the end", ends[-1] + 5, len(d) - ends[-1] - 5)
    if len(ends) > 1:
        f.fact("updates", f"{len(ends) - 1} earlier", root)
    for number, value in doc.objects.items():
        at = doc.places[number]
        if isinstance(value, Stream):
            kind = value.head.get(b"Type")
            if kind in (b"ObjStm", b"XRef") or kind == b"Metadata":
                got = value.data()
                if got.error and not doc.locked:
                    f.problem("damage", f"object {number} {got.error}", at, len(value.raw))
                elif not got.whole and not got.error:
                    f.bound(f"bytes of object {number}", at, len(value.raw))
                elif kind == b"Metadata":
                    xmp(got.data, f, nodes.get(number, root), at)
    if doc.locked:  # what it says can't be read: the result is partial
        f.problem("oddity", "a password is needed", 0, len(d))
        f.complete = False
        return _encryption(doc, f, root)
    info = doc.get(doc.trailer, b"Info")
    for key, kind in INFO.items():
        f.fact(kind, _text(doc.get(info, key.encode())), root)
    _encryption(doc, f, root)
    _held(doc, f, root)
    _form(doc, f, root)
    _done(doc, f, root)


def _encryption(doc: Document, f, root: int) -> None:
    lock = doc.get(doc.trailer, b"Encrypt")
    if b"Encrypt" not in doc.trailer:
        return
    version, bits = doc.get(lock, b"V"), doc.get(lock, b"Length") or 40
    how = {1: "RC4, 40 bits", 2: f"RC4, {bits} bits", 4: "128 bits", 5: "AES, 256 bits"}.get(version, "an unknown way")
    f.fact("encryption", f"encrypted ({how})" + ("" if doc.locked else ", opens without a password"), root)
    rights = doc.get(lock, b"P")
    if isinstance(rights, int):
        denied = [name for bit, name in ((3, "printing"), (4, "changes"), (5, "copying"), (6, "comments")) if not rights >> bit - 1 & 1]
        if denied:
            f.node(root, "not allowed", 0, 0, ", ".join(denied))


def _held(doc: Document, f, root: int) -> None:
    """Files inside, notes on pages, links."""
    files, sites, notes = [], [], 0
    for value in doc.objects.values():
        if not isinstance(value, dict) or not value.keys() & _HELD:
            continue
        if isinstance(doc.get(value, b"EF"), dict):
            files.append(_text(doc.get(value, b"UF")) or _text(doc.get(value, b"F")) or "a file")
        kind = value.get(b"Subtype")
        if kind in (b"Text", b"FreeText", b"Highlight", b"Popup", b"StrikeOut", b"Underline", b"Stamp", b"Ink") and _text(doc.get(value, b"Contents")):
            notes += 1
            who = _text(doc.get(value, b"T"))
            f.fact("comments", (f"{who}: " if who else "") + _text(doc.get(value, b"Contents")), root)
        to = _text(doc.get(value, b"URI")) if value.get(b"S") == b"URI" else _text(doc.get(value, b"A", b"URI"))
        if to:
            sites.append(to)
    if files:
        f.fact("attachments", _listed(files), root)
    for site in sorted(set(sites)):
        f.fact("weblinks", site, root)


def _form(doc: Document, f, root: int) -> None:
    form = doc.get(doc.trailer, b"Root", b"AcroForm")
    if not isinstance(form, dict):
        return
    todo, seen, filled = [*(doc.get(form, b"Fields") or [])], 0, []
    while todo and seen < 100_000:
        field = doc.get(todo.pop())
        if not isinstance(field, dict):
            continue
        seen += 1
        todo += doc.get(field, b"Kids") or []
        name, value = _text(doc.get(field, b"T")), doc.get(field, b"V")
        said = _text(value) or (value.decode("latin-1") if isinstance(value, Name) and value != b"Off" else "")
        if said:
            filled.append(f"{name}: {said}")
        if doc.get(field, b"FT") == b"Sig" and isinstance(value, dict):
            f.fact("owner", f"signed by {_text(doc.get(value, b'Name')) or 'someone'}", root)
    if todo:
        f.bound("fields of a form", 0, 0)
    f.fact("form", f"a form of {seen} fields" + (f", filled in: {_listed(sorted(filled))}" if filled else ""), root)
    if isinstance(doc.get(form, b"XFA"), (list, Stream)):
        f.node(root, "XFA form", 0, 0)


def _done(doc: Document, f, root: int) -> None:
    """What a document does by itself or when something is touched."""
    opens = doc.get(doc.trailer, b"Root", b"OpenAction")
    if isinstance(opens, dict):
        f.fact("opens", "does something when opened", root)
    found = {}
    for value in doc.objects.values():
        holder = value.head if isinstance(value, Stream) else value
        if not isinstance(holder, dict) or not holder.keys() & _DOES:
            continue
        for kind in (holder.get(b"S"), doc.get(holder, b"A", b"S"), doc.get(holder, b"OpenAction", b"S"), *(doc.get(v, b"S") for v in (doc.get(holder, b"AA") or {}).values())):
            if kind in ACTIONS:
                found[ACTIONS[kind]] = True
        if isinstance(doc.get(holder, b"Names", b"JavaScript"), dict):
            found[ACTIONS[b"JavaScript"]] = True
    for kind, said in found:
        f.fact(kind, said, root)
