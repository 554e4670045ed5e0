"""PDF objects as Python values, and files written anew from them."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from gleanery.sources.unpack import Unpacked, stream_data

_SPACE = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_PLAIN = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


_FOLLOW = re.compile(rb"\s+(\d{1,5})\s+R\b")
_BEGIN, _END = re.compile(rb"\s*stream\r?\n"), re.compile(rb"\s*endstream")
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_SIMPLE = re.compile(rb"\(([^()\\]*)\)")
_WORDS = {b"true": True, b"false": False, b"null": None}


class Name(bytes):
    """A name without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes

    def data(self, kept: int = 1 << 24) -> Unpacked:
        return stream_data(written(self.head), self.raw, kept)


class Reader:
    """Values out of bytes, one after another; what is no value is an operator (plain bytes)."""

    def __init__(self, d: bytes, at: int = 0) -> None:
        self.d, self.at = d, at

    def skip(self) -> None:
        self.at = _SPACE.match(self.d, self.at).end()

    def value(self, depth: int = 0):
        self.skip()
        d, at = self.d, self.at
        c = d[at : at + 1]
        if not c:
            raise EOFError
        if depth > 64:
            raise ValueError("nested too deep")
        if d[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if self.d[self.at : self.at + 2] == b">>":
                    self.at += 2
                    return out
                key = self.value(depth + 1)
                if isinstance(key, Name):
                    out[bytes(key)] = self.value(depth + 1)
        if c == b"[":
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if self.d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.value(depth + 1))
        if c == b"(":
            return self.string()
        if c == b"<":
            end = d.find(b">", at)
            self.at = (end if end >= 0 else len(d)) + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : self.at])
            return bytearray.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            m = _PLAIN.match(d, at + 1)
            self.at = m.end() if m else at + 1
            name = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name) if b"#" in name else name)
        m = _PLAIN.match(d, at)
        self.at = m.end() if m else at + 1
        word = m[0] if m else c
        if _NUMBER.match(word):
            follow = _FOLLOW.match(d, self.at) if word.isdigit() else None
            if follow:
                self.at = follow.end()
                return Ref(int(word))
            return float(word) if b"." in word else int(word)
        return _WORDS.get(word, word)

    def string(self) -> bytearray:
        if m := _SIMPLE.match(self.d, self.at):  # without escapes and brackets inside
            self.at = m.end()
            return bytearray(m[1])
        depth, at, out, d = 1, self.at + 1, bytearray(), self.d
        while at < len(d):
            c = d[at : at + 1]
            if c == b"\\":
                m = _ESCAPE.match(d, at)
                if not m:
                    break
                out += bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])
                at = m.end()
                continue
            depth += {b"(": 1, b")": -1}.get(c, 0)
            at += 1
            if not depth:
                break
            out += c
        self.at = at
        return out


def parsed(d: bytes) -> dict[int, tuple[int, object]]:
    """Each object by number, as (position, value): the last definition. What can't be read is left out."""
    out: dict[int, tuple[int, object]] = {}
    for m in _OBJECT.finditer(d):
        r = Reader(d, m.end())
        try:
            value = r.value()
        except (EOFError, ValueError):
            continue
        if isinstance(value, dict):
            s = _BEGIN.match(d, r.at)
            if s:
                n = value.get(b"Length")
                end = s.end() + n if isinstance(n, int) and _END.match(d, s.end() + n) else d.find(b"endstream", s.end())
                raw = d[s.end() : end if end >= 0 else len(d)]
                value = Stream(value, raw if isinstance(n, int) and len(raw) == n else re.sub(rb"\r?\n$", b"", raw))
        out[int(m[1])] = (m.start(), value)
    return out


def unpacked(out: dict[int, tuple[int, object]]) -> None:
    """Adds the objects that stand in object streams."""
    for at, value in list(out.values()):
        if isinstance(value, Stream) and value.head.get(b"Type") == b"ObjStm":
            data, first = value.data().data, value.head.get(b"First", 0)
            heads = data[:first].split() if isinstance(first, int) else []
            for number, o in zip(heads[::2], heads[1::2]):
                if number.isdigit() and o.isdigit() and (int(number) not in out or out[int(number)][0] < at):
                    try:
                        out[int(number)] = (at, Reader(data, first + int(o)).value())
                    except (EOFError, ValueError):
                        continue


def written(value) -> bytes:
    if isinstance(value, Stream):
        return written(value.head | {b"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    if isinstance(value, dict):
        return b"<< " + b" ".join(b"/" + k + b" " + written(v) for k, v in value.items()) + b" >>"
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], bytes(value))
    if isinstance(value, bytearray):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, float):
        return b"%.6g" % value if abs(value) < 1e5 else b"%.3f" % value
    return {True: b"true", False: b"false", None: b"null"}[value] if value is None or isinstance(value, bool) else b"%d" % value if isinstance(value, int) else bytes(value)


class Document:
    """A file's objects. ``locked``: it is encrypted and a password is needed; one that opens without is read in clear."""

    def __init__(self, d: bytes) -> None:
        found = parsed(d)
        self.objects = {n: v for n, (_, v) in found.items()}
        self.trailer: dict = {}
        for m in re.finditer(rb"\btrailer\b", d):
            try:
                t = Reader(d, m.end()).value()
                self.trailer |= t if isinstance(t, dict) else {}
            except (EOFError, ValueError):
                continue
        for v in self.objects.values():
            if isinstance(v, Stream) and v.head.get(b"Type") == b"XRef":
                self.trailer |= {k: v.head[k] for k in (b"Root", b"Info", b"Encrypt", b"ID") if k in v.head}
        self.locked = b"Encrypt" in self.trailer and not self._unlock(found)
        unpacked(found)
        self.places, self.objects = {n: at for n, (at, _) in found.items()}, {n: v for n, (_, v) in found.items()}

    def _unlock(self, found: dict) -> bool:
        from gleanery.sources.pdflock import Lock

        ids = self.get(self.trailer, b"ID", 0)
        try:
            lock = Lock(self, bytes(ids) if isinstance(ids, (bytes, bytearray)) else b"")
        except (TypeError, ValueError, IndexError, OverflowError):
            return False
        if lock.key is None:
            return False
        own = self.trailer[b"Encrypt"].number if isinstance(self.trailer[b"Encrypt"], Ref) else None

        def clear(value, number: int):
            if isinstance(value, bytearray):
                return bytearray(lock.opened(bytes(value), number))
            if isinstance(value, dict):
                return {k: clear(v, number) for k, v in value.items()}
            if isinstance(value, list):
                return [clear(v, number) for v in value]
            if isinstance(value, Stream):
                raw = value.raw if value.head.get(b"Type") == b"XRef" else lock.opened(value.raw, number)
                return Stream(clear(value.head, number), raw)
            return value

        for n, (at, value) in list(found.items()):
            if n != own:
                found[n] = (at, clear(value, n))
        return True

    def get(self, value, *path):
        """``value`` itself or what it refers to, then the entries of ``path``; None where there is none."""
        for key in (None, *path):
            if key is not None:
                holder = value.head if isinstance(value, Stream) else value
                value = holder.get(key) if isinstance(holder, dict) else holder[key] if isinstance(holder, list) and isinstance(key, int) and key < len(holder) else None
            for _ in range(16):
                if not isinstance(value, Ref):
                    break
                value = self.objects.get(value.number)
        return value

    def pages(self) -> list[dict]:
        """Pages in reading order, with what they inherit; in order of their objects where the tree does not hold."""
        out, seen = [], set()

        def walk(value, above: dict, depth: int) -> None:
            node = self.get(value)
            if not isinstance(node, dict) or id(node) in seen or depth > 64:
                return
            seen.add(id(node))
            here = {k: node[k] for k in (b"MediaBox", b"Resources", b"Rotate", b"CropBox") if k in node}
            kids = self.get(node, b"Kids")
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, above | here, depth + 1)
            elif node.get(b"Type") == b"Page" or b"Contents" in node:
                out.append(above | node)

        walk(self.get(self.trailer, b"Root", b"Pages"), {}, 0)
        if not out:
            out = [v for v in self.objects.values() if isinstance(v, dict) and v.get(b"Type") == b"Page"]
        return out

    def contents(self, page: dict) -> list[Stream]:
        c = self.get(page, b"Contents")
        return [s for s in (map(self.get, c) if isinstance(c, list) else [c]) if isinstance(s, Stream)]

    def bytes(self) -> bytes:
        """The file written anew: objects in order, one table, no earlier revisions."""
        out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        for n, value in sorted(self.objects.items()):
            if isinstance(value, Stream) and value.head.get(b"Type") in (b"ObjStm", b"XRef"):
                continue
            places[n] = len(out)
            out += b"%d 0 obj\n" % n + written(value) + b"\nendobj\n"
        size, at = max(places, default=0) + 1, len(out)
        rows = b"".join(b"%010d %05d %s \n" % (places.get(n, 0), 0 if n in places else 65535, b"n" if n in places else b"f") for n in range(size))
        head = {k: v for k, v in self.trailer.items() if k in (b"Root", b"Info")} | {b"Size": size}
        return bytes(out) + b"xref\n0 %d\n" % size + rows + b"trailer\n" + written(head) + b"\nstartxref\n%d\n%%%%EOF\n" % at


def text_of(value) -> str:
    """A string of a document's own texts: UTF-16 with its mark, else one byte a letter."""
    b = bytes(value) if isinstance(value, (bytes, bytearray)) else b""
    return b.decode("utf-16", "replace") if b[:2] in (b"\xfe\xff", b"\xff\xfe") else b[3:].decode("utf-8", "replace") if b[:3] == b"\xef\xbb\xbf" else b.decode("latin-1")


def packed(data: bytes) -> Stream:
    return Stream({b"Filter": Name(b"FlateDecode")}, zlib.compress(data, 9))
