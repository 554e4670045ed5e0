"""Compound files (older Office documents and messages): the directory and property sets."""

from __future__ import annotations

import struct

from gleanery.sources.office import message, word_text

# Property numbers of the summary sets, by the kind of finding they make.
SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "description", 7: "template", 8: "editor", 9: "revisions", 18: "application"}
DOCUMENT = {2: "category", 14: "manager", 15: "company"}
#: Streams that tell what a compound file is.
KINDS = {"WordDocument": "Word document", "Workbook": "Excel workbook", "Book": "Excel workbook", "PowerPoint Document": "PowerPoint presentation"}
_SETS = {"\x05SummaryInformation": SUMMARY, "\x05DocumentSummaryInformation": DOCUMENT}


def _chain(fat: list[int], at: int) -> list[int]:
    out, seen = [], set()
    while at < len(fat) and at not in seen:
        seen.add(at)
        out.append(at)
        at = fat[at]
    return out


def located(d: bytes) -> dict[str, list[int]]:
    """Where in the file each byte of the property sets lies, by the sets' names."""
    if len(d) < 512:
        return {}
    size, small = 1 << struct.unpack_from("<H", d, 30)[0], 1 << struct.unpack_from("<H", d, 32)[0]
    first, cutoff, mini = (struct.unpack_from("<I", d, o)[0] for o in (48, 56, 60))
    places = lambda i: list(range((i + 1) * size, min((i + 2) * size, len(d))))
    words = lambda i: list(struct.unpack_from(f"<{size // 4}I", d, (i + 1) * size)) if (i + 2) * size <= len(d) else []
    fat = [w for i in struct.unpack_from("<109I", d, 76) if i < 0xFFFFFFFA for w in words(i)]
    short = [w for i in _chain(fat, mini) for w in words(i)]
    at = [p for i in _chain(fat, first) for p in places(i)]
    store: list[int] = []
    out = {}
    for o in range(0, len(at) - 127, 128):
        e = d[at[o] : at[o] + 128]
        name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
        start, length = struct.unpack_from("<II", e, 116)
        if e[66] == 5:
            store = [p for i in _chain(fat, start) for p in places(i)]
        elif e[66] == 2 and name in _SETS:
            whole = [p for i in _chain(short, start) for p in store[i * small : (i + 1) * small]] if length < cutoff else [p for i in _chain(fat, start) for p in places(i)]
            out[name] = whole[:length]
    return out


def read(d: bytes, f, root: int, kept: list[tuple[str, bytes]] | None = None) -> None:
    if len(d) < 512:
        f.problem("damage", "header cut short", 0, len(d))
        return
    size, small = 1 << struct.unpack_from("<H", d, 30)[0], 1 << struct.unpack_from("<H", d, 32)[0]
    first, cutoff, mini = struct.unpack_from("<I", d, 48)[0], struct.unpack_from("<I", d, 56)[0], struct.unpack_from("<I", d, 60)[0]
    sector = lambda i: d[(i + 1) * size : (i + 2) * size]
    words = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    fat = [w for i in struct.unpack_from("<109I", d, 76) if i < 0xFFFFFFFA for w in words(sector(i))]
    short = [w for i in _chain(fat, mini) for w in words(sector(i))]
    directory = b"".join(sector(i) for i in _chain(fat, first))
    streams, store = [], b""
    for o in range(0, len(directory) - 127, 128):
        e = directory[o : o + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
        kind, (start, length) = e[66], struct.unpack_from("<II", e, 116)
        if kind == 5:
            store = b"".join(sector(i) for i in _chain(fat, start))
        if kind in (1, 2, 5):
            f.node(root, name, 0, length)
            streams.append((name, kind, start, length))
    if not streams:
        f.problem("damage", "directory missing", 0, len(d))
    def body(start: int, length: int) -> bytes:
        part = [store[i * small : (i + 1) * small] for i in _chain(short, start)] if length < cutoff else [sector(i) for i in _chain(fat, start)]
        return b"".join(part)[:length]

    if kept is not None:
        kept += [(n, body(s, k)) for n, kind, s, k in streams if kind == 2]
    names = {name for name, kind, _, _ in streams if kind == 2}
    is_message = any(n.startswith("__properties_version") for n in names)
    f.node(root, "kind", 0, 0, "message" if is_message else next((k for n, k in KINDS.items() if n in names), "compound file"))
    for name, kind, start, length in streams:
        if kind == 2 and name in _SETS:
            _properties(body(start, length), _SETS[name], f, root)
    if is_message:
        message({n: body(s, k) for n, kind, s, k in streams if kind == 2 and n.startswith("__substg1.0_") and k < 1 << 20}, f, root)
    for name, kind, start, length in streams:
        if kind == 2 and name == "WordDocument" and (span := word_text(body(start, min(length, 4096)))):
            f.node(root, "text", span[0], max(0, span[1] - span[0]))
        if kind == 2 and name in ("VBA", "_VBA_PROJECT"):
            f.fact("scripts", "macros", root)


def _properties(b: bytes, kinds: dict[int, str], f, root: int) -> None:
    try:
        at = struct.unpack_from("<I", b, 44)[0]
        for i in range(min(struct.unpack_from("<I", b, at + 4)[0], 1_000)):
            key, o = struct.unpack_from("<II", b, at + 8 + 8 * i)
            type_, n = struct.unpack_from("<II", b, at + o)
            if key in kinds and type_ in (30, 31):
                raw = b[at + o + 8 : at + o + 8 + n * (2 if type_ == 31 else 1)]
                f.fact(kinds[key], raw.decode("utf-16-le" if type_ == 31 else "cp1252", "replace").strip("\0"), root)
    except struct.error:
        f.problem("damage", "properties cut short", 0, len(b))


def attachments(d: bytes) -> list[tuple[str, bytes]]:
    """Attachments of a message: the streams with their data (3701) and their names (3707 or 3704), in order."""
    streams: list[tuple[str, bytes]] = []

    class Kept:
        def node(self, *_):
            return 0

        def problem(self, *_):
            pass

        fact = bound = problem

    read(d, Kept(), 0, streams)
    names = [x.decode("utf-16-le", "replace").strip("\0") for n, x in streams if n in ("__substg1.0_3707001F", "__substg1.0_3704001F")]
    data = [x for n, x in streams if n == "__substg1.0_37010102"]
    return [(names[i] if i < len(names) else "", x) for i, x in enumerate(data)]
