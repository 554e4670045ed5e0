"""Redaction of PDF pages: what lies in given areas is taken out of the content itself, then painted over."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.pages import Painter, common, page_box
from gleanery.sources.pdfobj import Document, Name, Reader, Ref, Stream, packed, written
from gleanery.sources.rewrite import Refused

Area = tuple[int, float, float, float, float]
#: Share of a glyph in an area from which on it goes.
INSIDE = 0.25


def _hit(box, areas) -> bool:
    size = max(1e-9, (box[2] - box[0]) * (box[3] - box[1]))
    return any((c[2] - c[0]) * (c[3] - c[1]) >= INSIDE * size for a in areas if (c := common(box, a))[0] < c[2] and c[1] < c[3])


def _kept(raw: bytes, glyphs: list, font, state, areas) -> list | None:
    """A shown string as the operand of ``TJ``, gone glyphs as gaps; None where none is in an area."""
    gone = [_hit(box, areas) for _, box, _, _ in glyphs]
    if not any(gone):
        return None
    out: list = []
    step = 2 if font.wide else 1
    for (at, _, w, _), away in zip(glyphs, gone):
        code = raw[at : at + step]
        if away:
            gap = -(w + state.spread + (state.word if code == b" " else 0)) / (state.size or 1) * 1000
            if out and isinstance(out[-1], float):
                out[-1] += gap
            else:
                out.append(gap)
        elif out and isinstance(out[-1], bytearray):
            out[-1] += code
        else:
            out.append(bytearray(code))
    return out


def _rewritten(doc: Document, page: dict, areas: list) -> tuple[bytes, int]:
    """The page's content without the glyphs in ``areas``, and how many there were."""
    resources = doc.get(page, b"Resources")
    data = b"\n".join(s.data().data for s in doc.contents(page))
    heard: list = []
    p = Painter(doc, page_box(doc, page), lambda *x: heard.append(x))
    reader, stack, out, n = Reader(data), [], bytearray(), 0
    begin = 0
    while True:
        try:
            v = reader.value()
        except EOFError:
            break
        except ValueError:
            continue
        if type(v) is not bytes:
            stack.append(v)
            continue
        heard.clear()
        if v == b"BI":
            p.rows.clear()
            p.run(data[begin : data.find(b"EI", reader.at) + 3], resources)
            if any(_hit(r[2:6], areas) or _hit(areas[0], [r[2:6]]) for r in p.rows):
                raise Refused("covered")
            reader.at = data.find(b"EI", reader.at) + 2
        else:
            first = len(p.rows)
            p.operate(v, stack, resources, 0)
            if v == b"Do" and any(r[0] in ("image", "glyph") and any(_hit(r[2:6], [a]) or _hit(a, [r[2:6]]) for a in areas) for r in p.rows[first:]):
                raise Refused("covered")
        new = [_kept(raw, glyphs, font, state, areas) for raw, glyphs, font, state in heard]
        if any(x is not None for x in new) and v in (b"Tj", b"'", b'"', b"TJ"):
            strings = iter(new)
            plain = stack[-1] if v == b"TJ" else [stack[-1]]
            parts: list = []
            for x in plain:
                if not isinstance(x, bytearray):
                    parts.append(x)
                    continue
                kept = next(strings)
                parts += [x] if kept is None else kept
            n += sum(sum(_hit(b, areas) for _, b, _, _ in glyphs) for _, glyphs, _, _ in heard)
            lead = b"" if v in (b"Tj", b"TJ") else b"T* " if v == b"'" else written(stack[0]) + b" Tw " + written(stack[1]) + b" Tc T* "
            out += b"\n" + lead + written(parts) + b" TJ"
        else:
            out += data[begin : reader.at]
        begin, stack = reader.at, []
    out += b"\nq 0 g " + b" ".join(b"%.3f %.3f %.3f %.3f re f" % (a[0], a[1], a[2] - a[0], a[3] - a[1]) for a in areas) + b" Q\n"
    return b"q " + bytes(out) + b" Q", n


def redact(d: bytes, areas: list[Area]) -> tuple[bytes, int]:
    """``d`` written anew without the text in ``areas`` (page from 0, left, bottom, right, top), and the number of glyphs taken out.

    Pictures and forms in an area are not changed here: the file is refused (``covered``), and so are locked ones (``locked``). Links and
    marks that touch an area go. Earlier revisions and metadata do not come along.
    """
    doc = Document(d)
    if b"Encrypt" in doc.trailer:
        raise Refused("locked")
    pages, total = doc.pages(), 0
    if not pages or any(not 0 <= a[0] < len(pages) for a in areas):
        raise Refused("incomplete")
    number = max(doc.objects, default=0) + 1
    owners = {id(v): n for n, v in doc.objects.items()}
    for i, page in enumerate(pages):
        mine = [a[1:] for a in areas if a[0] == i]
        if not mine:
            continue
        data, n = _rewritten(doc, page, mine)
        total += n
        for s in doc.contents(page):
            doc.objects.pop(owners.get(id(s), -1), None)
        doc.objects[number] = packed(data)
        target = next((v for v in doc.objects.values() if isinstance(v, dict) and v.get(b"Contents") == page.get(b"Contents") and v.get(b"Type") == page.get(b"Type")), None)
        if target is None:
            raise Refused("incomplete")
        target[b"Contents"] = Ref(number)
        notes = [a for a in doc.get(target, b"Annots") or [] if not _touches(doc.get(a, b"Rect"), mine)]
        target[b"Annots"] = notes
        number += 1
    doc.trailer.pop(b"Info", None)
    root = doc.get(doc.trailer, b"Root")
    if isinstance(root, dict):
        root.pop(b"Metadata", None)
    doc.objects = {k: v for k, v in doc.objects.items() if not (isinstance(v, Stream) and v.head.get(b"Type") == Name(b"Metadata"))}
    return doc.bytes(), total


def _touches(rect, areas) -> bool:
    if not isinstance(rect, list) or len(rect) != 4:
        return False
    x0, y0, x1, y1 = (float(v) if isinstance(v, (int, float)) else 0.0 for v in rect)
    box = min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)
    return any((c := common(box, a))[0] < c[2] and c[1] < c[3] for a in areas)


def places(d: bytes, words: str) -> list[Area]:
    """Where ``words`` stand on the pages, letter case aside, as areas; blanks of the page's own do not matter."""
    from gleanery.sources.pages import painted

    want, out = words.replace(" ", "").lower(), []
    rows = [r for r in painted(d) if r[1] == "glyph"]
    for page in sorted({r[0] for r in rows}):
        glyphs = [r for r in rows if r[0] == page and (r[7] or "").strip()]
        text = "".join((r[7] or "")[:1].lower() for r in glyphs)
        at = text.find(want)
        while want and at >= 0:
            found = glyphs[at : at + len(want)]
            lines: list[list] = []
            for g in found:  # a new line, a new area
                if lines and abs(lines[-1][-1][4] - g[4]) < 1:
                    lines[-1].append(g)
                else:
                    lines.append([g])
            out += [(page, min(g[3] for g in line), min(g[4] for g in line), max(g[5] for g in line), max(g[6] for g in line)) for line in lines]
            at = text.find(want, at + 1)
    return out


def redacted(files: DataFrame, words: list[str]) -> DataFrame:
    """PDF files (file_id, content) without the given words: ``file_id, copy, removed, error``; ``error`` is ``left`` where the copy, read
    again, still has one of them, and then there is no copy."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                copy, n, error = None, 0, None
                try:
                    areas = [a for w in words for a in places(content, w)]
                    if not areas:
                        error = "nothing"
                    else:
                        copy, n = redact(content, areas)
                        if any(places(copy, w) for w in words):
                            copy, error = None, "left"
                except Refused as e:
                    error = str(e)
                except (ValueError, IndexError, TypeError, KeyError, RecursionError, OverflowError):
                    error = "damaged"
                row = (ident, copy, n, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.binary(), pa.int64(), pa.string()))], names=["file_id", "copy", "removed", "error"])

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, "file_id string, copy binary, removed bigint, error string")
