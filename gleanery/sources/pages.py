"""PDF pages painted: glyph boxes, filled boxes and images in the order in which they are drawn, forms and transparency included.

The tables are those that ``operators.geometry`` joins. Page marks that are no painting (links, redaction marks) come along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.pdfobj import Document, Name, Reader, Stream, text_of

#: Operations of one page, and forms inside forms. Beyond them a row of kind ``limit`` says so.
MOST_OPERATIONS, MOST_FORMS = 1_000_000, 12

SCHEMA = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("page", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ordinal", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in "lbrt"], T.StructField("text", T.StringType()), T.StructField("lightness", T.DoubleType()),
    T.StructField("alpha", T.DoubleType()), T.StructField("mode", T.IntegerType()), T.StructField("off_page", T.BooleanType()),
])
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.bool_()]


def objects(d: bytes) -> dict[int, bytes]:
    """The last definition of each object as bytes, those in object streams too."""
    from gleanery.sources.pdfobj import written

    return {n: written(v) for n, v in Document(d).objects.items()}


def stream(body: bytes) -> bytes | None:
    """The data of an object that is a stream; None for others and where it does not unpack."""
    try:
        r = Reader(body)
        head = r.value()
    except (EOFError, ValueError):
        return None
    m = re.compile(rb"\s*stream\r?\n(.*?)\r?\n?endstream", re.S).match(body, r.at)
    if not m or not isinstance(head, dict):
        return None
    got = Stream(head, m[1]).data()
    return None if got.error and not got.data else got.data


def times(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def box_of(m, x0, y0, x1, y1):
    xs, ys = zip(*[(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (x0, x1) for y in (y0, y1)])
    return min(xs), min(ys), max(xs), max(ys)


def common(a, b):
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


class Font:
    """How a font's codes advance and what they mean."""

    def __init__(self, doc: Document, font) -> None:
        self.wide = doc.get(font, b"Subtype") == b"Type0"
        self.widths: dict[int, float] = {}
        self.missing = 500.0
        if self.wide:
            inner = doc.get(font, b"DescendantFonts", 0)
            self.missing = float(doc.get(inner, b"DW") or 1000)
            rows, i = doc.get(inner, b"W") or [], 0
            while i + 1 < len(rows):
                first, second = doc.get(rows[i]), doc.get(rows[i + 1])
                if isinstance(second, list):
                    self.widths |= {first + k: float(w) for k, w in enumerate(second) if isinstance(w, (int, float))}
                    i += 2
                elif i + 2 < len(rows):
                    self.widths |= dict.fromkeys(range(first, min(second, first + 65_535) + 1), float(doc.get(rows[i + 2]) or 0))
                    i += 3
                else:
                    break
        else:
            first = doc.get(font, b"FirstChar") or 0
            for k, w in enumerate(doc.get(font, b"Widths") or []):
                if isinstance(w := doc.get(w), (int, float)):
                    self.widths[first + k] = float(w)
        self.letters = self._letters(doc.get(font, b"ToUnicode"))

    @staticmethod
    def _letters(table) -> dict[int, str]:
        out: dict[int, str] = {}
        if not isinstance(table, Stream):
            return out
        text = table.data().data
        u = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", text):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                out[int(a, 16)] = u(b)
        for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", text):
            for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                for k in range(min(int(z, 16) - int(a, 16), 65_535) + 1):
                    out[int(a, 16) + k] = u(b"%0*X" % (len(b), int(b, 16) + k))
            for a, items in re.findall(rb"<([0-9A-Fa-f]+)>\s*<[0-9A-Fa-f]+>\s*\[([^\]]*)\]", block):
                out |= {int(a, 16) + k: u(b) for k, b in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", items))}
        return out

    def codes(self, raw: bytes):
        step = 2 if self.wide else 1
        for i in range(0, len(raw) - step + 1, step):
            code = int.from_bytes(raw[i : i + step], "big")
            said = self.letters.get(code)
            yield i, code, said if said is not None else chr(code) if self.wide else bytes([code]).decode("cp1252", "replace")


@dataclass(frozen=True)
class State:
    m: tuple = (1, 0, 0, 1, 0, 0)
    fill: float = 0.0
    alpha: float = 1.0
    mode: int = 0
    font: Font | None = None
    size: float = 1.0
    lead: float = 0.0
    spread: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    rise: float = 0.0
    clip: tuple = (-1e9, -1e9, 1e9, 1e9)


class Painter:
    """One page's state; ``rows`` is what it has drawn. ``on_show`` hears of each shown string with its glyphs."""

    def __init__(self, doc: Document, box, on_show=None) -> None:
        self.doc, self.box, self.rows, self.on_show = doc, box, [], on_show
        self.s, self.saved = State(), []
        self.tm = self.line = None
        self.path: list[tuple] = []
        self.rects: list[tuple] = []
        self.clipping, self.operations, self.fonts = False, 0, {}

    def add(self, kind: str, box, text: str | None = None) -> None:
        s = self.s
        l, b, r, t = common(box, s.clip) if kind != "glyph" else box
        if kind != "glyph" and (l >= r or b >= t):
            return
        off = r <= self.box[0] or l >= self.box[2] or t <= self.box[1] or b >= self.box[3]
        middle = (l + r) / 2, (b + t) / 2
        off |= kind == "glyph" and not (s.clip[0] <= middle[0] <= s.clip[2] and s.clip[1] <= middle[1] <= s.clip[3])
        self.rows.append((kind, len(self.rows), l, b, r, t, text, s.fill, s.alpha, s.mode, off))

    def advance(self, x: float) -> None:
        self.tm = times((1, 0, 0, 1, x, 0), self.tm)

    def show(self, raw: bytes) -> None:
        if self.tm is None:
            return
        s, glyphs = self.s, []
        font = s.font or _PLAIN_FONT
        for at, code, said in font.codes(raw):
            w = font.widths.get(code, font.missing) / 1000 * s.size
            box = box_of(times(self.tm, s.m), 0, s.rise, w * s.stretch, s.rise + s.size)
            glyphs.append((at, box, w, len(self.rows)))
            self.add("glyph", box, said)
            self.advance((w + s.spread + (s.word if code == 32 and not font.wide else 0)) * s.stretch)
        if self.on_show:
            self.on_show(raw, glyphs, font, s)

    def move(self, x: float, y: float) -> None:
        self.line = self.tm = times((1, 0, 0, 1, x, y), self.line or (1, 0, 0, 1, 0, 0))

    def run(self, data: bytes, resources, depth: int = 0) -> None:
        reader, stack = Reader(data), []
        while True:
            try:
                v = reader.value()
            except EOFError:
                return
            except ValueError:
                continue
            if type(v) is not bytes:
                stack.append(v)
                continue
            self.operations += 1
            if self.operations > MOST_OPERATIONS:
                self.rows.append(("limit", len(self.rows), 0.0, 0.0, 0.0, 0.0, "operations", 0.0, 1.0, 0, False))
                return
            if v == b"BI":
                end = re.compile(rb"\sEI(?=[\s]|$)").search(data, reader.at)
                self.add("image", box_of(self.s.m, 0, 0, 1, 1))
                reader.at = end.end() if end else len(data)
            else:
                self.operate(v, stack, resources, depth)
            stack = []

    def rectangle(self) -> tuple | None:
        """The path as a box, if its corners are those of an upright rectangle."""
        corners = {(round(x, 3), round(y, 3)) for x, y in self.path}
        xs, ys = {x for x, _ in corners}, {y for _, y in corners}
        return (min(xs), min(ys), max(xs), max(ys)) if len(corners) == 4 and len(xs) == len(ys) == 2 else None

    def painted(self, fills: bool) -> None:
        extra = self.rectangle()
        boxes = self.rects + ([extra] if extra else [])
        if fills:
            for box in boxes:
                self.add("fill", box)
        if self.clipping and boxes:
            low = boxes[0]
            for box in boxes[1:]:
                low = min(low[0], box[0]), min(low[1], box[1]), max(low[2], box[2]), max(low[3], box[3])
            self.s = replace(self.s, clip=common(self.s.clip, low))
        self.path, self.rects, self.clipping = [], [], False

    def operate(self, op: bytes, stack: list, resources, depth: int) -> None:
        n, s = [float(x) for x in stack if isinstance(x, (int, float)) and not isinstance(x, bool)], self.s
        point = lambda x, y: (x * s.m[0] + y * s.m[2] + s.m[4], x * s.m[1] + y * s.m[3] + s.m[5])
        if op == b"q":
            self.saved.append(s)
        elif op == b"Q":
            self.s = self.saved.pop() if self.saved else s
        elif op == b"cm" and len(n) == 6:
            self.s = replace(s, m=times(tuple(n), s.m))
        elif op == b"gs" and stack:
            state = self.doc.get(resources, b"ExtGState", bytes(stack[-1])) if isinstance(stack[-1], Name) else None
            alpha = self.doc.get(state, b"ca")
            masked = isinstance(self.doc.get(state, b"SMask"), dict)
            if masked or isinstance(alpha, (int, float)):
                self.s = replace(s, alpha=0.0 if masked else float(alpha))
        elif op in (b"g", b"sc", b"scn") and len(n) == 1:
            self.s = replace(s, fill=n[0])
        elif op in (b"rg", b"sc", b"scn") and len(n) == 3:
            self.s = replace(s, fill=0.2126 * n[0] + 0.7152 * n[1] + 0.0722 * n[2])
        elif op in (b"k", b"sc", b"scn") and len(n) == 4:
            self.s = replace(s, fill=(1 - min(1.0, n[3])) * (1 - (n[0] + n[1] + n[2]) / 3))
        elif op in (b"sc", b"scn"):
            self.s = replace(s, fill=0.5)  # a pattern: neither dark nor paper
        elif op == b"re" and len(n) == 4:
            self.rects.append(box_of(s.m, n[0], n[1], n[0] + n[2], n[1] + n[3]))
        elif op in (b"m", b"l") and len(n) == 2:
            self.path = [*(self.path if op == b"l" else []), point(*n)]
        elif op in (b"c", b"v", b"y"):
            self.path.append((float(len(self.path)), -1e7 - len(self.path)))  # a curve is no rectangle
        elif op in (b"W", b"W*"):
            self.clipping = True
        elif op in (b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
            self.painted(True)
        elif op in (b"n", b"S", b"s"):
            self.painted(False)
        elif op == b"BT":
            self.tm = self.line = (1, 0, 0, 1, 0, 0)
        elif op == b"ET":
            self.tm = None
        elif op == b"Tf" and n:
            name = bytes(stack[0]) if isinstance(stack[0], Name) else b""
            font = self.doc.get(resources, b"Font", name)
            key = id(font)
            if font is not None and key not in self.fonts:
                self.fonts[key] = Font(self.doc, font)
            self.s = replace(s, font=self.fonts.get(key), size=n[-1])
        elif op in (b"TL", b"Tc", b"Tw", b"Tz", b"Ts", b"Tr") and n:
            field = {b"TL": "lead", b"Tc": "spread", b"Tw": "word", b"Tz": "stretch", b"Ts": "rise", b"Tr": "mode"}[op]
            self.s = replace(s, **{field: n[-1] / 100 if op == b"Tz" else int(n[-1]) if op == b"Tr" else n[-1]})
        elif op in (b"Td", b"TD") and len(n) == 2:
            self.s = replace(s, lead=-n[1]) if op == b"TD" else s
            self.move(*n)
        elif op == b"Tm" and len(n) == 6:
            self.tm = self.line = tuple(n)
        elif op == b"T*":
            self.move(0, -s.lead)
        elif op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytearray):
            if op == b'"' and len(n) >= 2:
                self.s = s = replace(s, word=n[0], spread=n[1])
            if op != b"Tj":
                self.move(0, -s.lead)
            self.show(bytes(stack[-1]))
        elif op == b"TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, bytearray):
                    self.show(bytes(x))
                elif self.tm is not None and isinstance(x, (int, float)):
                    self.advance(-x / 1000 * s.size * s.stretch)
        elif op == b"Do" and stack and isinstance(stack[-1], Name):
            what = self.doc.get(resources, b"XObject", bytes(stack[-1]))
            if isinstance(what, Stream) and what.head.get(b"Subtype") == b"Form":
                if depth >= MOST_FORMS:
                    self.rows.append(("limit", len(self.rows), 0.0, 0.0, 0.0, 0.0, "forms", 0.0, 1.0, 0, False))
                    return
                matrix, frame = self.doc.get(what, b"Matrix"), self.doc.get(what, b"BBox")
                m = times(tuple(map(float, matrix)), s.m) if isinstance(matrix, list) and len(matrix) == 6 else s.m
                clip = common(s.clip, box_of(m, *map(float, frame))) if isinstance(frame, list) and len(frame) == 4 else s.clip
                kept = self.s, self.saved, self.tm, self.line
                self.s, self.saved = replace(s, m=m, clip=clip), []
                self.run(what.data().data, self.doc.get(what, b"Resources") or resources, depth + 1)
                self.s, self.saved, self.tm, self.line = kept
            else:
                self.add("image", box_of(s.m, 0, 0, 1, 1))


class _Plain:
    wide, widths, missing, letters = False, {}, 500.0, {}
    codes = Font.codes


_PLAIN_FONT = _Plain()


def page_box(doc: Document, page: dict) -> tuple[float, float, float, float]:
    box = doc.get(page, b"MediaBox")
    numbers = [float(x) for x in map(doc.get, box)] if isinstance(box, list) and len(box) == 4 and all(isinstance(doc.get(x), (int, float)) for x in box) else [0.0, 0.0, 612.0, 792.0]
    return min(numbers[0], numbers[2]), min(numbers[1], numbers[3]), max(numbers[0], numbers[2]), max(numbers[1], numbers[3])


def painted(d: bytes) -> list[tuple]:
    """(page, kind, ordinal, l, b, r, t, text, lightness, alpha, mode, off_page) of all pages: glyph, fill, image, then link and mark (their
    text is where they go to), and page itself."""
    doc, out = Document(d), []
    for page, body in enumerate(doc.pages()):
        p = Painter(doc, page_box(doc, body))
        whole = b"\n".join(s.data().data for s in doc.contents(body))
        p.run(whole, doc.get(body, b"Resources"))
        for note in doc.get(body, b"Annots") or []:
            rect, kind = doc.get(note, b"Rect"), doc.get(note, b"Subtype")
            if isinstance(rect, list) and len(rect) == 4 and kind in (b"Link", b"Redact"):
                x0, y0, x1, y1 = (float(doc.get(v) or 0) for v in rect)
                to = doc.get(note, b"A", b"URI")
                p.rows.append(("link" if kind == b"Link" else "mark", len(p.rows), min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), text_of(to) if to else None, 1.0, 1.0, 0, False))
        p.rows.append(("page", len(p.rows), *p.box, None, 1.0, 1.0, 0, False))
        out += [(page, *r) for r in p.rows]
    return out


def page_marks(files: DataFrame) -> DataFrame:
    """All glyphs, fills, images, links, marks and page boxes of PDF files (file_id, content); a file that can't be painted has none."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                try:
                    rows = [(ident, *r) for r in painted(content)]
                except (ValueError, IndexError, TypeError, RecursionError, OverflowError):
                    continue
                for at in range(0, len(rows), 20_000):
                    columns = list(zip(*rows[at : at + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS)], names=SCHEMA.names)

    return files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, SCHEMA)


def covered_text(files: DataFrame) -> DataFrame:
    """Text under dark boxes, by file and page, in drawing order."""
    from gleanery.operators.geometry import PAGE, covered_glyphs, merged

    marks = page_marks(files)
    glyphs = marks.where("kind = 'glyph'").withColumn("dark", F.col("lightness") <= 0.25)
    hit = glyphs.join(merged(covered_glyphs(glyphs, marks.where("kind = 'fill'"))), [*PAGE, "ordinal"])
    return _said(hit)


def _said(glyphs: DataFrame) -> DataFrame:
    from gleanery.operators.geometry import PAGE

    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return glyphs.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def page_findings(files: DataFrame) -> DataFrame:
    """``file_id, page, kind, text``: text under boxes and in marks never applied (``covered``), hidden text, pictures under boxes, links
    that say another site than they go to."""
    from gleanery.operators import geometry as G
    from gleanery.shared import written

    marks = written(page_marks(files), "marks")
    of = lambda kind: marks.where(F.col("kind") == kind).drop("kind")
    glyphs = of("glyph").withColumn("dark", F.col("lightness") <= 0.25)
    fills, images, pages = of("fill"), of("image"), of("page")
    # What several steps read is written: as one plan they are so many joins that planning them fills the driver.
    at = [*G.PAGE, "ordinal"]
    under = G.merged(written(G.covered_glyphs(glyphs, fills).unionByName(G.marked_glyphs(glyphs, of("mark"))).distinct(), "under"))
    row = lambda df, kind: df.select("file_id", "page", F.lit(kind).alias("kind"), "text")
    covered = row(_said(glyphs.join(under, at)), "covered")
    rest = written(glyphs.join(under, at, "left_anti"), "rest")
    unseen = written(G.hidden_glyphs(rest, fills, images, pages).select(*at, "reason"), "unseen")
    cut = G.words_of(rest).join(G.merged(unseen), at, "left")
    whole = cut.groupBy(*G.PAGE, "word").agg(F.bool_and(F.col("reason").isNotNull()).alias("gone")).where("gone").drop("gone")
    hidden = row(_said(cut.where("reason is not null").join(G.merged(whole), [*G.PAGE, "word"], "left_semi")), "hiddentext")
    pictures = G.covered_pictures(images, fills, 612.0 * 792.0).groupBy(*G.PAGE).agg(F.count(F.lit(1)).cast("string").alias("text"))
    links = G.link_words(glyphs, of("link").where("text is not null").withColumnRenamed("text", "href")).where("elsewhere")
    said = links.select("file_id", "page", F.lit("linkmismatch").alias("kind"), F.concat("words", F.lit(" goes to "), "href").alias("text"))
    return covered.unionByName(hidden).unionByName(row(pictures, "covered")).unionByName(said)


def removed_texts(files: DataFrame) -> DataFrame:
    """``file_id, page, text``: lines of earlier revisions of a file that its pages no longer have. A revision is what stands before an
    end mark."""
    from gleanery.operators.geometry import taken_off
    from gleanery.shared import written

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ident, content = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                ends = [m.end() for m in re.finditer(rb"%%EOF\s*", content)]
                rows = []
                for last, end in [(False, e) for e in ends[:-1]] + [(True, len(content))] if len(ends) > 1 else []:
                    lines: dict[tuple, list[str]] = {}
                    try:
                        for r in painted(content[:end]):
                            if r[1] == "glyph" and not r[11]:
                                lines.setdefault((r[0], round(r[4], 1)), []).append(r[7] or "")
                    except (ValueError, IndexError, TypeError, RecursionError, OverflowError):
                        continue
                    rows += [(ident, page, "".join(said).strip(), last) for (page, _), said in lines.items() if "".join(said).strip()]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["file_id", "page", "text", "last"])

    lines = written(files.select(F.col("file_id").cast("string"), "content").mapInArrow(run, "file_id string, page bigint, text string, last boolean"), "lines")
    return taken_off(lines.where("not last"), lines.where("last"))
