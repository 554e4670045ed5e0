"""What a decoded part is for: its role by format, depth and label, and the sentence that describes it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Role by format and depth (0: any), for labels that match; the first match counts. Labels are those of the decoders here.
RULES = """
png 1 IDAT content
png 1 tEXt|zTXt|iTXt|eXIf|tIME metadata
png 1 .* structure
jpeg 0 .*thumbnail.* thumbnail
jpeg 1 scan.* content
jpeg 1 COM|APP(?!.*JFIF).* metadata
jpeg 1 .* structure
webp 1 VP8|VP8L|ALPH|ANMF content
webp 1 EXIF|XMP metadata
webp 1 .* structure
gif 1 frame.* content
gif 1 comment|.*XMP.* metadata
gif 1 .* structure
heif 0 Exif|mime metadata
heif 1 mdat content
heif 1 .* structure
video 0 udta|meta|loci|©.* metadata
video 1 mdat content
video 1 .* structure
wav 1 data.* content
wav 1 .*(INFO|LIST|bext).* metadata
wav 1 .* structure
mp3 0 ID3.* metadata
mp3 0 .*audio.* content
mp3 0 .* structure
flac 0 .*(comment|VORBIS|Vorbis).* metadata
flac 0 .*audio.* content
flac 0 .* structure
ogg 0 .*(comment|tags).* metadata
ogg 0 .* structure
wasm 1 .*(code|data) content
wasm 1 custom.*(dylink.0|linking|reloc[.].*) structure
wasm 1 custom.* metadata
wasm 1 .* structure
rtf 0 info|generator|template|user.properties|revision.table|comment.* metadata
rtf 0 text content
rtf 0 .* structure
svg 0 metadata|sodipodi:.*|comment metadata
svg 0 svg|script|image|.*handler content
svg 0 .* structure
eml 0 headers metadata
eml 0 body|attachment.* content
eml 0 email|parts?.* structure
pdf 0 .*(information|XMP).* metadata
pdf 0 .*(image|stream|embedded.file).* content
pdf 0 .* structure
zip 0 (docProps|META-INF)/.* metadata
zip 1 .* content
html 0 #comment|meta|title metadata
html 0 script|style structure
html 0 .* content
""".split("\n")


def rules() -> list[tuple[str, int, str, str]]:
    return [(f, int(d), p, r) for f, d, p, r in (x.split(" ") for x in RULES if x)]


def role_of(format_: Column, depth: Column, label: Column, severity: Column | None = None, concern: Column | None = None) -> Column:
    """The role of a node: problems claim by their concern (an error is damage), parts by the first rule that fits; null for none."""
    out = F.lit(None).cast("string")
    for f, d, p, r in reversed(rules()):
        here = (format_ == f) & label.rlike(f"^(?:{p})$")
        out = F.when(here if d == 0 else here & (depth == d), r).otherwise(out)
    if severity is not None:
        problem = F.when(concern == "hidden", "hidden").when(concern == "damage", "damaged")
        out = F.when(severity == "error", "damaged").when((severity == "warning") & (format_ != "eml"), problem).otherwise(out)
    return out


#: What parts are, in words: format, context (an ancestor's label, or -), pattern, sentence. The first row that fits counts, see ``described``.
DESCRIPTIONS = """
png | - | IHDR | width, height and kind of pixels
png | - | IDAT | the packed pixels
png | - | PLTE | the colours that pixels refer to
png | - | tEXt | a note in plain letters
png | - | zTXt | a note, packed
png | - | iTXt | a note in any script
png | - | tIME | when the picture was changed last
png | - | eXIf | what the camera wrote down
png | - | iCCP | how colours are meant
png | - | IEND | the end of the picture
jpeg | - | SOI | the beginning of the picture
jpeg | - | marker e1 | what the camera or a program wrote down
jpeg | - | marker ed | captions and resources of an editor
jpeg | - | marker fe | a note
jpeg | - | scan | the packed pixels
jpeg | - | EOI | the end of the picture
gif | - | image | a frame
gif | - | extension fe | a note
heif | - | item * · Exif | what the camera wrote down
heif | - | mdat | the pictures themselves
video | - | moov | how the movie is put together
video | - | udta | what describes the movie
video | - | mdat | sound and pictures
wav | - | fmt | how sound is sampled
wav | - | data | the sound
mp3 | - | ID3* | what describes the recording
mp3 | - | frames | the sound
flac | - | block 4 | comments on the recording
ogg | - | page | a page of the stream
wasm | - | section 0 | a section beside the program
wasm | - | section 10 | the program
zip | - | directory | the list of members
zip | - | docProps/* | what the program knows about the document
zip | - | word/* | a part of the text document
zip | - | xl/* | a part of the workbook
zip | - | ppt/* | a part of the presentation
pdf | - | object * | an object of the document
eml | - | headers | who, when and by which way
rtf | - | info | who and when
svg | - | metadata | what describes the drawing
html | head | * | a part of the page's head
html | - | a | a link
html | - | #comment | a remark that is not shown
* | colour profile | * | an entry of a colour profile
* | - | tag * | a field of the camera's notes
* | - | data after* | bytes that no reader looks at
* | - | limit reached | more parts than are read
"""


def descriptions(spark) -> DataFrame:
    """``position, format, context, pattern, sentence``, for ``described``."""
    rows = [tuple(None if c == "-" else c for c in x.split(" | ")) for x in DESCRIPTIONS.split("\n") if x]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, format string, context string, pattern string, sentence string")


#: Rows and ancestors of one output batch, about.
ROWS, LABELS = 20_000, 1_000_000


def with_depth(nodes: DataFrame, contexts: list[str] | None = None) -> DataFrame:
    """``nodes`` (file_id, node_id, parent_id, label) with ``depth`` and ``ancestors`` (labels from the root down).

    Each file's tree is walked once, in one task, however deep it is; a file has as many nodes as its decoder reads at most. Nodes that no
    root leads to are left out. With ``contexts`` (label patterns, see ``described``) ancestors are only the first that fits each of
    them, so that those of deep trees stay few; without any pattern no label is needed.
    """
    from gleanery.operators.geometry import glob_pattern

    tests = [F.when(F.col("label").rlike(glob_pattern(c)), i) for i, c in enumerate(contexts or [])]
    fits = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")
    schema = T.StructType([*nodes.schema.fields, T.StructField("depth", T.IntegerType()), T.StructField("ancestors", T.ArrayType(T.StringType()))])
    kept, whole, narrow = nodes.columns, contexts is None, contexts == []

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, ups = table["node_id"].to_pylist(), table["parent_id"].to_pylist()
        labels = [None] * len(ids) if narrow else table["label"].to_pylist()
        masks = [sum(1 << k for k in x) for x in table["_fits"].to_pylist()]
        table = table.select(kept)
        below: dict = {}
        for i, up in enumerate(ups):
            below.setdefault(up, []).append(i)
        # Of each node: its row, depth, the node above, the patterns that fit above it or at it, and the labels that do above it.
        found = [(i, 0, None, masks[i], ()) for i in below.pop(None, [])]
        for at, (i, depth, above, mask, fitting) in enumerate(found):
            if depth >= len(ids):
                raise ValueError("a tree's nodes are one above the other in a circle")
            if masks[i] & ~(found[above][3] if above is not None else 0):
                fitting = (*fitting, labels[i])
            found += [(k, depth + 1, at, mask | masks[k], fitting) for k in below.get(ids[i], [])]

        def path(at: int) -> list:
            out = []
            while (at := found[at][2]) is not None:
                out.append(labels[found[at][0]])
            return out[::-1]

        def batch(some: list[int], ancestors: list) -> pa.RecordBatch:
            rows = table.take(pa.array([found[at][0] for at in some], pa.int64()))
            rows = rows.append_column("depth", pa.array([found[at][1] for at in some], pa.int32()))
            return rows.append_column("ancestors", pa.array(ancestors, pa.list_(pa.string()))).combine_chunks().to_batches()[0]

        some, ancestors, n = [], [], 0
        for at in range(len(found)):
            some.append(at)
            ancestors.append(path(at) if whole else found[at][4])
            n += len(ancestors[-1])
            if len(some) >= ROWS or n >= LABELS:
                yield batch(some, ancestors)
                some, ancestors, n = [], [], 0
        if some:
            yield batch(some, ancestors)

    return nodes.withColumn("_fits", fits).groupBy("file_id").applyInArrow(walked, schema)


def described(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes`` (format, label, ancestors) with the ``sentence`` that describes each.

    ``docs`` (position, format, context, pattern, sentence), a small table: a row fits a node of its format (``*``: any) with
    its label as the pattern has it, under an ancestor as the context has it (null: under any). Rows with a context come before
    those without, those of a format before ``*``, then by position.
    """
    from gleanery.operators.geometry import glob_pattern

    rows = docs.orderBy("position").limit(2_000).collect()
    if len(rows) == 2_000:
        raise ValueError("a table of descriptions has fewer than 2000 rows")
    rows.sort(key=lambda r: (r["context"] is None, r["format"] == "*", r["position"]))
    out = F.lit(None).cast("string")
    for r in reversed(rows):
        fits = F.col("label").rlike(glob_pattern(r["pattern"]))
        if r["format"] != "*":
            fits = fits & (F.col("format") == r["format"])
        if r["context"] is not None:
            pattern = glob_pattern(r["context"])
            fits = fits & F.exists("ancestors", lambda a: a.rlike(pattern))
        out = F.when(fits, r["sentence"]).otherwise(out)
    return nodes.withColumn("sentence", out)
