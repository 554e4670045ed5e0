"""Format identification: one ordered CASE over the first bytes, so the first match wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import extension

#: Formats in order of testing, each with tests (offset from 1, hex of the bytes there), all of which hold.
# Signatures of the formats.
SIGNATURES: list[tuple[str, list[tuple[int, str]]]] = [
    ("png", [(2, "504E47")]), ("jpeg", [(1, "FFD8FF")]),
    *[("heif", [(5, "66747970"), (9, brand)]) for brand in ("68656963", "68656978", "6D696631", "61766966", "68657663")],
    ("webp", [(1, "52494646"), (9, "57454250")]), ("gif", [(1, "474946383761")]), ("gif", [(1, "474946383961")]),
    ("tiff", [(1, "49492A00")]), ("tiff", [(1, "4D4D002A")]),
    *[("wav", [(1, head), (9, "57415645")]) for head in ("52494646", "52494658", "52463634", "42573634")],
    ("mp3", [(1, "494433")]), *[("mp3", [(1, head)]) for head in ("FFFB", "FFFA", "FFF3", "FFF2")], ("flac", [(1, "664C6143")]), ("ogg", [(1, "4F676753")]),
    ("video", [(5, "66747970")]), ("video", [(5, "6D6F6F76")]), ("wasm", [(1, "0061736D")]),
]
TAIL = [("cfb", [(1, "D0CF11E0A1B11AE1")]), ("zip", [(1, "504B0304")]), ("zip", [(1, "504B0506")]), ("rtf", [(1, "7B5C727466")])]
PDF_WINDOW, HEADER_LINES = 1024, 200
# Header names of which a message has two at least.
MAIL_HEADERS = ["from", "to", "subject", "date", "received", "message-id", "mime-version"]

# Extensions by the format they promise.
EXTENSIONS = {
    "png": ["png"], "jpeg": ["jpg", "jpeg", "jfif"], "heif": ["heic", "heif", "avif"], "webp": ["webp"], "gif": ["gif"], "tiff": ["tif", "tiff"],
    "wav": ["wav"], "mp3": ["mp3"], "flac": ["flac"], "ogg": ["ogg", "opus"], "video": ["mp4", "mov", "m4v"], "wasm": ["wasm"], "pdf": ["pdf"],
    "cfb": ["doc", "xls", "ppt", "msg"], "zip": ["zip", "docx", "xlsx", "pptx", "odt", "ods", "jar", "epub"], "rtf": ["rtf"], "svg": ["svg", "svgz"], "eml": ["eml"],
}


def format_of(content: Column) -> Column:
    """The format of a binary column; ``unknown`` for none of them, also for empty and null."""
    at = lambda o, h: F.hex(F.substring(content, o, len(h) // 2)) == h
    all_of = lambda tests: F.lit(True) if not tests else at(*tests[0]) if len(tests) == 1 else at(*tests[0]) & at(*tests[1])
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    case = F.when(content.isNull() | (F.octet_length(content) == 0), "unknown")
    for name, tests in SIGNATURES:
        case = case.when(all_of(tests), name)
    case = case.when(F.locate("%PDF-", F.substring(head, 1, PDF_WINDOW)) > 0, "pdf")
    for name, tests in TAIL:
        case = case.when(all_of(tests), name)
    first = F.regexp_replace(head, r"(?s)^(ï»¿)?(\s|<\?[^>]*>|<!--.*?-->|<!DOCTYPE[^>]*>)*", "")
    case = case.when(first.rlike(r"^<svg[\s>/]"), "svg")
    lines = F.slice(F.split(head, "\r?\n", HEADER_LINES + 1), 1, HEADER_LINES)
    names = F.transform(lines, lambda x: F.lower(F.regexp_extract(x, r"^([A-Za-z-]+):", 1)))
    case = case.when(F.size(F.array_intersect(names, F.array(*map(F.lit, MAIL_HEADERS)))) >= 2, "eml")
    return case.otherwise("unknown")


_SVG_HEAD = r"(?s)(ï»¿)?(\s|<\?[^>]*>|<!--.*?-->|<!DOCTYPE[^>]*>)*<svg[\s>/]"


def sniffed(data: bytes) -> str:
    """The same for bytes at hand, by the same tables; and packed drawings, which have to be unpacked to be known."""

    def fits(tests):
        return all(data[o - 1 : o - 1 + len(h) // 2].hex().upper() == h for o, h in tests)

    for name, tests in SIGNATURES:
        if fits(tests):
            return name
    if b"%PDF-" in data[:PDF_WINDOW]:
        return "pdf"
    for name, tests in TAIL:
        if fits(tests):
            return name
    head = data[:8192].decode("latin-1")
    if data[:2] == b"\x1f\x8b":
        from gleanery.sources.unpack import inflated

        head = inflated(data[: 1 << 14], 31, kept=8192, counted=1 << 16).data.decode("latin-1")
    if re.match(_SVG_HEAD, head):
        return "svg"
    lines = re.split("\r?\n", head)[:HEADER_LINES]
    names = {m[1].lower() for x in lines if (m := re.match("([A-Za-z-]+):", x))}
    return "eml" if len(names & set(MAIL_HEADERS)) >= 2 else "unknown"


def refined(data: bytes, format_: str) -> str:
    """``format_`` as it is where content is at hand: an unknown gzip stream may be a drawing."""
    return sniffed(data) if format_ == "unknown" and data[:2] == b"\x1f\x8b" else format_


def misnamed(name: Column, format_: Column) -> Column:
    """What format a file's name promises where its bytes have another; null where they agree or the name says nothing."""
    ext = extension(name)
    said = F.coalesce(*[F.when(ext.isin(*exts), f) for f, exts in EXTENSIONS.items()])
    return F.when(said != format_, said)


def identified(files: DataFrame, *, name: str = "name", content: str = "content") -> DataFrame:
    """``files`` with ``format`` and ``misnamed``; the content is read for its head only."""
    out = files.withColumn("format", format_of(F.col(content)))
    return out.withColumn("misnamed", misnamed(F.col(name), F.col("format")))
