"""What the sample files say, row by row: expected results that were checked by hand against how the samples are made."""

# File, format, row, ordinal, kind, text, start, length, complete.
INSPECTED = """
a.doc | cfb | file | 0 | cfb | - | 0 | 5632 | True
a.doc | cfb | fact | 0 | author | Gita | - | - | -
a.doc | cfb | fact | 1 | title | Memo | - | - | -
a.docx | zip | file | 0 | zip | - | 0 | 485 | True
a.docx | zip | fact | 0 | author | Vera K | - | - | -
a.docx | zip | fact | 1 | title | Plan | - | - | -
a.eml | eml | file | 0 | eml | - | 0 | 506 | True
a.eml | eml | problem | 0 | hidden | replies go to another site | 0 | 0 | -
a.eml | eml | problem | 1 | hidden | a link goes elsewhere than it says | 0 | 0 | -
a.eml | eml | fact | 0 | sentfrom | 93.184.216.34 | - | - | -
a.eml | eml | fact | 1 | computer | laptop-x1 | - | - | -
a.eml | eml | fact | 2 | mailer | Quill 1 | - | - | -
a.eml | eml | fact | 3 | timezone | UTC+02:00 | - | - | -
a.eml | eml | fact | 4 | authclaim | spf=pass | - | - | -
a.eml | eml | fact | 5 | authclaim | dkim=fail | - | - | -
a.eml | eml | fact | 6 | replyto | x@evil.org | - | - | -
a.eml | eml | fact | 7 | linkmismatch | my-bank.com goes to evil.org | - | - | -
a.eml | eml | fact | 8 | weblinks | evil.org | - | - | -
a.eml | eml | fact | 9 | attachments | bill.pdf.html | - | - | -
a.eml | eml | fact | 10 | riskyfile | bill.pdf.html: page as pdf | - | - | -
a.flac | flac | file | 0 | flac | - | 0 | 85 | True
a.flac | flac | fact | 0 | encoder | enc | - | - | -
a.flac | flac | fact | 1 | title | Air | - | - | -
a.flac | flac | fact | 2 | artist | Bo | - | - | -
a.gif | gif | file | 0 | gif | - | 0 | 38 | True
a.gif | gif | fact | 0 | comments | hello | - | - | -
a.heic | heif | file | 0 | heif | - | 0 | 313 | True
a.heic | heif | fact | 0 | camera | Cam One | - | - | -
a.heic | heif | fact | 1 | serial | SN12345 | - | - | -
a.heic | heif | fact | 2 | location | 50.45000, 30.50000 | - | - | -
a.mp3 | mp3 | file | 0 | mp3 | - | 0 | 50 | True
a.mp3 | mp3 | fact | 0 | title | Tune | - | - | -
a.mp3 | mp3 | fact | 1 | artist | Cy | - | - | -
a.mp4 | video | file | 0 | video | - | 0 | 164 | True
a.mp4 | video | fact | 0 | created | 2024-05-31 11:33:20 | - | - | -
a.mp4 | video | fact | 1 | location | +50.4-030.5/ | - | - | -
a.odt | zip | file | 0 | zip | - | 0 | 587 | True
a.odt | zip | fact | 0 | author | Jo | - | - | -
a.odt | zip | fact | 1 | tracked | changes by Jo | - | - | -
a.odt | zip | fact | 2 | deleted | old words | - | - | -
a.ogg | ogg | file | 0 | ogg | - | 0 | 134 | True
a.ogg | ogg | fact | 0 | encoder | lib1 | - | - | -
a.ogg | ogg | fact | 1 | title | Wind | - | - | -
a.ogg | ogg | fact | 2 | artist | Dee | - | - | -
a.pdf | pdf | file | 0 | pdf | - | 0 | 138 | True
a.pdf | pdf | fact | 0 | title | Note | - | - | -
a.pdf | pdf | fact | 1 | author | Zed | - | - | -
a.rtf | rtf | file | 0 | rtf | - | 0 | 88 | True
a.rtf | rtf | fact | 0 | title | Lease | - | - | -
a.rtf | rtf | fact | 1 | author | Ivo | - | - | -
a.rtf | rtf | fact | 2 | created | 2024-02-03 04:05 | - | - | -
a.rtf | rtf | fact | 3 | deleted | deleted text | - | - | -
a.svg | svg | file | 0 | svg | - | 0 | 130 | True
a.svg | svg | fact | 0 | title | Map | - | - | -
a.svg | svg | fact | 1 | original | /home/vera/a.png | - | - | -
a.svgz | svg | file | 0 | svg | - | 0 | 126 | True
a.svgz | svg | fact | 0 | title | Map | - | - | -
a.svgz | svg | fact | 1 | original | /home/vera/a.png | - | - | -
a.tif | tiff | file | 0 | tiff | - | 0 | 168 | True
a.tif | tiff | fact | 0 | camera | Cam One | - | - | -
a.tif | tiff | fact | 1 | serial | SN12345 | - | - | -
a.tif | tiff | fact | 2 | location | 50.45000, 30.50000 | - | - | -
a.wasm | wasm | file | 0 | wasm | - | 0 | 33 | True
a.wasm | wasm | fact | 0 | sourcemap | a.map | - | - | -
a.wav | wav | file | 0 | wav | - | 0 | 82 | True
a.wav | wav | fact | 0 | artist | Ann | - | - | -
a.wav | wav | fact | 1 | title | Song | - | - | -
a.xlsx | zip | file | 0 | zip | - | 0 | 1143 | True
a.xlsx | zip | fact | 0 | custom | Client: Acme | - | - | -
a.xlsx | zip | fact | 1 | weblinks | out.example | - | - | -
a.xlsx | zip | fact | 2 | hiddensheets | Secret & Co | - | - | -
a.xlsx | zip | fact | 3 | hiddencells | 1 hidden rows or columns | - | - | -
a.xlsx | zip | fact | 4 | comments | comments by Ida | - | - | -
bands.png | png | file | 0 | png | - | 0 | 161 | True
bands.png | png | fact | 0 | copyright | Copy by Kim | - | - | -
bin | unknown | file | 0 | unknown | - | 0 | 35 | True
bin | unknown | fact | 0 | account | olena | - | - | -
bin | unknown | fact | 1 | emails | me@site.org | - | - | -
cut.docx | zip | file | 0 | zip | - | 0 | 455 | False
cut.docx | zip | problem | 0 | damage | directory missing | 455 | 0 | -
cut.docx | zip | fact | 0 | author | Vera K | - | - | -
cut.docx | zip | fact | 1 | title | Plan | - | - | -
cut.jpg | jpeg | file | 0 | jpeg | - | 0 | 220 | False
cut.jpg | jpeg | problem | 0 | damage | end marker missing | 220 | 0 | -
cut.jpg | jpeg | fact | 0 | camera | Cam One | - | - | -
cut.jpg | jpeg | fact | 1 | serial | SN12345 | - | - | -
cut.jpg | jpeg | fact | 2 | location | 50.45000, 30.50000 | - | - | -
cut.jpg | jpeg | fact | 3 | comments | made at home | - | - | -
cut.png | png | file | 0 | png | - | 0 | 60 | False
cut.png | png | problem | 0 | damage | end chunk missing | 60 | 0 | -
drawn.pdf | pdf | file | 0 | pdf | - | 0 | 245 | True
empty | unknown | file | 0 | unknown | - | 0 | 0 | True
noted.png | png | file | 0 | png | - | 0 | 92 | True
noted.png | png | fact | 0 | author | Olena | - | - | -
photo.jpg | jpeg | file | 0 | jpeg | - | 0 | 222 | True
photo.jpg | jpeg | fact | 0 | camera | Cam One | - | - | -
photo.jpg | jpeg | fact | 1 | serial | SN12345 | - | - | -
photo.jpg | jpeg | fact | 2 | location | 50.45000, 30.50000 | - | - | -
photo.jpg | jpeg | fact | 3 | comments | made at home | - | - | -
plain.png | png | file | 0 | png | - | 0 | 68 | True
rich.jpg | jpeg | file | 0 | jpeg | - | 0 | 415 | True
rich.jpg | jpeg | fact | 0 | software | Tool 9 | - | - | -
rich.jpg | jpeg | fact | 1 | author | Ana | - | - | -
rich.jpg | jpeg | fact | 2 | copyright | (c) | - | - | -
rich.jpg | jpeg | fact | 3 | copyright | Copy by Kim | - | - | -
tail.png | png | file | 0 | png | - | 0 | 74 | True
tail.png | png | problem | 0 | hidden | data after the image | 68 | 6 | -
"""

# File, format, bytes removed, kinds removed, kinds present, unchecked, error, complete.
RECEIPTS = """
a.doc | cfb | 10 | author,title |  | 0 | - | True
a.docx | zip | 10 | author,title |  | 0 | - | True
a.eml | eml | 0 |  |  | 0 | unsupported | False
a.flac | flac | 41 | artist,encoder,title |  | 0 | - | True
a.gif | gif | 9 |  |  | 1 | - | True
a.heic | heif | 172 | camera,location,serial |  | 0 | - | True
a.mp3 | mp3 | 38 | artist,title |  | 0 | - | True
a.mp4 | video | 32 | location |  | 1 | - | True
a.odt | zip | 172 | author,deleted,tracked |  | 0 | - | True
a.ogg | ogg | 24 | artist,encoder,title |  | 0 | - | True
a.pdf | pdf | 7 | author,title |  | 0 | - | True
a.rtf | rtf | 74 | author,created,deleted,title |  | 0 | - | True
a.svg | svg | 84 | original,title |  | 0 | - | True
a.svgz | svg | 84 | original,title |  | 0 | - | True
a.tif | tiff | 68 | camera,location,serial |  | 0 | - | True
a.wasm | wasm | 25 |  |  | 1 | - | True
a.wav | wav | 36 | artist,title |  | 0 | - | True
a.xlsx | zip | 62 | custom | comments,hiddencells,hiddensheets,weblinks | 0 | - | True
bands.png | png | 0 |  |  | 0 | nothing | False
bin | unknown | 0 |  |  | 0 | unsupported | False
cut.docx | zip | 0 |  |  | 0 | damaged | False
cut.jpg | jpeg | 0 |  |  | 0 | damaged | False
cut.png | png | 0 |  |  | 0 | damaged | False
drawn.pdf | pdf | 0 |  |  | 0 | nothing | False
empty | unknown | 0 |  |  | 0 | unsupported | False
noted.png | png | 24 |  |  | 1 | - | True
photo.jpg | jpeg | 194 | camera,location,serial |  | 1 | - | True
plain.png | png | 0 |  |  | 0 | nothing | False
rich.jpg | jpeg | 218 | software | copyright | 2 | - | True
tail.png | png | 6 |  |  | 1 | - | True
"""

# File, format, start, length.
CARVED = """
a.docx | zip | 57 | 428
a.docx | zip | 212 | 273
a.odt | zip | 77 | 510
a.odt | zip | 315 | 272
a.ogg | ogg | 58 | -
a.xlsx | zip | 57 | 1086
a.xlsx | zip | 210 | 933
a.xlsx | zip | 310 | 833
a.xlsx | zip | 416 | 727
a.xlsx | zip | 590 | 553
cut.docx | zip | 57 | -
cut.docx | zip | 212 | -
"""

# File, member, position, method, size, CRC.
MEMBERS = """
a.docx | [Content_Types].xml | 0 | 0 | 8 | 1008147655
a.docx | docProps/core.xml | 57 | 0 | 108 | 2020645342
a.docx | word/document.xml | 212 | 0 | 13 | 226908893
a.odt | mimetype | 0 | 0 | 39 | 204654174
a.odt | content.xml | 77 | 0 | 197 | 3662913366
a.odt | meta.xml | 315 | 0 | 47 | 1707740554
a.xlsx | [Content_Types].xml | 0 | 0 | 8 | 1008147655
a.xlsx | xl/workbook.xml | 57 | 0 | 108 | 1877721492
a.xlsx | xl/worksheets/sheet1.xml | 210 | 0 | 46 | 170240279
a.xlsx | xl/comments1.xml | 310 | 0 | 60 | 4166284604
a.xlsx | xl/_rels/workbook.xml.rels | 416 | 0 | 118 | 308260042
a.xlsx | docProps/custom.xml | 590 | 0 | 87 | 3930745607
cut.docx | [Content_Types].xml | 0 | 0 | 8 | 1008147655
cut.docx | docProps/core.xml | 57 | 0 | 108 | 2020645342
cut.docx | word/document.xml | 212 | 0 | 13 | 226908893
"""


def values(rows: str, kinds: str) -> str:
    """Rows as SQL values; ``kinds`` has a letter a column: t(ext), n(umber), b(oolean)."""

    def one(cell: str, kind: str) -> str:
        return "NULL" if cell == "-" else f"{cell}::BIGINT" if kind == "n" else cell.lower() if kind == "b" else "'" + cell.replace("'", "''") + "'"

    lines = [x.split(" | ") for x in rows.split("\n") if x]
    return "(VALUES " + ", ".join("(" + ", ".join(one(c.strip(), k) for c, k in zip(x, kinds)) + ")" for x in lines) + ")"
