"""ZIP archives: entries by the central directory (also a 64-bit one), or by local headers where it is gone."""

from __future__ import annotations

import struct
import zlib

from gleanery.sources.unpack import Unpacked, bunzipped, inflated, unzstd

#: Bytes of one member whose checksum is made sure of, and of all of them together.
CHECKED, CHECKED_ALL = 1 << 26, 1 << 28
_FULL = 0xFFFFFFFF


def entries(d: bytes) -> tuple[list[dict], int, list[tuple[str, str, int, int]]]:
    """Entries (name, offset, span, method, size, packed, crc, locked, read), where the directory begins, and problems."""
    trouble: list[tuple[str, str, int, int]] = []
    end = d.rfind(b"PK\x05\x06", max(0, len(d) - 65_557))
    rows: list[dict] = []
    if end < 0 or end + 22 > len(d):
        trouble.append(("damage", "directory missing", len(d), 0))
        return _recovered(d), len(d), trouble
    count, size, at = struct.unpack_from("<HII", d, end + 10)
    note = struct.unpack_from("<H", d, end + 20)[0]
    if end + 22 + note < len(d):
        trouble.append(("hidden", "data after the end of the archive", end + 22 + note, len(d) - end - 22 - note))
    if d[end - 20 : end - 16] == b"PK\x06\x07" and _FULL in (size, at, count | 0xFFFF0000):
        (big,) = struct.unpack_from("<Q", d, end - 12)
        if d[big : big + 4] == b"PK\x06\x06" and big + 56 <= len(d):
            count, size, at = struct.unpack_from("<QQQ", d, big + 32)
        else:
            trouble.append(("damage", "64-bit directory end missing", end - 20, 20))
    shift = end - size - at if 0 < end - size - at and d[at : at + 4] != b"PK\x01\x02" and d[end - size : end - size + 4] == b"PK\x01\x02" else 0
    at += shift
    first = at
    for _ in range(count):
        if d[at : at + 4] != b"PK\x01\x02" or at + 46 > len(d):
            trouble.append(("damage", "directory cut short", at, 0))
            break
        flags, method = struct.unpack_from("<HH", d, at + 8)
        crc, packed, size, nl, xl, cl = struct.unpack_from("<IIIHHH", d, at + 16)
        (offset,) = struct.unpack_from("<I", d, at + 42)
        name = d[at + 46 : at + 46 + nl].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra = d[at + 46 + nl : at + 46 + nl + xl]
        size, packed, offset = _wide(extra, [size, packed, offset])
        offset += shift
        at += 46 + nl + xl + cl
        if d[offset : offset + 4] != b"PK\x03\x04" or offset + 30 > len(d):
            trouble.append(("damage", f"local header of {name} missing", offset, 0))
            continue
        its_flags, its_method = struct.unpack_from("<HH", d, offset + 6)
        its_crc, its_packed, its_size, ln, lx = struct.unpack_from("<IIIHH", d, offset + 14)
        local = d[offset + 30 : offset + 30 + ln].decode("utf-8" if its_flags & 0x800 else "cp437", "replace")
        if local != name:
            trouble.append(("hidden", f"{name} is {local} in its own header", offset, 30 + ln))
        its_size, its_packed = _wide(d[offset + 30 + ln : offset + 30 + ln + lx], [its_size, its_packed])
        late = bool(its_flags & 8) and (its_crc, its_packed, its_size) == (0, 0, 0)  # sizes follow the data
        if its_method != method or not late and (its_crc, its_packed, its_size) != (crc, packed, size):
            trouble.append(("hidden", f"{name} has other sizes in its own header", offset, 30))
        data = offset + 30 + ln + lx
        tail = 0
        if its_flags & 8:
            mark = d[data + packed : data + packed + 4] == b"PK\x07\x08"
            tail = (16 if mark else 12) + (8 if _FULL in struct.unpack_from("<II", d, offset + 18) and lx else 0)
        rows.append(_entry(d, name, offset, data, method, size, packed, crc, bool(flags & 1), tail))
    reach = shift
    for e in sorted(rows, key=lambda e: (e["offset"], e["name"])):
        if e["offset"] < reach:
            trouble.append(("hidden", f"{e['name']} overlaps an entry", e["offset"], e["span"]))
        elif e["offset"] > reach:
            trouble.append(("hidden", "data nothing points at", reach, e["offset"] - reach))
        reach = max(reach, e["offset"] + e["span"])
    if shift:
        trouble.append(("hidden", "data before the archive", 0, shift))
    return rows, first, trouble


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Numbers that do not fit 32 bits stand in an extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            o = at + 4
            for i, v in enumerate(values):
                if v == _FULL and o + 8 <= at + 4 + n:
                    values[i], o = struct.unpack_from("<Q", extra, o)[0], o + 8
        at += 4 + n
    return values


def checked(rows: list[dict]) -> list[tuple[str, str, int, int]]:
    """Members whose data does not unpack or has another size or checksum than the directory says; those past the bounds are told."""
    trouble, done = [], 0
    for e in rows:
        if e["locked"] or e["method"] not in (0, 8, 12, 93):
            continue
        if e["size"] > CHECKED or done + e["size"] > CHECKED_ALL:
            trouble.append(("oddity", f"{e['name']} is larger than what is made sure of", e["offset"], e["span"]))
            continue
        got = e["unpack"](CHECKED)
        done += got.size
        if got.error:
            trouble.append(("damage", f"{e['name']} {got.error}", e["offset"], e["span"]))
        elif got.size != e["size"] or zlib.crc32(got.data) != e["crc"]:
            trouble.append(("damage", f"{e['name']} differs from its checksum", e["offset"], e["span"]))
    return trouble


def _entry(d: bytes, name: str, offset: int, data: int, method: int, size: int, packed: int, crc: int, locked: bool = False, tail: int = 0) -> dict:
    def unpack(most: int) -> Unpacked:
        body = d[data : data + packed]
        if locked:
            return Unpacked(b"", 0, False, "is locked")
        if method == 0:
            return Unpacked(body[:most], len(body), len(body) <= most, None if len(body) == packed else "ends too soon")
        if method == 8:
            return inflated(body, -15, most)
        if method == 12:
            return bunzipped(body, most)
        return unzstd(body, most) if method == 93 else Unpacked(b"", 0, False, "no reader for this method")

    def read(most: int = 1 << 24) -> bytes | None:
        got = unpack(most)
        return None if got.error else got.data

    return {"name": name, "offset": offset, "span": data + packed + tail - offset, "method": method, "size": size, "packed": packed, "crc": crc, "locked": locked, "read": read, "unpack": unpack}


def _recovered(d: bytes) -> list[dict]:
    rows, at = [], d.find(b"PK\x03\x04")
    while at >= 0 and at + 30 <= len(d):
        flags, method = struct.unpack_from("<HH", d, at + 6)
        crc, packed, size, nl, xl = struct.unpack_from("<IIIHH", d, at + 14)
        data = at + 30 + nl + xl
        if flags & 8 and not packed and method == 8:  # sizes follow the data: the stream itself says where it ends
            got = inflated(d[data:], -15)
            packed, size, crc = got.used, got.size, zlib.crc32(got.data)
        if data + packed > len(d):
            break
        rows.append(_entry(d, d[at + 30 : at + 30 + nl].decode("utf-8" if flags & 0x800 else "cp437", "replace"), at, data, method, size, packed, crc, bool(flags & 1)))
        at = d.find(b"PK\x03\x04", data + packed)
    return rows
