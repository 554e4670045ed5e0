"""Unpacking with bounds: what does not fit is told, never silently cut. Streams, filters of documents, predictors."""

from __future__ import annotations

import bz2
import re
import zlib
from dataclasses import dataclass

#: Bytes of unpacked data that are kept, and that are counted before a stream is given up.
KEPT, COUNTED = 1 << 24, 1 << 30
_STEP = 1 << 20


@dataclass(frozen=True)
class Unpacked:
    """``data`` is what was kept, ``size`` what there was; ``whole`` if both are all there is. ``used``: bytes of the input read."""

    data: bytes
    size: int
    whole: bool
    error: str | None = None
    used: int = 0


def _pumped(engine, data: bytes, kept: int, counted: int, used_of) -> Unpacked:
    out, size, rest = bytearray(), 0, data
    try:
        while True:
            part = engine.decompress(rest, _STEP)
            size += len(part)
            out += part[: max(0, kept - len(out))]
            rest = getattr(engine, "unconsumed_tail", b"")
            if engine.eof:
                return Unpacked(bytes(out), size, size == len(out), None, used_of(engine))
            if size > counted:
                return Unpacked(bytes(out), size, False, "unpacks to too much", len(data))
            if not part and not rest and getattr(engine, "needs_input", True):
                return Unpacked(bytes(out), size, False, "ends too soon", len(data))
    except (zlib.error, OSError, EOFError, ValueError):
        return Unpacked(bytes(out), size, False, "does not unpack", 0)


def inflated(data: bytes, bits: int = zlib.MAX_WBITS, kept: int = KEPT, counted: int = COUNTED) -> Unpacked:
    """A zlib stream (``bits`` -15: bare deflate, 31: gzip), unpacked in steps; memory is bounded by ``kept``."""
    return _pumped(zlib.decompressobj(bits), data, kept, counted, lambda e: len(data) - len(e.unused_data))


class _Bzip:
    """The standard library's bzip2 with the interface of zlib's: what is not yet taken is kept inside."""

    def __init__(self) -> None:
        self.engine = bz2.BZ2Decompressor()

    eof = property(lambda self: self.engine.eof)
    needs_input = property(lambda self: self.engine.needs_input)

    def decompress(self, data: bytes, most: int) -> bytes:
        return self.engine.decompress(data, most)


def bunzipped(data: bytes, kept: int = KEPT, counted: int = COUNTED) -> Unpacked:
    return _pumped(_Bzip(), data, kept, counted, lambda e: len(data) - len(e.engine.unused_data))


def unzstd(data: bytes, kept: int = KEPT, counted: int = COUNTED) -> Unpacked:
    try:
        import zstandard
    except ImportError:
        return Unpacked(b"", 0, False, "no reader for this method")
    import io

    out, size = bytearray(), 0
    try:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(io.BytesIO(data)) as r:
            while part := r.read(_STEP):
                size += len(part)
                out += part[: max(0, kept - len(out))]
                if size > counted:
                    return Unpacked(bytes(out), size, False, "unpacks to too much", len(data))
    except zstandard.ZstdError:
        return Unpacked(bytes(out), size, False, "does not unpack")
    return Unpacked(bytes(out), size, size == len(out), None, len(data))


# ---- filters of PDF streams


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    """Base 85 of five signs, ``z`` for four zeros; a short group at the end gives one byte less than it has signs."""
    body = re.sub(rb"\s", b"", data.split(b"~>")[0]).replace(b"z", b"!!!!!")
    out = bytearray()
    for at in range(0, len(body), 5):
        group = body[at : at + 5]
        value = 0
        for c in group.ljust(5, b"u"):
            value = value * 85 + min(84, max(0, c - 33))
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (n := data[at]) != 128 and len(out) < KEPT:
        out += data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        at += n + 2 if n < 128 else 2
    return bytes(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Variable codes of 9 to 12 bits, most significant bit first; 256 begins anew, 257 ends."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, have, held, last, out = list(first), 9, 0, 0, None, bytearray()
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == 257 or len(out) > KEPT:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1] if last and code == len(table) else None
        if entry is None:
            break
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        while width < 12 and len(table) + early > (1 << width) - 1 + (0 if early else 1):
            width += 1
    return bytes(out)


def unfiltered(data: bytes, row: int, step: int) -> tuple[bytes, int]:
    """Rows of ``row`` bytes, each after its filter number, without their filters (``step``: bytes between a sample and the one it
    is told from); and how many rows had no known filter."""
    out, above, wrong = bytearray(), bytearray(row), 0
    for at in range(0, len(data) - row, row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        if kind == 1:
            for i in range(step, row):
                line[i] = line[i] + line[i - step] & 255
        elif kind == 2:
            line = bytearray((a + b & 255) for a, b in zip(line, above))
        elif kind == 3:
            for i in range(row):
                line[i] = line[i] + ((line[i - step] if i >= step else 0) + above[i]) // 2 & 255
        elif kind == 4:
            for i in range(row):
                left, up, corner = (line[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                guess = left + up - corner
                near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))
                line[i] = line[i] + near[2] & 255
        elif kind:
            wrong += 1
        out += line
        above = line
    return bytes(out), wrong


def _number(head: bytes, key: bytes, default: int) -> int:
    m = re.search(rb"/" + key + rb"\s+(\d+)", head)
    return int(m[1]) if m else default


def stream_data(head: bytes, raw: bytes, kept: int = KEPT) -> Unpacked:
    """The data of a PDF stream by the filters and predictor its dictionary names, in order."""
    names = re.search(rb"/Filter\s*(\[[^\]]*\]|/[^\s/\[\]<>()]+)", head)
    data, size = raw, len(raw)
    for name in re.findall(rb"/([^\s/\[\]<>()]+)", names[1]) if names else ():
        if name in (b"FlateDecode", b"Fl"):
            got = inflated(data, kept=kept)
            if got.error == "does not unpack" and not got.data:
                return got
            if not got.whole and got.error != "ends too soon":
                return got
            data = got.data
        elif name in (b"LZWDecode", b"LZW"):
            data = lzw(data, _number(head, b"EarlyChange", 1))
        elif name in (b"ASCIIHexDecode", b"AHx"):
            data = ascii_hex(data)
        elif name in (b"ASCII85Decode", b"A85"):
            data = ascii85(data)
        elif name in (b"RunLengthDecode", b"RL"):
            data = run_length(data)
        else:
            return Unpacked(data, len(data), False, f"filter {name.decode('latin-1')} not read")
        size = len(data)
    if _number(head, b"Predictor", 1) >= 10 and data:
        samples, bits = _number(head, b"Colors", 1), _number(head, b"BitsPerComponent", 8)
        data, _ = unfiltered(data, max(1, (_number(head, b"Columns", 1) * samples * bits + 7) // 8), max(1, samples * bits // 8))
    elif _number(head, b"Predictor", 1) == 2 and _number(head, b"BitsPerComponent", 8) == 8:
        row, step, out = _number(head, b"Columns", 1) * _number(head, b"Colors", 1), _number(head, b"Colors", 1), bytearray(data)
        for at in range(0, len(out), max(1, row)):
            for i in range(at + step, min(at + row, len(out))):
                out[i] = out[i] + out[i - step] & 255
        data = bytes(out)
    return Unpacked(data, size, True, None, len(raw))


# ---- how a deflate stream is put together


def _codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    """Canonical prefix codes: (length, bits) to symbol."""
    code, out = 0, {}
    for n in range(1, 16):
        for symbol in (s for s, k in enumerate(lengths) if k == n):
            out[n, code] = symbol
            code += 1
        code <<= 1
    return out


# Base lengths and distances of the format, with their extra bits, and the order of code lengths.
_LENGTHS = [(3 + i, 0) for i in range(8)] + [(11, 1), (13, 1), (15, 1), (17, 1), (19, 2), (23, 2), (27, 2), (31, 2), (35, 3), (43, 3), (51, 3), (59, 3), (67, 4), (83, 4), (99, 4), (115, 4), (131, 5), (163, 5), (195, 5), (227, 5), (258, 0)]
_DISTANCES = [(1, 0), (2, 0), (3, 0), (4, 0), *[((2 + (i & 1) << i // 2) + 1, i // 2) for i in range(2, 28)]]
_ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


def traced(data: bytes, most: int = 1 << 22) -> tuple[list[dict], str | None]:
    """The blocks of a bare deflate stream: kind, first and last bit, literals, matches, bytes, checkpoint (bytes before); and why it
    was given up. A bit at a time, for looking into streams, not for unpacking them."""
    at, blocks, total = 0, [], 0

    def bits(n: int) -> int:
        nonlocal at
        if at + n > 8 * len(data):
            raise EOFError
        value = int.from_bytes(data[at >> 3 : (at + n + 7 >> 3) + 1], "little") >> (at & 7) & ((1 << n) - 1)
        at += n
        return value

    def symbol(codes) -> int:
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError

    fixed = _codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), _codes([5] * 30)
    try:
        last = False
        while not last:
            start, last, kind = at, bool(bits(1)), bits(2)
            block = {"kind": ("stored", "fixed", "dynamic", "wrong")[kind], "start": start, "literals": 0, "matches": 0, "bytes": 0, "checkpoint": total}
            if kind == 0:
                at += -at % 8
                n, check = bits(16), bits(16)
                if n ^ check != 0xFFFF:
                    raise ValueError
                bits(0)
                if at + 8 * n > 8 * len(data):
                    raise EOFError
                at += 8 * n
                block |= {"literals": n, "bytes": n}
            elif kind == 3:
                raise ValueError
            else:
                long, far = fixed
                if kind == 2:
                    counts = bits(5) + 257, bits(5) + 1, bits(4) + 4
                    sizes = [0] * 19
                    for place in _ORDER[: counts[2]]:
                        sizes[place] = bits(3)
                    inner, lengths = _codes(sizes), []
                    while len(lengths) < counts[0] + counts[1]:
                        s = symbol(inner)
                        lengths += [s] if s < 16 else [lengths[-1]] * (3 + bits(2)) if s == 16 else [0] * (3 + bits(3) if s == 17 else 11 + bits(7))
                    long, far = _codes(lengths[: counts[0]]), _codes(lengths[counts[0] :])
                while (s := symbol(long)) != 256:
                    if s < 256:
                        block["literals"] += 1
                        block["bytes"] += 1
                    else:
                        base, extra = _LENGTHS[s - 257]
                        block["bytes"] += base + bits(extra)
                        block["matches"] += 1
                        bits(_DISTANCES[symbol(far)][1])
                    if total + block["bytes"] > most:
                        return blocks, "unpacks to too much"
            total += block["bytes"]
            blocks.append(block | {"end": at})
    except EOFError:
        return blocks, "ends too soon"
    except (ValueError, IndexError):
        return blocks, "does not unpack"
    return blocks, None
