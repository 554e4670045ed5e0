"""QR symbols in pictures: found, sampled, corrected and read. Symbols up to version 10, turned or not, without perspective."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VERSION = 10
# Check bytes of a block and blocks, by level (L, M, Q, H) and version from 1 to 10; centres of alignment marks by version.
CHECKS = {
    "L": ([7, 10, 15, 20, 26, 18, 20, 24, 30, 18], [1, 1, 1, 1, 1, 2, 2, 2, 2, 4]),
    "M": ([10, 16, 26, 18, 24, 16, 18, 22, 22, 26], [1, 1, 1, 2, 2, 4, 4, 4, 5, 5]),
    "Q": ([13, 22, 18, 26, 18, 24, 18, 22, 20, 24], [1, 1, 2, 2, 4, 4, 6, 6, 8, 8]),
    "H": ([17, 28, 22, 16, 22, 28, 26, 26, 24, 28], [1, 1, 2, 4, 4, 4, 5, 6, 8, 8]),
}
MARKS = [[], [6, 18], [6, 22], [6, 26], [6, 30], [6, 34], [6, 22, 38], [6, 24, 42], [6, 26, 46], [6, 28, 50]]
LEVELS, FORMAT_MASK, FORMAT_CODE = "MLHQ", 0x5412, 0x537
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
MASKS = [
    lambda r, c: (r + c) % 2, lambda r, c: r % 2, lambda r, c: c % 3, lambda r, c: (r + c) % 3, lambda r, c: (r // 2 + c // 3) % 2,
    lambda r, c: r * c % 2 + r * c % 3, lambda r, c: (r * c % 2 + r * c % 3) % 2, lambda r, c: ((r + c) % 2 + r * c % 3) % 2,
]

_EXP = [1]
for _ in range(254):
    _EXP.append(_EXP[-1] << 1 ^ (0x11D if _EXP[-1] & 0x80 else 0))
_LOG = {v: i for i, v in enumerate(_EXP)}


def times(a: int, b: int) -> int:
    return _EXP[(_LOG[a] + _LOG[b]) % 255] if a and b else 0


def at(poly: list[int], x: int) -> int:
    """The value of a polynomial, highest power first."""
    out = 0
    for c in poly:
        out = times(out, x) ^ c
    return out


def corrected(block: list[int], checks: int) -> list[int] | None:
    """The data of a block with its errors put right; None where there are too many."""
    sums = [at(block, _EXP[i]) for i in range(checks)]
    if any(sums):
        # the shortest recurrence that the sums follow locates the errors
        locator, before, shift, last = [1], [1], 1, 1
        for i in range(checks):
            off = 0
            for j, c in enumerate(locator[: i + 1]):
                off ^= times(c, sums[i - j])
            if not off:
                shift += 1
                continue
            scale = times(off, _EXP[-_LOG[last] % 255])
            grown = locator + [0] * max(0, len(before) + shift - len(locator))
            for j, c in enumerate(before):
                grown[j + shift] ^= times(scale, c)
            if 2 * (len(locator) - 1) <= i:
                before, last, shift = locator, off, 1
            else:
                shift += 1
            locator = grown
        while locator and not locator[-1]:
            locator.pop()
        errors, n = len(locator) - 1, len(block)
        places = [i for i in range(n) if not at(locator[::-1], _EXP[-i % 255])]
        if not 0 < errors <= checks // 2 or len(places) != errors:
            return None
        values = [0] * checks
        for i, s in enumerate(sums):
            for j, c in enumerate(locator):
                if i + j < checks:
                    values[i + j] ^= times(s, c)
        block = list(block)
        for p in places:
            x = _EXP[-p % 255]
            slope = 0
            for j in range(1, len(locator), 2):
                slope ^= times(locator[j], _EXP[_LOG[x] * (j - 1) % 255])
            if not slope:
                return None
            top = at(values[:checks][::-1], x)
            block[n - 1 - p] ^= times(times(top, _EXP[p % 255]), _EXP[-_LOG[slope] % 255]) if top else 0
        if any(at(block, _EXP[i]) for i in range(checks)):
            return None
    return block[: len(block) - checks]


def reserved(version: int) -> np.ndarray:
    """Modules of a symbol that hold no data."""
    n = 17 + 4 * version
    out = np.zeros((n, n), bool)
    out[:9, :9] = out[:9, n - 8 :] = out[n - 8 :, :9] = True
    out[6, :] = out[:, 6] = True
    marks = MARKS[version - 1]
    for r in marks:
        for c in marks:
            if (r, c) not in ((6, 6), (6, marks[-1]), (marks[-1], 6)):
                out[r - 2 : r + 3, c - 2 : c + 3] = True
    if version >= 7:
        out[:6, n - 11 : n - 8] = out[n - 11 : n - 8, :6] = True
    return out


def path(version: int):
    """Data modules in the order in which bits stand: pairs of columns from the right, up and down in turn."""
    n, taken = 17 + 4 * version, reserved(version)
    up, right = True, n - 1
    while right > 0:
        right -= right == 6
        for i in range(n):
            r = n - 1 - i if up else i
            for c in (right, right - 1):
                if not taken[r, c]:
                    yield r, c
        up, right = not up, right - 2


def blocks_of(version: int, level: str) -> list[tuple[int, int]]:
    """(data bytes, check bytes) of each block."""
    checks, count = (x[version - 1] for x in CHECKS[level])
    whole = sum(1 for _ in path(version)) // 8
    short, longer = whole // count, whole % count
    return [(short - checks + (i >= count - longer), checks) for i in range(count)]


def format_bits(level: str, mask: int) -> int:
    data = LEVELS.index(level) << 3 | mask
    rest = data << 10
    for i in range(4, -1, -1):
        if rest >> i + 10 & 1:
            rest ^= FORMAT_CODE << i
    return (data << 10 | rest) ^ FORMAT_MASK


def format_places(n: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Both places of each format bit, the highest first."""
    first = [(8, c) for c in (0, 1, 2, 3, 4, 5, 7, 8)] + [(r, 8) for r in (7, 5, 4, 3, 2, 1, 0)]
    second = [(n - 1 - i, 8) for i in range(7)] + [(8, n - 8 + i) for i in range(8)]
    return list(zip(first, second))


def read(grid: np.ndarray) -> bytes | str | None:
    """The text of a symbol given as modules (true: dark); None where it can't be read."""
    n = len(grid)
    version = (n - 17) // 4
    if (n - 17) % 4 or not 1 <= version <= MOST_VERSION:
        return None
    best = None
    for side in (0, 1):
        seen = 0
        for places in format_places(n):
            seen = seen << 1 | int(grid[places[side]])
        for level in LEVELS:
            for mask in range(8):
                off = bin(seen ^ format_bits(level, mask)).count("1")
                if off <= 3 and (best is None or off < best[0]):
                    best = off, level, mask
    if best is None:
        return None
    _, level, mask = best
    bits = [int(grid[r, c]) ^ (MASKS[mask](r, c) == 0) for r, c in path(version)]
    data = [int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits) - 7, 8)]
    sizes = blocks_of(version, level)
    parts: list[list[int]] = [[] for _ in sizes]
    stream = iter(data)
    for i in range(max(k for k, _ in sizes)):
        for part, (k, _) in zip(parts, sizes):
            if i < k:
                part.append(next(stream))
    for _ in range(sizes[0][1]):
        for part in parts:
            part.append(next(stream))
    out: list[int] = []
    for part, (_, checks) in zip(parts, sizes):
        good = corrected(part, checks)
        if good is None:
            return None
        out += good
    return text("".join(f"{b:08b}" for b in out), version)


def text(bits: str, version: int) -> str | None:
    place, out, charset = 0, [], "utf-8"

    def take(k: int) -> int:
        nonlocal place
        if place + k > len(bits):
            raise EOFError
        place += k
        return int(bits[place - k : place] or "0", 2)

    try:
        while len(bits) - place >= 4 and (mode := take(4)):
            if mode == 7:
                number = take(8)
                number = number if number < 128 else (number & 63) << 8 | take(8)
                charset = {3: "latin-1", 20: "shift_jis", 26: "utf-8"}.get(number, "utf-8")
            elif mode == 1:
                count = take(10 if version < 10 else 12)
                for k in [3] * (count // 3) + ([count % 3] if count % 3 else []):
                    out.append(f"{take((0, 4, 7, 10)[k]):0{k}d}")
            elif mode == 2:
                count = take(9 if version < 10 else 11)
                for k in [2] * (count // 2) + [1] * (count % 2):
                    v = take(11 if k == 2 else 6)
                    out.append(ALPHABET[v // 45] + ALPHABET[v % 45] if k == 2 else ALPHABET[v])
            elif mode == 4:
                raw = bytes(take(8) for _ in range(take(8 if version < 10 else 16)))
                try:
                    out.append(raw.decode(charset))
                except UnicodeDecodeError:
                    out.append(raw.decode("latin-1"))
            elif mode == 8:
                for _ in range(take(8 if version < 10 else 10)):
                    v = take(13)
                    v = (v // 0xC0 << 8 | v % 0xC0) + (0x8140 if v < 0x1F00 else 0xC140)
                    out.append(v.to_bytes(2, "big").decode("shift_jis", "replace"))
            else:
                return None
    except (EOFError, IndexError):
        return None
    return "".join(out)


@dataclass(frozen=True)
class Finder:
    x: float
    y: float
    size: float


def binarised(grey: np.ndarray) -> np.ndarray:
    """Dark pixels, by the level that parts the histogram best."""
    n = np.bincount(grey.reshape(-1), minlength=256).astype(float)
    weight, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (total[-1] * weight / weight[-1] - total) ** 2 / (weight * (weight[-1] - weight))
    return grey <= int(np.nanargmax(np.where(np.isfinite(apart), apart, -1)))


def _runs(line: np.ndarray):
    """Starts and lengths of equal runs, with whether the first is dark."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(line.astype(np.int8))) + 1, [len(line)]])
    return cuts[:-1], np.diff(cuts), bool(line[0])


def _centres(line: np.ndarray) -> list[tuple[float, float]]:
    """(middle, module size) of runs 1:1:3:1:1 that begin dark."""
    starts, sizes, dark = _runs(line)
    out = []
    for i in range(0 if dark else 1, len(sizes) - 4, 2):
        s = sizes[i : i + 5]
        unit = s.sum() / 7
        if unit >= 1 and (np.abs(s - unit * np.array([1, 1, 3, 1, 1])) <= unit * np.array([0.6, 0.6, 1.2, 0.6, 0.6])).all():
            out.append((starts[i + 2] + s[2] / 2, unit))
    return out


def finders(dark: np.ndarray) -> list[Finder]:
    hits: list[list[float]] = []
    for y in range(len(dark)):
        if not dark[y].any():
            continue
        for x, unit in _centres(dark[y]):
            column = dark[:, int(x)]
            near = [(cy, u) for cy, u in _centres(column) if abs(cy - y - 0.5) <= 2 * unit and 0.5 <= u / unit <= 2]
            for cy, u in near[:1]:
                for h in hits:
                    if abs(h[0] / h[3] - x) < 3 * unit and abs(h[1] / h[3] - cy) < 3 * unit:
                        h[0], h[1], h[2], h[3] = h[0] + x, h[1] + cy, h[2] + (u + unit) / 2, h[3] + 1
                        break
                else:
                    hits.append([x, cy, (u + unit) / 2, 1])
    return [Finder(h[0] / h[3], h[1] / h[3], h[2] / h[3]) for h in sorted(hits, key=lambda h: -h[3]) if h[3] >= 2]


def symbols(grey: np.ndarray, most: int = 24) -> list[str]:
    """Texts of the symbols in a picture, in order of their corners. ``most`` finders are looked at, the clearest first."""
    if grey.size == 0 or grey.min() == grey.max():
        return []
    dark, out = binarised(grey), []
    found = finders(dark)[:most]
    tried = set()
    for i, corner in enumerate(found):
        for j, right in enumerate(found):
            for k, low in enumerate(found):
                if len({i, j, k}) < 3:
                    continue
                a, b = np.array([right.x - corner.x, right.y - corner.y]), np.array([low.x - corner.x, low.y - corner.y])
                la, lb = np.hypot(*a), np.hypot(*b)
                unit = (corner.size + right.size + low.size) / 3
                # a right angle, clockwise, with sides of one length
                if abs(la - lb) > 0.15 * max(la, lb) or a[0] * b[1] - a[1] * b[0] < 0.9 * la * lb or max(corner.size, right.size, low.size) > 1.6 * min(corner.size, right.size, low.size):
                    continue
                guess = (la + lb) / 2 / unit + 7
                turn = max(abs(a[0]), abs(a[1])) / la  # along a turned line modules look larger
                for version in sorted(range(1, MOST_VERSION + 1), key=lambda v: abs(17 + 4 * v - guess * turn))[:3]:
                    n = 17 + 4 * version
                    steps = (np.arange(n) - 3) / (n - 7)
                    xs = corner.x + steps[None, :] * a[0] + steps[:, None] * b[0]
                    ys = corner.y + steps[None, :] * a[1] + steps[:, None] * b[1]
                    px, py = np.floor(xs).astype(int), np.floor(ys).astype(int)
                    if px.min() < 0 or py.min() < 0 or px.max() >= dark.shape[1] or py.max() >= dark.shape[0]:
                        continue
                    said = read(dark[py, px])
                    if said is not None:
                        if (key := (round(corner.x), round(corner.y), said)) not in tried:
                            tried.add(key)
                            out.append((round(corner.y), round(corner.x), said))
                        break
    return [s for _, _, s in sorted(out)]


def codes_of(rasters: DataFrame) -> DataFrame:
    """Rasters (file_id, width, height, pixels: a byte of grey each) as ``file_id``, ``text``, ``kind`` of each symbol in them."""
    from gleanery.functions.text import code_kind

    @F.pandas_udf("array<string>")
    def run(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        def one(p, w, h):
            return symbols(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) if p is not None and w * h == len(p) and len(p) else []

        return pd.Series([one(*x) for x in zip(pixels, width, height)])

    found = rasters.select("file_id", F.explode(run("pixels", "width", "height")).alias("text"))
    return found.withColumn("kind", code_kind(F.col("text")))
