"""QR symbols drawn here, damaged and turned, and read again."""

import numpy as np
import pytest

from gleanery.sources import codes as C


def drawn(said: str, version: int, level: str, mask: int) -> np.ndarray:
    """A symbol with a text in byte mode."""
    data = said.encode()
    bits = "0100" + f"{len(data):0{8 if version < 10 else 16}b}" + "".join(f"{b:08b}" for b in data) + "0000"
    sizes = C.blocks_of(version, level)
    room = sum(k for k, _ in sizes)
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    assert len(words) <= room
    words += [(0xEC, 0x11)[i % 2] for i in range(room - len(words))]
    blocks, checks = [], []
    for k, n in sizes:
        block, words = words[:k], words[k:]
        divisor = [1]
        for i in range(n):
            divisor = [a ^ C.times(b, C._EXP[i]) for a, b in zip(divisor + [0], [0] + divisor)]
        rest = block + [0] * n
        for i in range(k):
            lead = rest[i]
            for j, d in enumerate(divisor):
                rest[i + j] ^= C.times(lead, d)
        blocks.append(block)
        checks.append(rest[k:])
    order = [b[i] for i in range(max(map(len, blocks))) for b in blocks if i < len(b)] + [c[i] for i in range(len(checks[0])) for c in checks]
    stream = "".join(f"{b:08b}" for b in order)
    n = 17 + 4 * version
    grid = np.zeros((n, n), bool)
    places = list(C.path(version))
    for (r, c), bit in zip(places, stream + "0" * (len(places) - len(stream))):
        grid[r, c] = (bit == "1") ^ (C.MASKS[mask](r, c) == 0)
    ring = np.ones((7, 7), bool)
    ring[1:6, 1:6] = False
    ring[2:5, 2:5] = True
    grid[6, 8 : n - 8] = grid[8 : n - 8, 6] = np.arange(8, n - 8) % 2 == 0
    for r, c in ((0, 0), (0, n - 7), (n - 7, 0)):
        grid[r : r + 7, c : c + 7] = ring
    marks = C.MARKS[version - 1]
    for r in marks:
        for c in marks:
            if (r, c) not in ((6, 6), (6, marks[-1]), (marks[-1], 6)):
                grid[r - 2 : r + 3, c - 2 : c + 3] = True
                grid[r - 1 : r + 2, c - 1 : c + 2] = False
                grid[r, c] = True
    for (first, second), i in zip(C.format_places(n), range(14, -1, -1)):
        grid[first] = grid[second] = C.format_bits(level, mask) >> i & 1
    grid[n - 8, 8] = True
    return grid


def picture(grid: np.ndarray, scale: int = 4, margin: int = 4) -> np.ndarray:
    return np.where(np.kron(np.pad(grid, margin), np.ones((scale, scale), bool)), 30, 220).astype(np.uint8)


@pytest.mark.parametrize("version,level,mask", [(1, "L", 0), (2, "M", 3), (3, "H", 5), (5, "Q", 7), (7, "L", 2), (10, "M", 6)])
def test_symbols(version, level, mask):
    said = "https://bit.ly/x é"[: 14 if version == 1 else 18]
    grid = drawn(said, version, level, mask)
    assert C.read(grid) == said and C.symbols(picture(grid)) == [said]
    assert C.symbols(np.rot90(picture(grid, 3))) == [said] and C.symbols(np.rot90(picture(grid), 2)) == [said]


def test_damage_is_put_right():
    grid = drawn("WIFI:S:home;P:x;;", 3, "H", 1)
    rng = np.random.default_rng(1)
    spots = [p for p in C.path(3)]
    for i in rng.choice(len(spots), 12, replace=False):
        grid[spots[i]] ^= True
    assert C.read(grid) == "WIFI:S:home;P:x;;"
    for i in rng.choice(len(spots), 300, replace=False):
        grid[spots[i]] ^= True
    assert C.read(grid) is None


def test_pictures_as_rows(spark):
    two = np.concatenate([picture(drawn("geo:1,2", 1, "L", 4)), picture(drawn("tel:5", 1, "L", 4))], axis=1)
    noise = np.random.default_rng(2).integers(0, 255, (40, 50)).astype(np.uint8)
    rows = [("a", two.shape[1], two.shape[0], bytearray(two.tobytes())), ("b", 50, 40, bytearray(noise.tobytes())), ("c", 3, 3, bytearray(b"x")), ("d", 2, 1, None)]
    got = C.codes_of(spark.createDataFrame(rows, "file_id string, width int, height int, pixels binary")).collect()
    assert [(r["file_id"], r["text"], r["kind"]) for r in got] == [("a", "geo:1,2", "qrplace"), ("a", "tel:5", "qrtext")]
