"""64-bit hashes of words and of runs of words, for the operators that compare texts by words."""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z lower-cased, other bytes as they are.
_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
#: Words that a Python worker remembers with their hashes.
REMEMBERED = 100_000
#: Odd multipliers of the two polynomials over words (fixed values, of no meaning).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def forget() -> None:
    """Give the memory back at the end of a task; Python workers outlive their stages."""
    _hashes.clear()


def split(text: str | None, lower: bool) -> list[bytes]:
    """Words between ASCII blanks, as UTF-8."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(_LOWER) if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**-i and base**i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size, out = max(n, 4096), []
        for b in (pow(base, -1, 1 << 64), base):
            full = np.full(size, b, np.uint64)
            full[0] = 1
            out.append(np.multiply.accumulate(full))
        if size > 1 << 20:
            return out[0], out[1]
        _powers[base] = (out[0], out[1])
    return _powers[base]


def windows(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of ``k`` words, by its first word; runs of equal words hash alike."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    down, up = _tables(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * down[: len(hashes)], out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * up[:n])
