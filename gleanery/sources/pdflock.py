"""Locked PDF files that open without a password: the key, and strings and streams in clear."""

from __future__ import annotations

import hashlib

#: Bytes of one stream that are unlocked by the slow cipher.
MOST_AES = 1 << 22
# Fixed value of the format: what fills a password up.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = c ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def _double(a: int) -> int:
    return (a << 1 ^ (0x11B if a & 0x80 else 0)) & 0xFF


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        out, a, b = out ^ (a if b & 1 else 0), _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of the cipher, from inverses in its field, and the way back."""
    there, back = [0] * 256, [0] * 256
    inverse = {0: 0}
    power, powers = 1, []
    for _ in range(255):
        powers.append(power)
        power ^= _double(power)
    for i, p in enumerate(powers):
        inverse[p] = powers[-i % 255]
    for x in range(256):
        v = inverse[x]
        y = v
        for k in range(1, 5):
            y ^= (v << k | v >> 8 - k) & 0xFF
        there[x] = y ^ 0x63
        back[there[x]] = x
    return there, back


_THERE, _BACK = _boxes()
_BY = {k: [_product(x, k) for x in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    def __init__(self, key: bytes) -> None:
        words, n, turn = [list(key[i : i + 4]) for i in range(0, len(key), 4)], len(key) // 4, 1
        for i in range(n, 4 * (n + 7)):
            w = list(words[-1])
            if i % n == 0:
                w = [_THERE[b] for b in w[1:] + w[:1]]
                w[0] ^= turn
                turn = _double(turn)
            elif n > 6 and i % n == 4:
                w = [_THERE[b] for b in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.rounds = [sum(words[i : i + 4], []) for i in range(0, len(words), 4)]

    def encrypted(self, block: bytes) -> bytes:
        s = [a ^ k for a, k in zip(block, self.rounds[0])]
        for r, key in enumerate(self.rounds[1:], 1):
            s = [_THERE[s[(4 * (c + i) + i) % 16]] for c in range(4) for i in range(4)]
            if r < len(self.rounds) - 1:
                two, three, mixed = _BY[2], _BY[3], []
                for c in range(0, 16, 4):
                    a, b, d, e = s[c : c + 4]
                    mixed += [two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e]]
                s = mixed
            s = [a ^ k for a, k in zip(s, key)]
        return bytes(s)

    def decrypted(self, block: bytes) -> bytes:
        s = [a ^ k for a, k in zip(block, self.rounds[-1])]
        for r in range(len(self.rounds) - 2, -1, -1):
            s = [_BACK[s[(4 * (c - i) + i) % 16]] for c in range(4) for i in range(4)]
            s = [a ^ k for a, k in zip(s, self.rounds[r])]
            if r:
                n, e, t, f = (_BY[k] for k in (9, 11, 13, 14))
                mixed = []
                for c in range(0, 16, 4):
                    a, b, d, g = s[c : c + 4]
                    mixed += [f[a] ^ e[b] ^ t[d] ^ n[g], n[a] ^ f[b] ^ e[d] ^ t[g], t[a] ^ n[b] ^ f[d] ^ e[g], e[a] ^ t[b] ^ n[d] ^ f[g]]
                s = mixed
        return bytes(s)


def cbc_encrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    cipher, out, last = Aes(key), bytearray(), start
    for i in range(0, len(data), 16):
        last = cipher.encrypted(bytes(a ^ b for a, b in zip(data[i : i + 16], last)))
        out += last
    return bytes(out)


def cbc_decrypted(key: bytes, start: bytes, data: bytes) -> bytes:
    cipher, out, last = Aes(key), bytearray(), start
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += bytes(a ^ b for a, b in zip(cipher.decrypted(block), last))
        last = block
    return bytes(out)


def strengthened(password: bytes, salt: bytes) -> bytes:
    """The hash of the newest locks: rounds of a cipher and a hash that its output chooses."""
    k, i = hashlib.sha256(password + salt).digest(), 0
    while True:
        e = cbc_encrypted(k[:16], k[16:32], (password + k) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Lock:
    """The key of a file that opens without a password; ``key`` is None where one is needed."""

    def __init__(self, doc, first_id: bytes) -> None:
        lock, get = doc.get(doc.trailer, b"Encrypt"), doc.get
        self.version, revision = get(lock, b"V") or 0, get(lock, b"R") or 0
        o, u = (bytes(get(lock, k) or b"") for k in (b"O", b"U"))
        size = (get(lock, b"Length") or 40) // 8 if self.version > 1 else 5
        rights = (get(lock, b"P") or 0) & 0xFFFFFFFF
        method = get(lock, b"CF", bytes(get(lock, b"StmF") or b"Identity"), b"CFM")
        self.aes = self.version == 5 or method == b"AESV2"
        self.plain = self.version >= 4 and method in (None, b"None")
        self.key: bytes | None = None
        if self.version == 5 and len(u) >= 48:
            hashed = strengthened if revision >= 6 else lambda p, s: hashlib.sha256(p + s).digest()
            if hashed(b"", u[32:40]) == u[:32]:
                self.key = cbc_decrypted(hashed(b"", u[40:48]), bytes(16), bytes(get(lock, b"UE") or b"")[:32])
        elif 0 < self.version < 5:
            size = 16 if self.version == 4 else size
            k = hashlib.md5(PAD + o[:32] + rights.to_bytes(4, "little") + first_id + (b"\xff" * 4 if revision >= 4 and get(lock, b"EncryptMetadata") is False else b"")).digest()
            for _ in range(50 if revision >= 3 else 0):
                k = hashlib.md5(k[:size]).digest()
            k = k[:size]
            if revision == 2:
                good = rc4(k, PAD) == u[:32]
            else:
                x = hashlib.md5(PAD + first_id).digest()
                for i in range(20):
                    x = rc4(bytes(b ^ i for b in k), x)
                good = x == u[:16]
            self.key = k if good else None

    def opened(self, data: bytes, number: int, generation: int = 0) -> bytes:
        if self.plain or self.key is None:
            return data
        if self.version == 5:
            key = self.key
        else:
            salt = number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.aes else b"")
            key = hashlib.md5(self.key + salt).digest()[: min(len(self.key) + 5, 16)]
        if not self.aes:
            return rc4(key, data)
        if len(data) < 32 or len(data) > MOST_AES:
            return b""
        out = cbc_decrypted(key, data[:16], data[16:])
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out
