"""The standard security handler of PDFs that open without a password: RC4, and AES of 128 bits."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

# What passwords are filled up with.
FILL = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, byte in enumerate(data):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[j]
        state[i], state[j] = b, a
        out[k] = byte ^ state[(a + b) & 255]
    return bytes(out)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The S-box, its inverse, and products by 9, 11, 13 and 14 in the field of 256 elements."""

    def product(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a = a << 1 ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    box = np.zeros(256, np.uint8)
    for x in range(256):
        inverse = next((y for y in range(256) if product(x, y) == 1), 0)
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box[x] = turned ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, {k: np.array([product(x, k) for x in range(256)], np.uint8) for k in (9, 11, 13, 14)}


def _round_keys(key: bytes) -> np.ndarray:
    box, words, factor = _tables()[0], [list(key[4 * i : 4 * i + 4]) for i in range(4)], 1
    for i in range(4, 44):
        word = list(words[-1])
        if i % 4 == 0:
            word = [int(box[b]) for b in word[1:] + word[:1]]
            word[0] ^= factor
            factor = factor << 1 ^ (0x11B if factor & 0x80 else 0)
        words.append([a ^ b for a, b in zip(word, words[i - 4], strict=True)])
    return np.array(words, np.uint8).reshape(11, 16)


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Decrypted; the first block is the start vector, the last byte says how many were added."""
    n = len(data) // 16
    if n < 2:
        return b""
    blocks = np.frombuffer(data, np.uint8, 16 * n).reshape(n, 16)
    _, back, times = _tables()
    keys = _round_keys(key)
    rows = np.array([(c - 4 * (c % 4)) % 16 for c in range(16)])  # each row is turned right by its number
    x = blocks[1:] ^ keys[10]
    for k in range(9, -1, -1):
        x = back[x[:, rows]] ^ keys[k]
        if k:
            c = x.reshape(-1, 4, 4)
            x = np.stack([times[14][c[:, :, r]] ^ times[11][c[:, :, (r + 1) % 4]] ^ times[13][c[:, :, (r + 2) % 4]] ^ times[9][c[:, :, (r + 3) % 4]] for r in range(4)], axis=2).reshape(-1, 16)
    plain = (x ^ blocks[:-1]).tobytes()
    return plain[: len(plain) - plain[-1]] if 1 <= plain[-1] <= 16 else plain


class Lock:
    """The key of a document that opens without a password, and how its streams are encrypted."""

    def __init__(self, d: dict, first_id: bytes) -> None:
        version, revision = d.get("V", 0), d.get("R", 0)
        if d.get("Filter") != "Standard" or version not in (1, 2, 4):
            raise ValueError("of a kind that is not read")
        size = 5 if version == 1 else d.get("Length", 128 if version == 4 else 40) // 8
        self.method = "V2"
        if version == 4:
            size = 16
            own = (d.get("CF") or {}).get(d.get("StmF", "Identity"))
            self.method = own.get("CFM", "None") if own else "None"
        seed = FILL + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id
        if revision >= 4 and d.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = hashlib.md5(seed).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if not self._opens(d["U"], revision, first_id):
            raise ValueError("with a password")

    def _opens(self, u: bytes, revision: int, first_id: bytes) -> bool:
        if revision < 3:
            return rc4(self.key, FILL) == u[:32]
        x = hashlib.md5(FILL + first_id).digest()
        for k in range(20):
            x = rc4(bytes(b ^ k for b in self.key), x)
        return x == u[:16]

    def open(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method not in ("V2", "AESV2"):
            return data
        seed = self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(seed).digest()[: min(len(self.key) + 5, 16)]
        return aes_cbc(key, data) if self.method == "AESV2" else rc4(key, data)
