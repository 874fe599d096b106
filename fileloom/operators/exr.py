"""OpenEXR: scan lines or tiles (of several levels the largest) of half, float or integer channels, plain, RLE or ZIP."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from fileloom.operators.images import checked, from_linear

_KINDS = {0: ("<u4", 4), 1: ("<f2", 2), 2: ("<f4", 4)}
_LINES = {0: 1, 1: 1, 2: 1, 3: 16}


def _undo(data: bytes) -> bytes:
    """Undoes the differences and the split in halves that precede compression."""
    a = np.frombuffer(data, np.uint8).copy()
    a[1:] -= 128
    a = np.cumsum(a, dtype=np.uint8)
    out = np.empty_like(a)
    half = (len(a) + 1) // 2
    out[::2], out[1::2] = a[:half], a[half:]
    return out.tobytes()


def _runs(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = struct.unpack_from("b", data, i)[0]
        if n < 0:
            out += data[i + 1 : i + 1 - n]
            i += 1 - n
        else:
            out += data[i + 1 : i + 2] * (n + 1)
            i += 2
    return bytes(out)


def _strips(data: bytes, at: int, step: int, top: int, width: int, height: int):
    """(x, y, columns, rows, bytes) of each run of lines."""
    for offset in struct.unpack_from(f"<{-(-height // step)}Q", data, at):
        y, size = struct.unpack_from("<iI", data, offset)
        yield 0, y - top, width, min(step, height - (y - top)), data[offset + 8 : offset + 8 + size]


def _tiles(data: bytes, at: int, tag: bytes, width: int, height: int):
    """The same of each tile of the largest level, which comes first."""
    wide, high = struct.unpack_from("<II", tag)
    for offset in struct.unpack_from(f"<{-(-width // wide) * -(-height // high)}Q", data, at):
        i, j, _, _, size = struct.unpack_from("<4iI", data, offset)
        x, y = i * wide, j * high
        yield x, y, min(wide, width - x), min(high, height - y), data[offset + 20 : offset + 20 + size]


def decode(data: bytes) -> np.ndarray:
    if data[:4] != b"\x76\x2f\x31\x01":
        raise ValueError("invalid EXR signature")
    flags = struct.unpack_from("<I", data, 4)[0]
    if flags & 0x1800:
        raise ValueError("deep and multi-part files are not supported")
    at, tags = 8, {}
    while data[at]:
        name_end = data.index(0, at)
        kind_end = data.index(0, name_end + 1)
        size = struct.unpack_from("<I", data, kind_end + 1)[0]
        tags[data[at:name_end]] = data[kind_end + 5 : kind_end + 5 + size]
        at = kind_end + 5 + size
    at += 1
    channels, raw = [], tags[b"channels"]
    while raw[0]:
        name, _, raw = raw.partition(b"\0")
        kind, _, dx, dy = struct.unpack_from("<iB3xii", raw)
        if (dx, dy) != (1, 1):
            raise ValueError("subsampled channels are not supported")
        channels.append((name, *_KINDS[kind]))
        raw = raw[16:]
    packing = tags[b"compression"][0]
    if packing not in _LINES:
        raise ValueError(f"unsupported compression {packing}")
    left, top, right, bottom = struct.unpack("<4i", tags[b"dataWindow"])
    width, height = right - left + 1, bottom - top + 1
    checked(width, height)
    planes = {name: np.zeros((height, width), np.float32) for name, _, _ in channels}
    pixel = sum(n for _, _, n in channels)
    for x, y, cols, rows, body in _tiles(data, at, tags[b"tiles"], width, height) if flags & 0x200 else _strips(data, at, _LINES[packing], top, width, height):
        if packing and len(body) < rows * cols * pixel:
            body = _undo(_runs(body) if packing == 1 else zlib.decompress(body))
        pos = 0
        for k in range(rows):
            for name, kind, n in channels:
                planes[name][y + k, x : x + cols] = np.frombuffer(body, kind, cols, pos)
                pos += n * cols
    grey = planes.get(b"Y")
    out = np.ones((height, width, 4), np.float32)
    for k, name in enumerate((b"R", b"G", b"B")):
        out[..., k] = planes.get(name, grey if grey is not None else 0)
    if b"A" in planes:
        out[..., 3] = planes[b"A"]
    return from_linear(out)
