"""JPEG: a baseline encoder with tables made for each image, and a decoder of baseline and progressive files."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from fileloom.operators.images import checked, rgba

# The standard's example quantisation tables, by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)

#: Places of a block by diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_K = np.arange(8)
#: Orthonormal cosine transform.
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    quality = min(max(quality, 1), 100)
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * factor + 50) // 100, 1, 255)


def code_lengths(counts: dict[int, int], longest: int = 16) -> dict[int, int]:
    """Lengths of a prefix code of at most longest bits that leaves its last code, all ones, unused."""
    counts = dict(counts) | {256: 0}
    while True:
        heap = [(max(c, 1) if s < 256 else 0, s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= longest:
            most = max(depth.values())  # the reserved symbol has the longest code
            swap = next(s for s in depth if depth[s] == most)
            depth[swap], depth[256] = depth[256], depth[swap]
            del depth[256]
            return {s: max(d, 1) for s, d in depth.items()}
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol, codes in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (code, last)
        code += 1
    return out


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    height, width = plane.shape
    plane = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge") - 128
    cells = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    c = (_DCT @ cells @ _DCT.T).reshape(-1, 64) / table
    return np.rint(c).astype(np.int64)[:, ZIGZAG]


def _symbols(blocks: np.ndarray) -> list[tuple[list, list]]:
    """For each block (DC, AC) symbols with their extra bits: (symbol, value, bits)."""
    out, last = [], 0
    for row in blocks.tolist():
        diff, last = row[0] - last, row[0]
        n = abs(diff).bit_length()
        dc = [(n, diff if diff >= 0 else diff + (1 << n) - 1, n)]
        ac, run = [], 0
        top = 63
        while top and not row[top]:
            top -= 1
        for v in row[1 : top + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                ac.append((0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            ac.append((run << 4 | n, v if v > 0 else v + (1 << n) - 1, n))
            run = 0
        if top < 63:
            ac.append((0, 0, 0))
        out.append((dc, ac))
    return out


def encode(a: np.ndarray, quality: int) -> bytes:
    """Three components at full resolution; alpha is lost."""
    height, width = a.shape[:2]
    if max(height, width) > 65535:
        raise ValueError("too large for JPEG")
    r, g, b = (a[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = (y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128)
    tables = [scaled(LUMINANCE, quality), scaled(CHROMINANCE, quality)]
    coded = [_symbols(_blocks(p, tables[min(k, 1)])) for k, p in enumerate(planes)]
    codes = {}
    for kind in (0, 1):  # luminance, chrominance
        for ac in (0, 1):
            counts = Counter(s for k, c in enumerate(coded) if min(k, 1) == kind for block in c for s, _, _ in block[ac])
            codes[kind, ac] = canonical(code_lengths(counts))

    def segment(mark: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0")
    for k, t in enumerate(tables):
        out += segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].astype(np.uint8)))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(3)))
    for (kind, ac), table in codes.items():
        order = sorted(table, key=lambda s: (table[s][1], s))
        out += segment(0xC4, bytes([ac << 4 | kind]) + bytes(sum(table[s][1] == n for s in order) for n in range(1, 17)) + bytes(order))
    out += segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    bits = have = 0
    body = bytearray()
    for units in zip(*coded, strict=True):
        for k, block in enumerate(units):
            for ac in (0, 1):
                table = codes[min(k, 1), ac]
                for s, value, n in block[ac]:
                    code, length = table[s]
                    bits = bits << (length + n) | code << n | value
                    have += length + n
            if have > 512:
                body += (bits >> have % 8).to_bytes(have // 8, "big")
                bits, have = bits & ((1 << have % 8) - 1), have % 8
    pad = -have % 8
    body += (bits << pad | (1 << pad) - 1).to_bytes((have + pad) // 8, "big")
    return out + bytes(body).replace(b"\xff", b"\xff\0") + b"\xff\xd9"


# --- decoding ----------------------------------------------------------------------------------------------------


class Bits:
    """Bits of entropy-coded data; zeros after its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.bits, self.have = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            self.at += 8
            self.bits = self.bits << 64 | int.from_bytes(part.ljust(8, b"\0"), "big")
            self.have += 64
            if self.at > len(self.data) + 4096:
                raise ValueError("unexpected end of image data")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self._fill(n)
        self.have -= n
        out = self.bits >> self.have
        self.bits &= (1 << self.have) - 1
        return out

    def symbol(self, table: list[int]) -> int:
        self._fill(16)
        found = table[self.bits >> (self.have - 16)]
        if not found:
            raise ValueError("invalid Huffman code")
        self.have -= found >> 8
        self.bits &= (1 << self.have) - 1
        return found & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the length and symbol of the code they begin with; 0 if there is none."""
    out, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            begin = code << (16 - length)
            out[begin : begin + (1 << (16 - length))] = [length << 8 | symbols[k]] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out[:65536]


class _Component:
    def __init__(self, key: int, h: int, v: int, table: int) -> None:
        self.key, self.h, self.v, self.table = key, h, v, table
        self.dc = self.ac = 0
        self.last = 0


def _scan(bits: Bits, own: list, huffman: dict, frame: dict, first: int, last: int, high: int, low: int, restart: int, pieces: list[bytes]) -> None:
    """Reads one scan into the components' coefficients; pieces: its data between restart marks."""
    progressive = frame["progressive"]
    single = len(own) == 1
    if single:
        c = own[0]
        units = [(y, x) for y in range(-(-(-(-frame["height"] * c.v // frame["v"])) // 8)) for x in range(-(-(-(-frame["width"] * c.h // frame["h"])) // 8))]
    else:
        units = [(y, x) for y in range(frame["rows"]) for x in range(frame["cols"])]
    run = 0
    piece = 0
    for k, (uy, ux) in enumerate(units):
        if k and restart and k % restart == 0:
            piece += 1
            if piece >= len(pieces):
                return
            bits = Bits(pieces[piece])
            run = 0
            for c in own:
                c.last = 0
        for c in own:
            spots = ((uy, ux),) if single else [(uy * c.v + y, ux * c.h + x) for y in range(c.v) for x in range(c.h)]
            for y, x in spots:
                block = c.blocks[y][x]
                if first == 0:
                    if high == 0:
                        c.last += bits.signed(bits.symbol(huffman[0, c.dc]))
                        block[0] = c.last << low
                    elif bits.take(1):
                        block[0] |= 1 << low
                if last == 0:
                    continue
                at, table = max(first, 1), huffman[1, c.ac]
                if high == 0:
                    if run:
                        run -= 1
                        continue
                    while at <= last:
                        s = bits.symbol(table)
                        zeros, n = s >> 4, s & 15
                        if n:
                            at += zeros
                            if at > 63:
                                raise ValueError("coefficient out of range")
                            block[at] = bits.signed(n) << low
                            at += 1
                        elif zeros == 15:
                            at += 16
                        else:
                            if progressive:
                                run = (1 << zeros) - 1 + bits.take(zeros)
                            break
                    continue
                bit = 1 << low
                if not run:
                    while at <= last:
                        s = bits.symbol(table)
                        zeros, n = s >> 4, s & 15
                        value = 0
                        if n:
                            value = bit if bits.take(1) else -bit
                        elif zeros < 15:
                            run = (1 << zeros) + bits.take(zeros)
                            break
                        while at <= last:
                            if block[at]:
                                if bits.take(1) and not abs(block[at]) & bit:
                                    block[at] += bit if block[at] > 0 else -bit
                            elif zeros:
                                zeros -= 1
                            else:
                                if value:
                                    block[at] = value
                                at += 1
                                break
                            at += 1
                if run:
                    while at <= last:
                        if block[at] and bits.take(1) and not abs(block[at]) & bit:
                            block[at] += bit if block[at] > 0 else -bit
                        at += 1
                    run -= 1


def decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("invalid JPEG signature")
    at, frame, restart, adobe = 2, None, 0, None
    tables: dict[int, np.ndarray] = {}
    huffman: dict[tuple[int, int], list[int]] = {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide, key = body[0] >> 4, body[0] & 15
                size = 128 if wide else 64
                tables[key] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + size :]
        elif mark == 0xC4:
            while body:
                counts = body[1:17]
                huffman[body[0] >> 4, body[0] & 15] = _lookup(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError(f"{depth} bits a sample")
            checked(width, height)
            parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            h, v = max(c.h for c in parts), max(c.v for c in parts)
            rows, cols = -(-height // (8 * v)), -(-width // (8 * h))
            frame = {"progressive": mark == 0xC2, "width": width, "height": height, "h": h, "v": v, "rows": rows, "cols": cols, "parts": parts}
            for c in parts:
                c.blocks = [[[0] * 64 for _ in range(cols * c.h)] for _ in range(rows * c.v)]
        elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("unsupported kind of JPEG")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("scan without a frame")
            by_key = {c.key: c for c in frame["parts"]}
            own = []
            for k in range(body[0]):
                c = by_key[body[1 + 2 * k]]
                c.dc, c.ac, c.last = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15, 0
                own.append(c)
            first, last, approximation = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end, cuts = at, [at]
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    cuts.append(end)
                else:
                    break
            stops = [c - 2 for c in cuts[1:]] + [end]
            pieces = [data[b:e].replace(b"\xff\0", b"\xff") for b, e in zip(cuts, stops, strict=True)]
            _scan(Bits(pieces[0]), own, huffman, frame, first, last, approximation >> 4, approximation & 15, restart, pieces)
            at = end
    if frame is None:
        raise ValueError("no image in file")
    planes = []
    width, height = frame["width"], frame["height"]
    for c in frame["parts"]:
        coefficients = np.array(c.blocks, np.float64)
        n, m = coefficients.shape[:2]
        flat = np.zeros((n * m, 64))
        flat[:, ZIGZAG] = coefficients.reshape(-1, 64) * tables[c.table]
        cells = _DCT.T @ flat.reshape(-1, 8, 8) @ _DCT
        plane = cells.reshape(n, m, 8, 8).transpose(0, 2, 1, 3).reshape(n * 8, m * 8) + 128
        plane = plane.repeat(frame["v"] // c.v, axis=0).repeat(frame["h"] // c.h, axis=1)
        planes.append(plane[:height, :width])
    whole = np.stack(planes, axis=2)
    if whole.shape[2] == 3 and adobe != 0:
        whole = _rgb(whole)
    elif whole.shape[2] == 4:  # CMYK, usually inverted by the writer that marks its files
        if adobe == 2:
            whole = np.concatenate([_rgb(whole[..., :3]), whole[..., 3:]], axis=2)
        whole = whole if adobe is not None else 255 - whole
        whole = whole[..., :3] * whole[..., 3:] / 255
    return rgba(np.clip(np.rint(whole), 0, 255).astype(np.uint8))


def _rgb(a: np.ndarray) -> np.ndarray:
    y, cb, cr = a[..., 0], a[..., 1] - 128, a[..., 2] - 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
