"""WebP: a lossless encoder, and a decoder of lossless files."""

from __future__ import annotations

import struct

import numpy as np

from fileloom.operators.errors import UnsupportedCodec
from fileloom.operators.images import checked, opaque
from fileloom.operators.jpeg import code_lengths

# The order in which lengths of code lengths are written, and the near places of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Writer:
    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 512:
            whole = self.n // 8
            self.parts += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def done(self) -> bytes:
        return bytes(self.parts) + self.value.to_bytes((self.n + 7) // 8, "little")


def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code with its first bit lowest, length) of each symbol."""
    if len(lengths) == 1:
        return {next(iter(lengths)): (0, 0)}
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = (_reversed(code, last), last)
        code += 1
    return out


def _complete(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a complete prefix code of at most 15 bits."""
    lengths = code_lengths({k: c for k, c in enumerate(counts.values())}, 15)
    lengths = {s: lengths[k] for k, s in enumerate(counts)}
    # the code without its reserved last place is made complete: the longest codes move up
    room = (1 << 15) - sum(1 << (15 - n) for n in lengths.values())
    for s in sorted(lengths, key=lambda s: (-lengths[s], s)):
        while lengths[s] > 1 and room >= 1 << (15 - lengths[s]):
            room -= 1 << (15 - lengths[s])
            lengths[s] -= 1
    return lengths


def _write_code(w: Writer, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    symbols = sorted(counts)
    if len(symbols) <= 2 and all(s < 256 for s in symbols):
        symbols = symbols or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(int(wide), 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return _codes(dict.fromkeys(symbols, 1))
    if len(symbols) == 1:
        counts = counts | {0: 1}
    lengths = _complete(counts)
    w.put(0, 1)
    # lengths of symbols as they are, with runs of zeros; lengths of these codes are all four or five bits
    w.put(len(LENGTH_ORDER) - 4, 4)
    runs, k = [], 0
    while k < size:
        n = lengths.get(k, 0)
        run = 1
        while n == 0 and k + run < size and not lengths.get(k + run, 0) and run < 138:
            run += 1
        if n == 0 and run >= 11:
            runs.append((18, run - 11, 7))
        elif n == 0 and run >= 3:
            run = min(run, 10)
            runs.append((17, run - 3, 3))
        else:
            run = 1
            runs.append((n, 0, 0))
        k += run
    fixed = {s: 5 if s < 6 else 4 for s in range(19)}
    fixed |= {s: 4 for s in range(6, 19)}  # 6 / 32 + 13 / 16 = 1
    for s in LENGTH_ORDER:
        w.put(fixed[s], 3)
    own = _codes(fixed)
    w.put(0, 1)
    for s, value, n in runs:
        w.put(*own[s])
        w.put(value, n)
    return _codes(lengths)


def encode(a: np.ndarray) -> bytes:
    """Subtracted green and one prefix code for each channel."""
    height, width = a.shape[:2]
    if max(height, width) > 16384:
        raise ValueError("too large for WebP")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(not opaque(a)), 1)
    w.put(0, 3)
    w.put(1, 1)
    w.put(2, 2)  # subtract green
    w.put(0, 1)
    w.put(0, 1)  # no color cache
    w.put(0, 1)  # one group of codes
    flat = a.reshape(-1, 4).astype(np.int64)
    green = flat[:, 1]
    planes = [green, (flat[:, 0] - green) & 255, (flat[:, 2] - green) & 255, flat[:, 3]]
    codes = []
    for plane, size in zip(planes, (280, 256, 256, 256), strict=True):
        counts = np.bincount(plane, minlength=256)
        codes.append(_write_code(w, {int(s): int(counts[s]) for s in np.flatnonzero(counts)}, size))
    _write_code(w, {0: 1}, 40)
    for pixel in zip(*[p.tolist() for p in planes], strict=True):
        for code, s in zip(codes, pixel, strict=True):
            w.put(*code[s])
    body = w.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# --- decoding ----------------------------------------------------------------------------------------------------


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.bits, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            part = self.data[self.at : self.at + 8]
            self.bits |= int.from_bytes(part, "little") << self.have
            self.at += 8
            self.have += 64
            if self.at > len(self.data) + 64:
                raise ValueError("unexpected end of image data")

    def take(self, n: int) -> int:
        self.fill(n)
        out = self.bits & ((1 << n) - 1)
        self.bits >>= n
        self.have -= n
        return out

    def symbol(self, code: dict[tuple[int, int], int] | int) -> int:
        if isinstance(code, int):
            return code
        self.fill(15)
        for n in range(1, 16):
            found = code.get((n, self.bits & ((1 << n) - 1)))
            if found is not None:
                self.bits >>= n
                self.have -= n
                return found
        raise ValueError("invalid prefix code")


def _tree(lengths: list[int]) -> dict[tuple[int, int], int] | int:
    own = {s: n for s, n in enumerate(lengths) if n}
    if len(own) == 1:
        return next(iter(own))
    return {(n, code): s for s, (code, n) in _codes(own).items()}


def _read_code(r: Reader, size: int):
    if r.take(1):
        two = r.take(1)
        first = r.take(8 if r.take(1) else 1)
        return {(1, 0): min(first, second), (1, 1): max(first, second)} if two and (second := r.take(8)) != first else first
    meta = [0] * 19
    for s in LENGTH_ORDER[: r.take(4) + 4]:
        meta[s] = r.take(3)
    most = size
    if r.take(1):
        most = 2 + r.take(2 + 2 * r.take(3))
    code, lengths, last = _tree(meta), [0] * size, 8
    k = 0
    while k < size and most:
        most -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
            continue
        n = r.take({16: 2, 17: 3, 18: 7}[s]) + {16: 3, 17: 3, 18: 11}[s]
        lengths[k : k + n] = [last if s == 16 else 0] * min(n, size - k)
        k += n
    return _tree(lengths)


def _extra(r: Reader, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + r.take(n) + 1


def _image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values as one 32-bit number a pixel."""
    cache_bits = r.take(4) if r.take(1) else 0
    groups, shape, shift = 1, None, 0
    if main and r.take(1):
        shift = r.take(3) + 2
        gw, gh = -(-width >> shift), -(-height >> shift)
        gw, gh = (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
        shape = (_image(r, gw, gh, False) >> 8) & 0xFFFF
        groups = int(shape.max()) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else []
    codes = [[_read_code(r, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    out = [0] * n
    k = stored = 0
    while k < n:
        green, red, blue, alpha, far = codes[int(shape[(k // width) >> shift, (k % width) >> shift])] if shape is not None else codes[0]
        s = r.symbol(green)
        if s < 256:
            v = s << 8 | r.symbol(red) << 16
            v |= r.symbol(blue)
            out[k] = v | r.symbol(alpha) << 24
            k += 1
        elif s < 280:
            length = _extra(r, s - 256)
            d = _extra(r, r.symbol(far))
            if d > 120:
                d -= 120
            else:
                dx, dy = NEAR[d - 1]
                d = max(dx + dy * width, 1)
            if d > k:
                raise ValueError("distance out of range")
            for _ in range(min(length, n - k)):
                out[k] = out[k - d]
                k += 1
        else:
            while stored < k:
                cache[(out[stored] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = out[stored]
                stored += 1
            out[k] = cache[s - 280]
            k += 1
    return np.array(out, np.uint32).reshape(height, width)


def _channels(v: np.ndarray) -> np.ndarray:
    return np.stack([(v >> s & 255).astype(np.int64) for s in (16, 8, 0, 24)], axis=2)


def _predict(own: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = own.shape[:2]
    out = own.tolist()
    half = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x

    def select(left, top, corner):
        p = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        q = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if p < q else top

    for y in range(height):
        row, above = out[y], out[y - 1] if y else None
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = above[0]
            else:
                left, top, corner = row[x - 1], above[x], above[x - 1]
                right = above[x + 1] if x + 1 < width else row[0]
                mode = int(modes[y >> shift, x >> shift])
                if mode == 1:
                    guess = left
                elif mode == 2:
                    guess = top
                elif mode == 3:
                    guess = right
                elif mode == 4:
                    guess = corner
                elif mode == 5:
                    guess = half(half(left, right), top)
                elif mode == 6:
                    guess = half(left, corner)
                elif mode == 7:
                    guess = half(left, top)
                elif mode == 8:
                    guess = half(corner, top)
                elif mode == 9:
                    guess = half(top, right)
                elif mode == 10:
                    guess = half(half(left, corner), half(top, right))
                elif mode == 11:
                    guess = select(left, top, corner)
                elif mode == 12:
                    guess = [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
                elif mode == 13:
                    guess = [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner, strict=True)]
                else:
                    guess = [0, 0, 0, 255]
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return np.array(out)


def decode(data: bytes) -> np.ndarray:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("invalid WebP signature")
    at, body = 12, None
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"VP8L":
            body = data[at + 8 : at + 8 + n]
            break
        if kind == b"VP8 ":
            raise UnsupportedCodec("reading lossy webp")
        at += 8 + n + n % 2
    if body is None:
        raise ValueError("no image in file")
    r = Reader(body)
    if r.take(8) != 0x2F:
        raise ValueError("invalid lossless signature")
    width, height = r.take(14) + 1, r.take(14) + 1
    checked(width, height)
    has_alpha = r.take(1)
    r.take(3)
    transforms, wide = [], width
    while r.take(1):
        kind = r.take(2)
        if kind < 2:
            shift = r.take(3) + 2
            transforms.append((kind, shift, _image(r, (wide + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False), wide))
        elif kind == 2:
            transforms.append((2, 0, None, wide))
        else:
            n = r.take(8) + 1
            table = np.cumsum(_channels(_image(r, n, 1, False))[0], axis=0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((3, pack, table, wide))
            wide = (wide + (1 << pack) - 1) >> pack
    out = _channels(_image(r, wide, height, True))
    for kind, shift, own, wide in reversed(transforms):
        if kind == 0:
            out = _predict(out, own >> 8 & 15, shift)
        elif kind == 1:
            yy, xx = np.arange(height) >> shift, np.arange(wide) >> shift
            t = _channels(own).astype(np.uint8).view(np.int8).astype(np.int64)[yy[:, None], xx[None, :]]
            signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)
            red = out[..., 0] + (t[..., 2] * signed(out[..., 1]) >> 5)
            blue = out[..., 2] + (t[..., 1] * signed(out[..., 1]) >> 5) + (t[..., 0] * signed(red) >> 5)
            out = np.stack([red & 255, out[..., 1], blue & 255, out[..., 3]], axis=2)
        elif kind == 2:
            out[..., 0] = (out[..., 0] + out[..., 1]) & 255
            out[..., 2] = (out[..., 2] + out[..., 1]) & 255
        else:
            index = out[..., 1]
            if shift:
                bits = 8 >> shift
                index = ((index[..., None] >> (bits * np.arange(1 << shift))) & ((1 << bits) - 1)).reshape(height, -1)[:, :wide]
            full = np.zeros((256, 4), np.int64)
            full[: len(own)] = own
            out = full[index]
    out = out.astype(np.uint8)
    if not has_alpha:
        out[..., 3] = 255
    return np.ascontiguousarray(out)
